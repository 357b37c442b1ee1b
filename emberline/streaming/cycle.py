"""The refresh cycle: new detections are merged, events rebuilt, and freshness published, as micro-batches.

`start` runs it on a stream; `run_cycle` is the batch body, so a re-run or a replayed batch gives the same tables. Keys make
the merge idempotent: they are those of the ingest, compared as text. Detections are kept in parts by day, of which a cycle
reads and writes only those that it has new rows for. Components are kept too; a cycle links again only the new rows and the
components that reach the days next to theirs. Event ids are ranks over everything, so members and events are derived anew;
`streaming.live` keeps events in state instead. A cycle holds the store's lease, and publishes all its tables by one manifest.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import EPS_DAYS, event_components, event_members, event_table
from ..plans.sinks import write_json
from ..plans.storage import stored
from ..sources.ingest import KEY, WINDOW_DAYS, first_wins  # noqa: F401
from .store import KEEP, Lease, Locked, Store  # noqa: F401

INTERVAL = "30 minutes"


class IdCollision(RuntimeError):
    """Two keys have one id."""


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with the columns of KEY as text (the day as a date). Coordinates that came as numbers get their shortest text; a column that the
    rows lack is null, which is a value like any other."""
    shown = {"latitude": "lat", "longitude": "lon"}
    out = rows
    for c in KEY:
        if c == "acq_date":
            out = out.withColumn(c, F.col(c).cast("date"))
        else:
            source = c if c in rows.columns else shown.get(c)
            out = out.withColumn(c, F.col(source).cast("string") if source in rows.columns else F.lit(None).cast("string"))
    return out


def from_raw(raw: DataFrame) -> DataFrame:
    """Rows of the area source as detections, with the texts of their key beside the numbers. A bad cell fails the job."""
    numbers = {"lat": "latitude", "lon": "longitude", "frp": "frp"}
    return raw.withColumns({**{n: F.expr(f"cast({c} as double)") for n, c in numbers.items()}, "acq_date": F.expr("cast(acq_date as date)")})


def fresh_rows(existing: DataFrame | None, fetched: DataFrame) -> DataFrame:
    """The first fetched row of each key that is new. An id is a hash of the key, so it is the same in every order;
    `run_cycle` raises if two keys have one."""
    own = keyed(fetched).drop("id")
    first = first_wins(own, KEY, [c for c in own.columns if c not in KEY])
    if existing is not None:
        old = existing.select(*(F.col(c).alias(f"_{c}") for c in KEY))
        same = F.lit(True)
        for c in KEY:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        first = first.join(old, same, "left_anti")
    return first.withColumn("id", F.xxhash64(*KEY))


def merged(existing: DataFrame | None, fetched: DataFrame) -> DataFrame:
    """Existing rows, and the fresh ones."""
    fresh = fresh_rows(existing, fetched)
    return fresh if existing is None else existing.unionByName(fresh.select(*existing.columns))


def days_of(rows: DataFrame) -> list[str]:
    """The different days, as text: of one fetch some, of a first load some thousands."""
    return [str(r[0]) for r in rows.select("acq_date").distinct().orderBy("acq_date").collect()]


def relinked(detections: DataFrame, old: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """(id, component) of all detections. old: the components before the cycle; those without a detection within EPS_DAYS of a
    new one's day stay as they are, and the others are found again together with the new rows."""
    if old is None:
        return event_components(detections)
    days = fresh.select(F.explode(F.sequence(F.date_sub("acq_date", EPS_DAYS), F.date_add("acq_date", EPS_DAYS))).alias("_day")).distinct()  # a row for each day at most
    near = detections.join(days, F.col("acq_date") == F.col("_day"), "left_semi").select(F.col("id").alias("_id"))
    touched = stored(old.join(near, F.col("id") == F.col("_id"), "left_semi").select(F.col("component").alias("_touched")).distinct(), "touched")
    again = old.join(touched, F.col("component") == F.col("_touched"), "left_semi").select(F.col("id").alias("_again"))
    rows = fresh.select("id", "lat", "lon", "acq_date").unionByName(detections.join(again, F.col("id") == F.col("_again"), "left_semi").select("id", "lat", "lon", "acq_date"))
    return old.join(touched, F.col("component") == F.col("_touched"), "left_anti").unionByName(event_components(rows))


def run_cycle(store: Store, fetched: DataFrame, run_date: date, score: Callable[[DataFrame], DataFrame] | None = None, lease: Lease | None = None) -> dict:
    """One cycle: merge, link, rebuild events, score if a model is given, publish all at once. Freshness is written last, so a
    failed cycle leaves everything as it was. lease: one that the caller holds; else the cycle takes one for itself."""
    if lease is None:
        with Lease(store) as own:
            return run_cycle(store, fetched, run_date, score, own)
    number, pending = (store.manifests() or [0])[-1], {}
    came = stored(keyed(fetched), "fetched")
    fresh = stored(fresh_rows(store.read("detections", parts=days_of(came)), came), "fresh")
    days = days_of(fresh)
    old = store.read("components")
    kept = store.read("detections", parts=days)
    if days or store.read("detections") is None:
        touched = fresh if kept is None else kept.unionByName(fresh.select(*kept.columns))
        store.write_parts("detections", touched, "acq_date", pending, lease)
    detections = store.read("detections", pending)
    if detections is None:
        detections = fresh
    sizes = fresh.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).first()
    taken = 0 if old is None else old.join(fresh.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_semi").count()
    if sizes["n"] != sizes["ids"] or taken:
        raise IdCollision(f"{sizes['n']} new detections have {sizes['ids']} ids, of which {taken} are taken")
    lease.renew()
    components = store.write("components", relinked(detections, old, fresh), pending, lease)
    members = store.write("members", event_members(detections, components), pending, lease)
    lease.renew()
    events = store.write("events", event_table(detections, members, F.lit(run_date.isoformat()).cast("date")), pending, lease)
    predictions = store.write("predictions", score(events), pending, lease) if score else None
    counts = events.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "closed").alias("closed")).first()
    record = {
        "last_updated_utc": datetime.now(UTC).isoformat(), "run_date": run_date.isoformat(), "n_detections": components.count(), "n_new": sizes["n"], "n_events": counts["n"], "n_closed": counts["closed"],
        "n_provisional": counts["n"] - counts["closed"], "n_predictions": predictions.count() if predictions is not None else 0,
    }
    store.publish(pending, number, lease)
    store.clean(lease=lease)
    write_json(store.spark, f"{store.folder}/freshness.json", record)
    return record


def guarded_cycle(store: Store, fetch: Callable[[], DataFrame], run_date: date, score: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """run_cycle under the store's lease: `skipped` if another writer holds it, `failed` with the reason if anything goes wrong."""
    try:
        with Lease(store) as lease:
            return {"status": "updated", **run_cycle(store, fetch(), run_date, score, lease)}
    except Locked as e:
        return {"status": "skipped", "reason": str(e)}
    except Exception as e:
        return {"status": "failed", "reason": f"{type(e).__name__}: {e}"}


def start(spark: SparkSession, source: DataFrame, store: Store, checkpoint: str, run_date: Callable[[], date] = date.today, once: bool = False) -> StreamingQuery:
    """The cycle on a stream of detections: every INTERVAL, or once over what is there. A batch may be replayed without harm."""
    writer = source.writeStream.foreachBatch(lambda batch, _: run_cycle(store, batch, run_date())).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()


def freshness(record: str) -> dict:
    return json.loads(record)


def age_seconds(record: dict, now: float | None = None) -> float:
    return (now or time.time()) - datetime.fromisoformat(record["last_updated_utc"]).timestamp()
