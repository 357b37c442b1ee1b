"""What the monitoring view asks of the event table."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.store import Store


def apply_filters(events: DataFrame, classes: list[str] = (), statuses: list[str] = (), covers: list[str] = (), start: str | None = None, end: str | None = None, id_prefix: str = "") -> DataFrame:
    """All given conditions hold; an empty list or open end restricts nothing; the id prefix ignores case and outer blanks."""
    out = events
    for column, allowed in (("predicted_class", classes), ("status", statuses), ("land_cover_class", covers)):
        if allowed:
            out = out.filter(F.col(column).isin(*allowed))
    if start:
        out = out.filter(F.col("start_date") >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col("start_date") <= F.lit(end).cast("date"))
    prefix = id_prefix.strip().lower()
    return out.filter(F.startswith(F.lower("event_id"), F.lit(prefix))) if prefix else out


def temporal_range(kind: str, run_date: date) -> tuple[str, str] | None:
    """First and last start date of today, 24h (with the day before) or 7d, anchored at the run date; None for the calendar."""
    days = {"today": 0, "24h": 1, "7d": 6}.get(kind)
    return None if days is None else ((run_date - timedelta(days=days)).isoformat(), run_date.isoformat())


def date_bounds(events: DataFrame) -> DataFrame:
    return events.agg(F.min("start_date").alias("first_start"), F.max("start_date").alias("last_start"))


def cover_options(events: DataFrame) -> DataFrame:
    return events.select("land_cover_class").filter(F.coalesce("land_cover_class", F.lit("")) != "").distinct().orderBy("land_cover_class")


def newest_first(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("start_date"), "event_id")


def event(events: DataFrame, event_id: str) -> DataFrame:
    return events.filter(F.col("event_id") == event_id)


def poll(store: Store, table: str, key: list[str], seen: int) -> tuple[int, DataFrame | None]:
    """(manifest to ask from next time, rows (op, ...) that have changed since manifest `seen`, or None if nothing was published). Where
    what was seen is gone, all rows come as `reset`, which replaces what the view holds."""
    newest = (store.manifests() or [0])[-1]
    if newest == seen:
        return seen, None
    try:
        return newest, store.changes(table, key, seen, newest)
    except LookupError:
        whole = store.read(table, number=newest)
        return newest, None if whole is None else whole.select(F.lit("reset").alias("op"), "*")


def marker_tiers(events: DataFrame, size: float = 0.5) -> DataFrame:
    """Events a map cell, and the size class of its marker."""
    cell = [F.floor(F.col(c) / size).cast("int").alias(n) for c, n in (("centroid_lat", "row"), ("centroid_lon", "col"))]
    out = events.filter(F.col("centroid_lat").isNotNull() & F.col("centroid_lon").isNotNull()).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("tier", F.when(F.col("n") < 10, "sm").when(F.col("n") < 50, "md").otherwise("lg"))
