"""Events in streaming state, and the area API as a stream of runs."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from emberline.operators import events as E
from emberline.sources import ingest
from emberline.streaming import cycle, live

SCHEMA = "lat double, lon double, acq_date date, acq_time string, satellite string, frp double, daynight string, seen date"
DAY = date(2024, 3, 1)


def sent(seed=5, n=120):
    """Detections around the corner of four tiles, some of them late, most sent by two runs, the second with another power."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        day = DAY + timedelta(days=rng.randrange(60))
        row = (20.0 + rng.uniform(-0.02, 0.02), 70.0 + rng.uniform(-0.02, 0.02), day, f"{k % 24:02d}00", rng.choice("N1"), rng.uniform(1, 9), rng.choice("DN"))
        delay = rng.choice([0, 1, 2, 4, 6, 6, 8])
        out.append((*row, day + timedelta(days=delay)))
        if delay < 6:
            out.append((*row[:5], row[5] + 1, *row[6:], day + timedelta(days=delay + 1)))
    # a site that is seen each day for weeks, and one detection in every tile's middle
    out += [(20.0, 70.0 + 0.0001 * (k % 3), DAY + timedelta(days=k), "0100", "N", 2.0, "N", DAY + timedelta(days=k)) for k in range(40)]
    out += [(20.05, 70.05, DAY, "0200", "N", 2.0, "N", DAY), (20.0501, 70.05, DAY, "0300", "N", 4.0, "D", DAY)]
    return sorted(out, key=lambda r: r[-1])


def streamed(spark, rows, cuts, folder, between=None):
    store = cycle.Store(spark, f"{folder}/store")
    edges = [DAY - timedelta(days=1), *cuts, date(2030, 1, 1)]
    for a, b in zip(edges, edges[1:]):
        part = [r for r in rows if a < r[-1] <= b]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        live.start(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), store, f"{folder}/checkpoint", once=True).awaitTermination()
        if between:
            between(store)
    return store


def batch_events(spark, rows):
    """The same by the batch operators: late rows out, the first row of each key, events that the last watermark has closed."""
    kept = [r for r in rows if (r[-1] - r[2]).days < 7]
    first = {}
    for r in sorted(kept, key=lambda r: (r[-1], r[5], r[6] == "N")):
        first.setdefault((r[0], r[1], r[2], r[3], r[4]), r)
    det = cycle.keyed(spark.createDataFrame(list(first.values()), SCHEMA)).withColumn("id", F.xxhash64(*cycle.KEY))
    members = E.event_members(det, E.event_components(det))
    last = max(r[-1] for r in rows) - timedelta(days=1)
    table = E.event_table(det, members, F.lit(date(2030, 1, 1)))
    keys = members.select("event_id", "stable_key").distinct()
    closed = table.join(keys, "event_id").filter(F.date_add("end_date", 8) <= F.lit(last))
    return sorted(tuple(r) for r in closed.select(*LIVE).collect())


LIVE = ["stable_key", "start_date", "end_date", "duration_days", "centroid_lat", "centroid_lon", "spatial_extent_m", "detection_count", "mean_frp", "max_frp", "night_fraction"]


def test_one_stream_in_three_cuts_gives_one_table(spark, tmp_path):
    rows = sent()
    late = sum((r[-1] - r[2]).days > 6 for r in rows)
    want = batch_events(spark, rows)
    assert len(want) > 10
    cuts = ([], [DAY + timedelta(days=30)], [DAY + timedelta(days=k) for k in (3, 11, 40)])
    for k, cut in enumerate(cuts):
        store = streamed(spark, rows, cut, str(tmp_path / f"cut{k}"))
        got = live.closed_events(store)
        assert sorted(tuple(r) for r in got.select(*LIVE).collect()) == want
        assert live.late_rows(store) == late > 0


def test_closed_events_are_written_once_and_state_keeps_the_window(spark, tmp_path):
    rows, seen = sent(7), []
    store = streamed(spark, rows, [DAY + timedelta(days=20), DAY + timedelta(days=45)], str(tmp_path), lambda s: seen.append(s.manifest().get("closed", {})))
    for a, b in zip(seen, seen[1:]):
        assert a.items() <= b.items()  # parts of earlier batches are those that were written then
    number = int(store.manifest()["_batch"])
    before = store.manifests()
    assert live.assemble(store, spark.createDataFrame([], live.OUT), number) == {"status": "replayed"} and store.manifests() == before
    open_rows = live.open_pieces(spark, str(tmp_path / "checkpoint"))
    last = max(r[-1] for r in rows)
    assert open_rows.count() > 0 and open_rows.agg(F.min("last")).first()[0] >= (last - timedelta(days=9) - date(1970, 1, 1)).days
    kept = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "nodes").option("flattenCollectionTypes", "true").load()
    days = kept.select("list_element.day").agg(F.min("day")).first()[0]
    assert days >= (last - timedelta(days=9) - date(1970, 1, 1)).days


def test_pieces_of_a_tile_are_components():
    rng = random.Random(2)
    rows = [{"id": k, "lat": 20.01 + rng.random() * 0.05, "lon": 70.01 + rng.random() * 0.05, "day": rng.randrange(12), "frp": 1.0, "night": False, "tiles": ["a"]} for k in range(300)]
    rows += [{**rows[0], "id": 300 + k} for k in range(50)]  # one place on one day
    tile = live._Tile([], [], 750.0, 1)
    for r in rng.sample(rows, len(rows)):
        tile.add(r, True)
    parent = {r["id"]: r["id"] for r in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in rows:
        for b in rows:
            if a["id"] < b["id"] and abs(a["day"] - b["day"]) <= 1 and live._metres((a["lat"], a["lon"]), (b["lat"], b["lon"])) <= 750:
                x, y = sorted((root(a["id"]), root(b["id"])))
                parent[y] = x
    sizes = Counter(root(r["id"]) for r in rows)
    assert {p: x["n"] for p, x in tile.pieces.items()} == sizes
    again = live._Tile(tile.node_rows(), [tuple(x) for x in tile.piece_rows()], 750.0, 1)
    assert {p: x["n"] for p, x in again.pieces.items()} == sizes


def test_the_outline_has_the_farthest_point():
    rng = random.Random(3)
    for _ in range(50):
        points = [(20 + rng.random() * 0.1, 70 + rng.random() * 0.1) for _ in range(rng.randrange(1, 60))]
        hull = live._hull(points)
        assert set(hull) <= set(points)
        for _ in range(5):
            at = (20 + rng.random() * 0.1, 70 + rng.random() * 0.1)
            assert max(live._metres(at, p) for p in hull) == max(live._metres(at, p) for p in points)


def test_tiles_must_be_wider_than_twice_the_distance(spark):
    df = spark.createDataFrame([(20.0, 70.0)], "lat double, lon double")
    assert live.copies(df).count() == 4
    with pytest.raises(ValueError):
        live.copies(df, 750.0, 0.01)


FETCHED = {}


def flaky(url):
    """One row for each day of the request; each request breaks once, then once answers with an error."""
    import pathlib

    *_, days, start = url.split("/")
    log = pathlib.Path(url.split("/")[2].replace("%", "/"))
    count = log / f"{start}-{days}"
    tries = int(count.read_text()) + 1 if count.exists() else 1
    count.write_text(str(tries))
    if tries % 3 == 1:
        raise OSError("broken pipe")
    if tries % 3 == 2:
        return 503, "busy"
    lines = [",".join(ingest.RAW_COLUMNS)]
    for k in range(int(days)):
        day = date.fromisoformat(start) + timedelta(days=k)
        lines.append(f"21.5,71.25,330,0.4,0.4,{day},0730,N,V,n,2,290,5.5,D")
    return 200, "\n".join(lines)


def test_runs_are_a_stream_that_restarts_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(ingest.AreaStream)
    (tmp_path / "log").mkdir()

    def run(until):
        source = (
            spark.readStream.format("detection_area_runs").option("fetch", "tests.test_live.flaky").option("base", "http://" + str(tmp_path / "log").replace("/", "%"))
            .option("source", "recent").option("box", "68,20,74,24").option("first_run", "2024-05-01").option("last_run", until).option("pause_s", "0").load()
        )
        source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return Counter((r["acq_date"], r["seen"].isoformat()) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run("2024-05-02")
    want = [date(2024, 4, 25) + timedelta(days=k) for k in range(8)]
    assert first == Counter({(d.isoformat(), min(date(2024, 5, 2), d + timedelta(days=6)).isoformat()): 1 for d in want})
    assert run("2024-05-02") == first  # nothing is new: no day is fetched again
    second = run("2024-05-12") - first  # ten days away
    want = [date(2024, 4, 27) + timedelta(days=k) for k in range(16)]
    assert second == Counter({(d.isoformat(), min(date(2024, 5, 12), d + timedelta(days=6)).isoformat()): 1 for d in want})
    assert all(seen >= "2024-05-03" for _, seen in second)  # no run's day lies before the batch
    assert {d for d, _ in first + second} == {(date(2024, 4, 25) + timedelta(days=k)).isoformat() for k in range(18)}
