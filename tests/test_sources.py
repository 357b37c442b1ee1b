"""Ingest runs, map fetches, raster tiles, the store and the sinks."""

import csv
import json
import struct
import zlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.plans import evaluation, learning, sinks
from emberline.sources import blocks, ingest, maps, raster, runs
from emberline.streaming import cycle

calls = []


def flaky_fetch(url):
    """Two rows a day, one of them twice; the first try of every chunk breaks."""
    import pathlib

    mark = pathlib.Path("/tmp") / f"emberline-flaky-{abs(hash(url))}"
    if not mark.exists():
        mark.write_text("x")
        raise OSError("reset")
    mark.unlink()
    *_, key, source, _, days, start = url.split("/")
    assert key == "of-tests"
    first = date.fromisoformat(start).toordinal()
    head = ",".join(ingest.RAW_COLUMNS)
    lines = [f"21.0,72.{k % 2},300,0.4,0.4,{date.fromordinal(first + d)},0745,N,V,n,2,290,5,{source[0]}" for d in range(int(days)) for k in range(3)]
    return 200, "\n".join([head, *lines])


def test_ingest_runs_from_the_area_source(spark, tmp_path):
    fetch = runs.area_fetch(spark, "http://x", (68, 20, 74, 25), "tests.test_sources.flaky_fetch")
    quick = lambda source, start, end: fetch(source, start, end)
    whole = runs.two_sources(quick, date(2024, 1, 8), date(2024, 1, 1), date(2024, 1, 4), date(2024, 1, 5))
    got = {r["viirs_source"]: r["n"] for r in whole.groupBy("viirs_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"archive": 8, "recent": 8} and {"brightness", "bright_t31"} <= set(whole.columns)
    with pytest.raises(ValueError):
        runs.two_sources(quick, date(2024, 1, 8), date(2024, 1, 1), date(2024, 1, 4), date(2024, 1, 6))


def frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ingest.RAW_COLUMNS))


def test_ingest_years(spark, tmp_path):
    row = ("21.0", "72.0", "300", "0.4", "0.4", "2022-03-01", "0745", "N", "V", "n", "2", "290", "5", "D")
    held = {2022: [row, row], 2023: [row], 2024: []}
    folder = str(tmp_path / "years")
    fetch = lambda source, start, end: frame(spark, held[start.year])
    status = lambda df: [(r["year"], r["status"], r["rows"]) for r in df.orderBy("year").collect()]
    assert status(runs.ingest_years(spark, fetch, folder, [2022, 2023, 2024])) == [(2022, "written", 1), (2023, "written", 1), (2024, "no_data", 0)]
    assert status(runs.ingest_years(spark, fetch, folder, [2022, 2023])) == [(2022, "skipped", None), (2023, "skipped", None)]
    assert status(runs.ingest_years(spark, fetch, folder, [2022, 2023], force=True)) == [(2022, "written", 1), (2023, "skipped", None)]
    one = runs.read_year(spark, folder, 2022)
    assert one.count() == 1 and "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        runs.ingest_years(spark, lambda *a: frame(spark, [row]).drop("frp"), folder, [2025])
    bad = lambda *a: frame(spark, [row]).withColumn("scan", F.raise_error(F.lit("bad cell")))
    assert runs.ingest_years(spark, bad, folder, [2026]).first()["status"] == "failed"


def test_map_fetches(spark, tmp_path):
    body = '{"elements": [{"type": "node", "id": 1, "lat": 21.0, "lon": 72.0, "tags": {"landuse": "industrial"}}]}'
    asked, pauses = [], []

    def post(address, query):
        asked.append(address)
        if len(asked) < 4:
            return (429, "") if len(asked) % 2 else (200, "<html>busy")
        return 200, body

    assert maps.fetch(("a", "b"), "q", post, sleep=pauses.append) == body and asked == ["a", "b", "a", "b"] and pauses == [5.0]
    assert maps.fetch(("a",), "q", lambda *a: (500, ""), attempts=3, sleep=pauses.append) is None and pauses[1:] == [5.0, 10.0]
    query = maps.area_query(maps.AREA_TAGS["kiln"], (68.0, 20.0, 74.5, 24.7))
    assert query.count("(20,68,24.7,74.5)") == 6 and 'way["man_made"="kiln"]' in query
    assert 'relation["landuse"="industrial"](around:2000,21.500000,72.250000);' in maps.point_query([("landuse", "industrial", "x")], 21.5, 72.25, 2000)
    layers = {"industrial": query}
    assert maps.stage(spark, str(tmp_path / "m"), layers, ("a",), lambda *a: (200, body)).first()["layer"] == "industrial"
    assert maps.stage(spark, str(tmp_path / "m"), layers, ("a",), lambda *a: 1 / 0).count() == 1
    with pytest.raises(RuntimeError, match="query_failed"):
        maps.stage(spark, str(tmp_path / "m"), {"flare": query}, ("a",), lambda *a: (500, ""), sleep=pauses.append)
    answers = {"21.0": body, "22.0": '{"elements": []}'}
    told = maps.lookup(spark, [(1, 21.0, 72.0, 500.0), (2, 22.0, 72.0, 500.0), (3, 23.0, 72.0, 500.0)], [("landuse", "industrial")], ("a",), lambda _, q: (200, answers[q.split("around:500,")[1][:4]]) if q.split("around:500,")[1][:4] in answers else (500, ""), attempts=1)
    assert {r["id"]: (r["status"], r["osm_id"]) for r in told.collect()} == {1: ("ok", 1), 2: ("none", None), 3: ("query_failed", None)}


def tiff(pixels, west, north, step, order="<", tiled=False, deflate=False, predictor=False):
    """A GeoTIFF of one band, by the format's own rules."""
    h, w = pixels.shape
    code = f"{order}u{pixels.dtype.itemsize}"
    size = 16
    if tiled:
        padded = np.zeros((-(-h // size) * size, -(-w // size) * size), pixels.dtype)
        padded[:h, :w] = pixels
        blocks = [padded[i : i + size, j : j + size] for i in range(0, padded.shape[0], size) for j in range(0, padded.shape[1], size)]
    else:
        blocks = [pixels[i : i + 5] for i in range(0, h, 5)]
    if predictor:
        blocks = [np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], 1) for b in blocks]
    packed = [zlib.compress(b.astype(code).tobytes()) if deflate else b.astype(code).tobytes() for b in blocks]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    offsets = []
    for p in packed:
        offsets.append(len(out))
        out += p
    fields = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8 * pixels.dtype.itemsize]), (259, 3, [8 if deflate else 1]), (317, 3, [2 if predictor else 1]), (33550, 12, [step, step, 0.0]), (33922, 12, [0.0, 0.0, 0.0, west, north, 0.0])]
    sizes = [len(p) for p in packed]
    fields += [(322, 3, [size]), (323, 3, [size]), (324, 4, offsets), (325, 4, sizes)] if tiled else [(273, 4, offsets), (278, 3, [5]), (279, 4, sizes)]
    entries = b""
    letters = {3: "H", 4: "I", 12: "d"}
    for tag, kind, values in sorted(fields):
        data = struct.pack(order + letters[kind] * len(values), *values)
        if len(data) > 4:
            place = len(out)
            out += data
            data = struct.pack(order + "I", place)
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    struct.pack_into(order + "I", out, 4, len(out))
    return bytes(out + struct.pack(order + "H", len(fields)) + entries + b"\0\0\0\0")


@pytest.mark.parametrize("kind", [{}, {"order": ">"}, {"tiled": True, "deflate": True}, {"tiled": True, "deflate": True, "predictor": True}, {"deflate": True, "wide": True}])
def test_raster_windows(kind):
    wide = kind.pop("wide", False)
    pixels = np.random.default_rng(1).integers(0, 200, (37, 43)).astype(np.uint16 if wide else np.uint8)
    tile = raster.Raster(tiff(pixels, 72.0, 24.0, 0.01, **kind))
    for row, col, radius in ((0, 0, 0), (20, 30, 3), (36, 42, 30), (15, 16, 1)):
        got = tile.window(24.0 - (row + 0.5) * 0.01, 72.0 + (col + 0.5) * 0.01, radius)
        assert np.array_equal(got, pixels[max(0, row - radius) : row + radius + 1, max(0, col - radius) : col + radius + 1])
    assert tile.window(50.0, 72.0).size == 0
    with pytest.raises(raster.RasterError):
        raster.Raster(b"GIF89a..")


def test_points_are_sampled_from_tiles(spark, tmp_path):
    pixels = np.random.default_rng(2).choice([0, 10, 40, 50], (60, 60)).astype(np.uint8)
    (tmp_path / "N21E072_map.tif").write_bytes(tiff(pixels, 72.0, 24.0, 0.05, tiled=True, deflate=True))
    (tmp_path / "readme.txt").write_text("x")
    points = [(k, 21.1 + k * 0.07, 72.1 + k * 0.06) for k in range(30)] + [(99, 15.0, 75.0)]
    got = {r["id"]: (r["code"], r["diversity"]) for r in raster.sample(spark.createDataFrame(points, "id long, lat double, lon double"), raster.tiles(spark, str(tmp_path)), 2).collect()}
    for k, lat, lon in points[:-1]:
        i, j = int((24.0 - lat) / 0.05), int((lon - 72.0) / 0.05)
        around = pixels[max(0, i - 2) : i + 3, max(0, j - 2) : j + 3]
        assert got[k] == (int(pixels[i, j]) or None, len(set(around[around > 0].tolist())) or None)
    assert got[99] == (None, None)


DETECTION = "id long, lat double, lon double, acq_date date, acq_time string, frp double, daynight string"


def test_a_cycle_that_dies_leaves_the_last_one(spark, tmp_path, monkeypatch):
    row = lambda k, d: (k, 21.0 + k / 1000, 72.0, date(2024, 1, d), "0700", 5.0, "D")
    store = cycle.Store(spark, str(tmp_path / "s"))
    cycle.run_cycle(store, spark.createDataFrame([row(1, 1), row(2, 2)], DETECTION), date(2024, 1, 3))
    held = {n: store.read(n).collect() for n in ("detections", "components", "members", "events")}
    real = cycle.Store.write

    def dies(self, name, df, pending, partition_by=None):
        if name == "events":
            raise OSError("disk")
        return real(self, name, df, pending, partition_by)

    monkeypatch.setattr(cycle.Store, "write", dies)
    with pytest.raises(OSError):
        cycle.run_cycle(store, spark.createDataFrame([row(3, 3)], DETECTION), date(2024, 1, 4))
    assert {n: store.read(n).collect() for n in held} == held and store.manifests() == [1]
    monkeypatch.undo()
    # a process that dies between the draft and its move leaves a draft that nobody reads
    (tmp_path / "s" / "manifests" / "000000000002.abc.part").write_text("{")
    assert store.manifests() == [1]
    cycle.run_cycle(store, spark.createDataFrame([row(3, 3)], DETECTION), date(2024, 1, 4))
    assert store.read("detections").count() == 3 and store.manifests() == [1, 2]
    with pytest.raises(cycle.Locked):
        store.publish({}, 1)
    for d in range(5, 9):
        cycle.run_cycle(store, spark.createDataFrame([row(d, d)], DETECTION), date(2024, 1, 9))
    assert len(store.manifests()) == cycle.KEEP and len(list((tmp_path / "s" / "events").iterdir())) == cycle.KEEP


def test_incremental_links_are_those_of_all_rows(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(k, 21 + rng.random() * 0.03, 72 + rng.random() * 0.03, date(2024, 1, 1 + rng.randrange(20)), f"{k:04d}", 5.0, "D") for k in range(90)]
    store = cycle.Store(spark, str(tmp_path / "s"))
    for part in (rows[:40], rows[30:70], rows[60:]):
        cycle.run_cycle(store, spark.createDataFrame(part, DETECTION), date(2024, 2, 1))
    detections = store.read("detections")
    whole = cycle.event_components(detections)
    assert detections.count() == 90 and store.read("components").exceptAll(whole.select("id", "component")).isEmpty()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 21.0, 72.0)], "name string, v double, lat double, lon double")
    sinks.export_csv(df.limit(0), str(tmp_path / "empty"), ["name", "v"])
    sinks.export_csv(df, str(tmp_path / "one"), ["v", "name"])
    read = lambda d: list(csv.reader(next(p for p in (tmp_path / d).iterdir() if p.suffix == ".csv").open()))
    assert read("empty") == [["name", "v"]] and read("one") == [["v", "name"], ["1.0", "a"]]
    sinks.write_table(df.limit(0), str(tmp_path / "t"), ["name"])
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["name"]
    path = str(tmp_path / "x.json")
    sinks.write_json(spark, path, {"a": 1})
    sinks.write_json(spark, path, {"a": 2})
    assert json.loads(sinks.read_text(spark, path)) == {"a": 2} and not sinks.create_text(spark, path, "no") and json.loads(sinks.read_text(spark, path)) == {"a": 2}
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".part")] == []
    sinks.html_map(df.withColumn("name", F.lit("</script>")), str(tmp_path / "map.html"), "lat", "lon", ["name", "v"], "T<1>")
    page = (tmp_path / "map.html").read_text()
    assert "T&lt;1&gt;" in page and page.count("</script>") == 1 and '"coordinates": [72.0, 21.0]' in page
    sinks.write_labelled(df.withColumn("id", F.lit(1)), spark.createDataFrame([(2, 5)], "id int, cluster_id int"), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).first()["cluster_id"] == -1
    shares = spark.createDataFrame([("e", "x", 0.123456)], "event_id string, predicted_class string, prob_x double")
    sinks.write_predictions({"s1": shares, "s2": shares.drop("prob_x")}, str(tmp_path / "p"), "event_id")
    assert {(r["split"], r["prob_x"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("s1", 0.1235), ("s2", None)}
    one = spark.createDataFrame([("a", 0.5)], "class string, precision double")
    sinks.write_metrics([one.withColumn("split", F.lit("s")), one.withColumn("model", F.lit("m"))], str(tmp_path / "m"))
    assert read("m")[0] == list(sinks.METRICS) and len(read("m")) == 3


def test_joined_features_fill_and_flag(spark):
    features = spark.createDataFrame([("a", 1.0, 9.0), ("b", 2.0, 9.0), ("c", 3.0, 9.0)], "event_id string, x double, slope double")
    extra = spark.createDataFrame([("a", 2.5, True), ("b", None, False)], "event_id string, slope double, known boolean")
    dates = spark.createDataFrame([("a", date(2020, 5, 1)), ("b", date(2021, 6, 1)), ("c", date(2022, 1, 1))], "event_id string, start_date date")
    got = {r["event_id"]: (r["slope"], r["known"], r["start_date"].year) for r in evaluation.joined_features(features, extra, dates, "slope", "known").collect()}
    assert got == {"a": (2.5, True, 2020), "b": (0.0, False, 2021)}


@pytest.fixture(scope="module")
def events(spark):
    rows = [(f"E{k}", "ab"[k % 2], float(k % 2) + (k % 7) / 20, float(k % 5), "pq"[k % 3 == 0], 20 + (k % 9) * 0.3, 70 + (k % 11) * 0.3, date(2019 + k % 7, 3, 1)) for k in range(140)]
    return spark.createDataFrame(rows, "event_id string, label string, x double, y double, kind string, centroid_lat double, centroid_lon double, start_date date")


def test_grid_of_sets_splits_and_models(events):
    models = {k: evaluation.MODELS[k] for k in ("logistic", "forest")}
    out = evaluation.run_grid(events, "label", {"A": (["y"], []), "B": (["x", "y"], ["kind"])}, models=models)
    macro = {(r["feature_set"], r["split"], r["model"]): r["f1"] for r in out.filter("class = 'macro'").collect()}
    assert len(macro) == 12 and all(macro[("B", s, m)] > 0.95 > macro[("A", s, m)] for s in ("temporal", "spatial") for m in models)
    assert all(macro[(f, s, "majority")] < 0.5 for f in "AB" for s in ("temporal", "spatial"))
    with pytest.raises(Exception, match="forbidden"):
        evaluation.run_grid(events, "label", {"A": (["x", "label"], [])}, models={})
    with pytest.raises(ValueError):
        evaluation.halves(events, "random")
    held = evaluation.spatial_holdout(events, "label", ["x", "y"], fit=learning.fit_forest)
    assert held.filter("class = 'macro'").first()["f1"] > 0.95


def test_weights_are_named_and_ranked(events):
    for fit in (learning.fit_logistic, learning.fit_forest):
        got = evaluation.weights(fit(events, "label", ["x", "y"], ["kind"])).collect()
        assert {r["feature"] for r in got} == {"x", "y", "kind=p", "kind=q"} and all(r["feature"] == "x" for r in got if r["rank"] == 1 and not r["class"].startswith("other"))


def test_permutation_importance(events):
    model = learning.fit_logistic(events, "label", ["x", "y"])
    got = learning.permutation_importance(model, events, "label", ["x", "y"], repeats=2).collect()
    assert got[0]["feature"] == "x" and got[0]["drop"] > 0.2 > abs(got[1]["drop"])


def test_next_year_needs_splits_apart(spark):
    years = {f"{k}_{y}": 5 for k in ("detections", "active_days") for y in range(2019, 2026)}
    rows = spark.createDataFrame([(k, *[(k % 2) * v for v in years.values()]) for k in range(20)], "cluster_id int, " + ", ".join(f"{c} long" for c in years))
    out = evaluation.next_year(rows, models={"logistic": learning.fit_logistic})
    assert {r["split"] for r in out.collect()} == set(evaluation.CHAIN)
    assert out.filter("model = 'logistic' and class = 'macro'").agg(F.min("f1")).first()[0] == 1.0
    with pytest.raises(Exception, match="forbidden"):
        evaluation.next_year(rows, splits={"bad": (((2019, 2020),), ((2019, 2020),))}, models={})


def counting(place, start, size):
    """A range reader over files that writes down what it is asked for."""
    import pathlib

    path = pathlib.Path(place)
    if not path.exists():
        with (path.parent / "asked.txt").open("a") as log:
            log.write(f"{path.stem} none\n")
        return None
    if size > 1:
        with (path.parent / "asked.txt").open("a") as log:
            log.write(f"{path.stem} {start} {size}\n")
    return path.read_bytes()[start : start + size]


@pytest.mark.parametrize("kind", [{"tiled": True, "deflate": True, "predictor": True}, {"order": ">", "deflate": True}, {}])
def test_points_are_sampled_from_blocks(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    held = {"N21E072": rng.choice([0, 10, 40, 50], (120, 120), p=[0.4, 0.1, 0.3, 0.2]).astype(np.uint8), "N21E075": np.full((120, 120), 30, np.uint8)}
    for name, pixels in held.items():
        (tmp_path / f"{name}.tif").write_bytes(tiff(pixels, float(name[4:]), 24.0, 0.025, **kind))
    points = [(k, 21.02 + rng.random() * 2.9, 72.02 + rng.random() * 2.9) for k in range(40)]
    points += [(100, 23.99, 72.01), (101, 21.001, 74.99), (102, 22.0, 72.4), (103, 22.0, 72.4), (104, 22.5, 76.0), (105, 22.5, 79.0), (106, None, 72.0), (107, 24.0, 72.5)]
    tiles = blocks.Tiles(spark, str(tmp_path / "{tile}.tif"), "tests.test_sources.counting", str(tmp_path / "cache"))
    frame = spark.createDataFrame(points, "id long, lat double, lon double")
    for radius in (3, 30):
        got = {r["id"]: (r["code"], r["diversity"]) for r in blocks.sample(frame, tiles, radius).collect()}
        assert set(got) == {p[0] for p in points}
        for k, lat, lon in points:
            pixels = held.get(f"N{int(lat // 3) * 3:02d}E{int(lon // 3) * 3:03d}" if lat else None)
            if pixels is None:
                assert got[k] == (None, None)
                continue
            i, j = int(np.floor((24.0 - lat) / 0.025)), int(np.floor((lon - (72.0 if lon < 75 else 75.0)) / 0.025))
            around = pixels[max(0, i - radius) : i + radius + 1, max(0, j - radius) : j + radius + 1]
            assert got[k] == (int(pixels[i, j]) or None, len(set(around[around > 0].tolist())) or None), k


def test_only_touched_blocks_are_read_and_only_once(spark, tmp_path):
    pixels = np.random.default_rng(1).choice([10, 40], (320, 320)).astype(np.uint8)
    data = tiff(pixels, 72.0, 24.0, 3 / 320, tiled=True)  # 400 blocks of 16 by 16
    (tmp_path / "N21E072.tif").write_bytes(data)
    raster_of = raster.Raster(data)
    tiles = blocks.Tiles(spark, str(tmp_path / "{tile}.tif"), "tests.test_sources.counting", str(tmp_path / "cache"))
    points = spark.createDataFrame([(1, 22.5, 73.5), (2, 22.5, 73.5), (3, 22.5001, 73.5001), (4, 22.0, 79.0)], "id long, lat double, lon double")
    first = blocks.sample(points, tiles, 3).collect()
    asked = [line.split() for line in (tmp_path / "asked.txt").read_text().splitlines()]
    ranges = [(int(a), int(n)) for _, a, n in (x for x in asked if x[1] != "none")]
    whole = set(zip(raster_of.starts, raster_of.sizes, strict=True))
    taken = [r for r in ranges if r in whole]
    assert 1 <= len(taken) == len(set(taken)) <= 4 and sum(n for _, n in ranges) < 0.6 * len(data)
    assert [x[0] for x in asked if x[1] == "none"] == ["N21E078"]
    again = blocks.sample(points, tiles, 3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, first))
    assert len((tmp_path / "asked.txt").read_text().splitlines()) == len(asked)  # all from the cache, the missing tile too


def test_raster_blocks_are_a_source(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 200, (37, 43)).astype(np.uint8)
    (tmp_path / "a.tif").write_bytes(tiff(pixels, 72.0, 24.0, 0.01, tiled=True, deflate=True))
    spark.dataSource.register(blocks.RasterBlocks)
    read = spark.read.format("raster_blocks").option("place", f"file://{tmp_path}/{{tile}}.tif").option("tiles", '["a", "gone"]').load()
    found = np.zeros((37, 43), int)
    for r in read.collect():
        found[r["top"] : r["top"] + r["rows"], r["left"] : r["left"] + r["cols"]] = np.array(r["pixels"]).reshape(r["rows"], r["cols"])
    assert (found == pixels).all() and read.count() == 9
