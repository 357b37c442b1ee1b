"""Grouping, the feature matrix, figures, loaders and the dashboard's small operators."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from emberline.functions import scalars as S
from emberline.operators import dashboard, reports
from emberline.operators.spatial import within_of
from emberline.plans import evaluation, figures, learning, sinks
from emberline.sources import tables


def brute_ward(x):
    """Heights by trying all pairs of groups at each step, from the groups' own members."""
    groups, heights = [[i] for i in range(len(x))], []

    def scatter(g):
        return ((x[g] - x[g].mean(0)) ** 2).sum()

    while len(groups) > 1:
        cost, a, b = min((scatter(groups[i] + groups[j]) - scatter(groups[i]) - scatter(groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        heights.append(np.sqrt(2 * max(cost, 0)))
        groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] + groups[b]]
    return heights


@pytest.mark.parametrize("seed", range(4))
def test_ward_heights_are_those_of_all_pairs(seed):
    x = np.random.default_rng(seed).normal(size=(22, 3)) * [1, 2, 0.2]
    merges = learning.ward_merges(x)
    assert np.allclose([m[2] for m in merges], brute_ward(x))
    assert merges[-1][3] == len(x) and sorted(k for m in merges for k in m[:2]) == list(range(2 * len(x) - 2))


def test_ward_groups_and_its_limit(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, 10.0 * (k % 3) + rng.random(), rng.random()) for k in range(31)]
    df = spark.createDataFrame(rows, "cluster_id long, x double, y double")
    got = {r["cluster_id"]: r["ward_group"] for r in learning.ward_groups(df, "cluster_id", ["x"], 3).collect()}
    assert got == {k: k % 3 for k in range(31)}  # the first group is the largest, then by their first key
    one = learning.ward_summary(df, "cluster_id", ["x", "y"]).first()
    assert one["n_merges"] == 30 and one["scatter"] == pytest.approx(62, abs=1e-5)
    assert learning.ward_groups(df.limit(0), "cluster_id", ["x"], 3).count() == 0
    monkeypatch.setattr(learning, "MOST_WARD_ROWS", 30)
    with pytest.raises(ValueError):
        learning.ward_groups(df, "cluster_id", ["x"], 3)


def test_groups_have_neutral_names_by_size(spark):
    rng = random.Random(3)
    rows = [(k, (0.0 if k < 25 else 9.0 if k < 35 else 20.0) + rng.random() / 10, rng.random() / 10) for k in range(40)]
    df = spark.createDataFrame(rows, "cluster_id long, x double, y double")
    grouped, scores = learning.kmeans_sweep(df, ["x"], range(2, 5))
    got = {r["cluster_id"]: r["unsupervised_group"] for r in grouped.collect()}
    best = max(scores.values())
    assert len(set(got.values())) == min(k for k, s in scores.items() if s >= best - 0.01)
    assert got[0] == "Group A" and len({got[k] for k in range(25)}) == 1
    placed = learning.principal_components(df, ["x", "y"]).collect()
    values = np.array([[r["x"], r["y"]] for r in placed])
    z = (values - values.mean(0)) / values.std(0, ddof=1)
    w, v = np.linalg.eigh(z.T @ z)
    for j, name in enumerate(("pc1", "pc2")):
        axis = v[:, -1 - j]
        axis = axis * np.sign(axis[np.abs(axis).argmax()])
        got_axis = np.array([r[name] for r in placed])
        assert np.allclose(got_axis, z @ axis, atol=1e-8) or np.allclose(np.abs(got_axis), np.abs(z @ axis), atol=1e-8)


def test_places_of_a_vector_have_names(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, "ab"[k % 2], rng.random() + k % 2, rng.random(), "pq"[k % 3 == 0]) for k in range(60)]
    df = spark.createDataFrame(rows, "event_id long, label string, x double, y double, kind string")
    for fit in evaluation.MODELS.values():
        model = fit(df, "label", ["x", "y"], ["kind"])
        names = evaluation.feature_names(model)
        assert names[:2] == ["x", "y"] and {"kind=p", "kind=q"} <= set(names[2:])
    learning.fit_logistic(df, "label", ["x", "y"], ["kind"]).write().overwrite().save(str(tmp_path / "m"))
    assert evaluation.feature_names(PipelineModel.load(str(tmp_path / "m")))[:2] == ["x", "y"]
    boosted = learning.fit_boosted(df, "label", ["x", "y"], ["kind"], rounds=3)
    learning.save_boosted(boosted, str(tmp_path / "b"))
    again = learning.load_boosted(spark, str(tmp_path / "b"))
    assert evaluation.feature_names(again) == evaluation.feature_names(boosted)
    first = evaluation.weights(again).orderBy("rank").first()
    assert first["feature"] == "x" and first["weight"] > 0


def test_the_matrix_has_the_declared_columns(spark):
    columns = {c: 1.5 for c in evaluation.INCLUDED} | {"nearest_distance_m": None, "extent_radius_m": 900.0, "nearest_is_named": True}
    row = spark.createDataFrame([(7, *columns.values())], "cluster_id long, " + ", ".join(f"{c} {'boolean' if c == 'nearest_is_named' else 'double'}" for c in columns))
    matrix = evaluation.feature_matrix(row)
    assert evaluation.place_names(matrix) == list(evaluation.INCLUDED) and len(evaluation.INCLUDED) == 22
    got = matrix.first()
    assert got["nearest_distance_m"] == 1400.0 == got["features"][list(evaluation.INCLUDED).index("nearest_distance_m")] and got["nearest_is_named"] == 1.0


def test_figures(spark, tmp_path):
    rows = spark.createDataFrame([(y, n, "a<b" if y > 2 else "c") for y in range(1, 6) for n in (1, 10, 100)] + [(5, 100, "a<b")], "years int, total long, kind string")
    marks = reports.marks(rows, "years", "total", "kind")
    assert marks.agg(F.sum("n")).first()[0] == 16 and marks.count() == 15
    figures.scatter(marks, str(tmp_path / "s.svg"), "years", "total", "kind", "Years & totals", log_y=True)
    heat = reports.heat(rows, "kind", "years", ["a<b", "c", "none"])
    assert [(r["kind"], r["n"]) for r in heat.collect()][-5:] == [("none", 0)] * 5 and heat.count() == 15
    figures.heatmap(heat, str(tmp_path / "h.svg"), "kind", "years", "n", "Kinds by years")
    figures.bars(heat, str(tmp_path / "b.svg"), "years", "n", "Years", "kind")
    figures.histogram(reports.histogram(rows, "total", 0.0, 100.0, 5), str(tmp_path / "t.svg"), "Totals", 50.0)
    texts = {f.name: f.read_text() for f in tmp_path.glob("*.svg")}
    assert set(texts) == {"s.svg", "h.svg", "b.svg", "t.svg"} and all(t.startswith("<svg") and t.endswith("</svg>") for t in texts.values())
    assert texts["s.svg"].count("<circle") == 15 and "a&lt;b" in texts["s.svg"] and "a<b" not in texts["s.svg"] and texts["t.svg"].count("<line") == 1
    with pytest.raises(figures.TooManyMarks):
        figures.rows_of(rows, 15)


def test_pages_have_a_limit(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1.0, 2.0, "x")] * 5, "lat double, lon double, name string")
    sinks.html_map(df, str(tmp_path / "m.html"), "lat", "lon", ["name"], "t")
    monkeypatch.setattr(sinks, "MOST_FEATURES", 4)
    with pytest.raises(ValueError):
        sinks.html_map(df, str(tmp_path / "n.html"), "lat", "lon", ["name"], "t")


def test_tables_are_loaded_by_their_declaration(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,flag,x,name,extra\n1,True,1.5,"a ""b""",z\n2,false,,,z\n')
    columns = {"id": "int", "flag": "boolean", "x": "double", "name": "string"}
    rows = tables.load(spark, str(tmp_path / "t.csv"), columns, "id").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, True, 1.5, 'a "b"'), (2, False, None, None)]
    with pytest.raises(ValueError, match="missing"):
        tables.load(spark, str(tmp_path / "t.csv"), {"gone": "int"})
    with pytest.raises(Exception, match="(?i)cast|malformed"):
        tables.load(spark, str(tmp_path / "t.csv"), {"name": "double"}).collect()
    (tmp_path / "p.csv").write_text("lat,lon,name\n21.5,72.5,a\n22,73,b\n")
    assert [tuple(r) for r in tables.points(spark, str(tmp_path / "p.csv"), carry={"name": "string"}).orderBy("lat").collect()] == [(21.5, 72.5, "a"), (22.0, 73.0, "b")]
    (tmp_path / "q.csv").write_text("latitude,longitude\n95,72.5\n")
    with pytest.raises(Exception, match="without a place"):
        tables.points(spark, str(tmp_path / "q.csv"), "latitude", "longitude").collect()


def test_plants_are_fetched_once(spark, tmp_path):
    head = "country,name,gppd_idnr,capacity_mw,latitude,longitude,primary_fuel,commissioning_year,other"
    lines = ["IND,A,1,500,22.0,70.0,Coal,1990,x", "IND,B,2,,23.0,71.0,Solar,,x", "PAK,C,3,100,22.5,70.5,Gas,,x", "IND,D,4,80,12.0,77.0,Gas,,x", "IND,E,5,n/a,22.1,,Oil,,x", "IND,F,6,oops,21.0,72.0,Oil,,x"]
    asked = []

    def get(url):
        asked.append(url)
        return 200, "\n".join([head, *lines])

    path = str(tmp_path / "plants")
    for _ in range(2):
        rows = tables.fetch_plants(spark, path, "http://x/plants.csv", get)
        assert sorted((r["name"], r["capacity_mw"]) for r in rows.collect()) == [("A", 500.0), ("F", None)]
    assert asked == ["http://x/plants.csv"]
    with pytest.raises(RuntimeError):
        tables.fetch_plants(spark, str(tmp_path / "none"), "u", lambda url: (404, "gone"))
    assert not (tmp_path / "none").exists()


def test_small_operators(spark):
    points = spark.createDataFrame([(1, 21.0, 72.0), (2, 21.001, 72.0), (3, 21.1, 72.0)], "id long, lat double, lon double")
    assert {r["id"] for r in within_of(points, 21.0, 72.0, 200.0).collect()} == {1, 2}
    assert learning.majority(spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "k string"), "k") == "a"
    assert learning.majority(spark.createDataFrame([], "k string"), "k") is None
    assert spark.range(1).select(S.imputed_distance(F.lit(None).cast("double"), F.lit(100.0))).first()[0] == 750.0
    assert spark.range(1).select(S.add_days(F.lit("2024-02-28"), 2)).first()[0] == "2024-03-01"
    events = spark.createDataFrame([("E2", "2024-01-02", "Cropland"), ("E1", "2024-01-02", ""), ("E3", "2024-03-01", None), ("E4", "2023-01-01", "Built-up")], "event_id string, start_date string, land_cover_class string")
    assert [r["event_id"] for r in dashboard.newest_first(events).collect()] == ["E3", "E1", "E2", "E4"]
    assert [r[0] for r in dashboard.cover_options(events).collect()] == ["Built-up", "Cropland"] and dashboard.event(events, "E3").count() == 1
    rows = reports.positions(spark.createDataFrame([(3, "b"), (1, "a"), (2, "a"), (4, None)], "id long, day string"), "day", ["id"]).collect()
    assert {r["id"]: r["position"] for r in rows} == {4: 0, 1: 1, 2: 2, 3: 3}


def test_fits_of_a_grid_run_side_by_side(spark):
    """All fits meet before any goes on, so a grid that fits one model after the other would never end; the table is that of single fits."""
    from threading import Barrier

    rows = spark.createDataFrame([(k, f"EVT{k:06d}", "ab"[k % 2], float(k % 2 + k % 5), 21.0 + k % 4, 72.0, date(2020 + k % 2 * 4, 1, 1)) for k in range(40)], "n long, event_id string, y string, x double, centroid_lat double, centroid_lon double, start_date date")
    gate = Barrier(4, timeout=60)

    def met(*args):
        gate.wait()
        return learning.fit_logistic(*args)

    sets = {"one": (["x"], []), "two": (["x", "centroid_lat"], [])}
    out = evaluation.run_grid(rows, "y", sets, models={"met": met})
    alone = evaluation.run_grid(rows, "y", {"one": sets["one"]}, models={"met": learning.fit_logistic})
    assert {(r["feature_set"], r["split"], r["model"]) for r in out.collect()} == {(s, m, k) for s in sets for m in ("temporal", "spatial") for k in ("majority", "met")}
    assert sorted(map(repr, out.filter("feature_set = 'one'").collect())) == sorted(map(repr, alone.collect()))
