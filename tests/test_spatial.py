import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from emberline.functions.geo import elongation, haversine, tile_name
from emberline.operators import events as E
from emberline.operators.graph import connected_components, density_clusters
from emberline.operators import clusters as C
from emberline.operators import stats
from emberline.operators.spatial import nearest_any, nearest_in_own_radius, nearest_of_layers, nearest_pairs, nearest_within, top_in_radius

DET = "id long, lat double, lon double, acq_date date, acq_time string, frp double, daynight string, confidence string, scan double, track double"


def metres(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(x)))


def detections(spark, rows):
    """rows: (lat, lon, day offset)"""
    full = [(i, la, lo, date(2024, 1, 1) + timedelta(days=t), "0745", 5.0, "D", "n", 0.4, 0.4) for i, (la, lo, t) in enumerate(rows)]
    return spark.createDataFrame(full, DET)


def test_haversine(spark):
    got = spark.range(1).select(haversine(F.lit(21.0), F.lit(72.0), F.lit(21.003), F.lit(72.0))).first()[0]
    assert abs(got - metres(21, 72, 21.003, 72)) < 1e-6


@pytest.mark.parametrize("lat,lon,name", [(21.1, 72.6, "N21E072"), (24.0, 75.0, "N24E075"), (-0.5, -1.0, "S03W003")])
def test_tile_name(spark, lat, lon, name):
    assert spark.range(1).select(tile_name(F.lit(lat), F.lit(lon))).first()[0] == name


def test_elongation(spark):
    row = spark.range(1).select(elongation(F.lit(0.0), F.lit(0.0), F.lit(0.0)), elongation(F.lit(4.0), F.lit(4.0), F.lit(0.0)), elongation(F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()
    assert row[0] == 0.0 and row[1] == 1.0 and row[2] < 1e-9


@pytest.mark.parametrize("second,eps_days,linked", [((21.003, 72.0, 0), 1, True), ((21.02, 72.0, 0), 1, False), ((21.0, 72.0, 1), 1, True), ((21.0, 72.0, 2), 1, False), ((21.0, 72.0, 2), 2, True)])
def test_event_links(spark, second, eps_days, linked):
    edges = E.event_edges(detections(spark, [(21.0, 72.0, 0), second]), eps_days=eps_days)
    assert edges.count() == int(linked)


def test_chain_is_one_event(spark):
    step = 700 / 111_320
    det = detections(spark, [(21 + k * step, 72.0, k) for k in range(4)])
    assert {r["component"] for r in E.event_components(det).collect()} == {0}


def test_pairs_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(21 + rng.random() * 0.03, 72 + rng.random() * 0.03, rng.randrange(4)) for _ in range(150)]
    det = detections(spark, rows)
    got = {(r["a"], r["b"]) for r in E.event_edges(det).collect()}
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if metres(*rows[i][:2], *rows[j][:2]) <= 750 and abs(rows[i][2] - rows[j][2]) <= 1}
    assert got == want


def test_closed_events_do_not_depend_on_later_days(spark):
    rng = random.Random(5)
    rows = [(21 + rng.random() * 0.02, 72 + rng.random() * 0.02, rng.randrange(12)) for _ in range(60)]
    det = detections(spark, rows)
    cut = date(2024, 1, 7)

    def groups(d, until):
        comp = d.join(E.event_components(d), "id").groupBy("component").agg(F.max("acq_date").alias("e"), F.collect_set("id").alias("ids"))
        return {frozenset(r["ids"]) for r in comp.collect() if r["e"] < until - timedelta(days=1)}

    assert groups(det.filter(F.col("acq_date") <= F.lit(cut)), cut) == groups(det, cut)


@pytest.mark.parametrize("reference,status", [(date(2024, 1, 2), "provisional"), (date(2024, 1, 3), "closed")])
def test_event_row(spark, reference, status):
    det = detections(spark, [(21.0, 72.0, 0), (21.001, 72.0, 1), (22.5, 71.0, 0)])
    rows = E.event_table(det, E.event_members(det, E.event_components(det)), F.lit(reference)).collect()
    assert len(rows) == 1 and rows[0]["event_id"] == "EVT000000" and rows[0]["duration_days"] == 2 and rows[0]["detection_count"] == 2 and rows[0]["status"] == status


def test_trend_needs_two_days(spark):
    det = detections(spark, [(21.0, 72.0, 0), (21.0, 72.0, 0), (22.0, 71.0, 0), (22.0, 71.0, 1)]).withColumn("frp", F.col("id").cast("double"))
    rows = {r["n_unique_days"]: r for r in E.frp_trend(det, E.event_members(det, E.event_components(det))).collect()}
    assert rows[1]["frp_trend_slope"] is None and not rows[1]["frp_trend_computable"]
    assert rows[2]["frp_trend_slope"] == 1.0


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(7, 7), (None, 3)]
    parent = list(range(80))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[find(a)] = find(b)
    least = {}
    for x in range(80):
        least[find(x)] = min(least.get(find(x), x), x)
    touched = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    for one_task in (0, 1000):
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), one_task=one_task).collect()}
        assert got == {x: least[find(x)] for x in touched}
        assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long"), one_task=one_task).count() == 0


def test_components_in_one_task_match_rounds_on_long_paths(spark):
    rng = random.Random(4)
    path = list(range(500))
    rng.shuffle(path)
    edges = [*zip(path, path[1:], strict=False), *((k, k + 1000) for k in range(1000, 1900)), (9000, 9001)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df, one_task=10**6).collect()}
    assert {got[k] for k in range(500)} == {0} and got[9001] == 9000 and got[2899] == min(k for k in range(1000, 1900) if k % 1000 == 899)


def test_density_clusters_match_loops(spark):
    """Repeated places, borders and noise against counting over all pairs."""
    rng = random.Random(9)
    spots = [(21 + rng.random() * 0.02, 72 + rng.random() * 0.02) for _ in range(70)]
    rows = [(k, *spots[rng.randrange(70)]) for k in range(160)]
    near = {i: [j for j in range(160) if metres(*rows[i][1:], *rows[j][1:]) <= 250] for i in range(160)}
    core = {i for i in near if len(near[i]) >= 6}
    label, nxt = {}, 0
    for i in sorted(core):
        if i not in label:
            todo = [i]
            label[i] = nxt
            while todo:
                for j in near[todo.pop()]:
                    if j in core and j not in label:
                        label[j] = nxt
                        todo.append(j)
            nxt += 1
    want = {i: label[i] if i in label else min((label[j] for j in near[i] if j in core), default=-1) for i in range(160)}
    points = spark.createDataFrame(rows, "id long, lat double, lon double")
    assert {r["id"]: r["cluster_id"] for r in density_clusters(points, 250.0, 6).collect()} == want and nxt > 1


def test_cross_date_distances_match_all_pairs(spark):
    rng = random.Random(2)
    spots = [(21 + rng.random() * 0.05, 72 + rng.random() * 0.05) for _ in range(12)]
    rows = [(k, k % 2, *spots[rng.randrange(12)], date(2024, 1, 1 + rng.randrange(4))) for k in range(60)]
    want = {}
    for c in (0, 1):
        own = [r for r in rows if r[1] == c]
        m = sorted(metres(*a[2:4], *b[2:4]) for i, a in enumerate(own) for b in own[i + 1 :] if a[4] != b[4])
        want[c] = (len(m), round(m[0], 2), round((m[(len(m) - 1) // 2] + m[len(m) // 2]) / 2, 2), round(m[-1], 2))
    df = spark.createDataFrame(rows, "id long, cluster_id int, lat double, lon double, acq_date date")
    got = {r["cluster_id"]: (r["n_pairs"], r["min_m"], r["median_m"], r["max_m"]) for r in C.cross_date_distances(df, "cluster_id").collect()}
    assert got == want and max(w[3] for w in want.values()) > 375


def test_ranks_and_gaps_match_sorting(spark):
    rng = random.Random(6)
    rows = [(g, rng.choice([rng.random() * 1e6, float(rng.randrange(5)), -3.5])) for g in "ab" for _ in range(400)] + [("c", 7.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["q1"], r["q2"]) for r in stats.quantiles(df, "g", "v", {"q1": 0.25, "q2": 0.9}).collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g)
        for share, value in zip((0.25, 0.9), got[g], strict=True):
            at = share * (len(v) - 1)
            low = v[int(at)]
            assert abs(value - (low + (v[min(int(at) + 1, len(v) - 1)] - low) * (at - int(at)))) < 1e-6
    gaps = {(r["g"], r["rank"]): (r["before"], r["after"]) for r in stats.largest_gaps(df, "v", 3, "g").collect()}
    for g in "ab":
        v = sorted({x for k, x in rows if k == g})
        top = sorted(zip(v, v[1:], strict=False), key=lambda p: (p[0] - p[1], -p[0]))[:3]
        assert [gaps[(g, k)] for k in (1, 2, 3)] == top
    weighted = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("a", 9.0, 2)], "g string, v double, w long")
    assert stats.quantiles(weighted, "g", "v", {"m": 0.5}, "w").first()["m"] == 3.0


def test_a_fixed_site_gives_no_quadratic_links(spark):
    """A site that is seen 50 times a day, and a second one beside it; rows without a place or day are their own."""
    rows = [(21.0, 72.0, t) for t in range(20) for _ in range(50)] + [(21.001, 72.0, t) for t in range(5) for _ in range(30)] + [(22.0, 72.0, t) for t in (0, 2)]
    df = detections(spark, rows).unionByName(spark.createDataFrame([(10_000 + k, None, None, None if k else date(2024, 1, 1), "0745", 5.0, "D", "n", 0.4, 0.4) for k in range(3)], DET))
    nodes = E.place_days(df)
    assert nodes.count() == 27 and E.event_edges(nodes).count() == 19 + 4 + 5 + 4 + 5
    for few in (0, E.ONE_TASK_EDGES):
        sizes = sorted(r["count"] for r in E.event_components(df, one_task=few).groupBy("component").count().collect())
        assert sizes == [1] * 5 + [20 * 50 + 5 * 30]


def test_nearest_anywhere(spark):
    """Far north, over the date line and near a pole, against all pairs."""
    rng = random.Random(8)
    for low, high in ((57, 60), (-1, 1), (80, 89)):
        left = [(k, rng.uniform(low, high), rng.uniform(179, 181)) for k in range(25)]
        right = [(rng.uniform(low - 1, high), rng.uniform(178, 182)) for _ in range(25)]
        wrap = lambda x: x - 360 if x > 180 else x
        a = spark.createDataFrame([(k, la, wrap(lo)) for k, la, lo in left], "id long, lat double, lon double")
        b = spark.createDataFrame([(la, wrap(lo)) for la, lo in right], "lat double, lon double")
        got = {r["id"]: r["m"] for r in nearest_any(a, b, "m").collect()}
        assert all(abs(got[k] - min(metres(la, lo, *r) for r in right)) < 1e-3 for k, la, lo in left)


def test_nearest_anywhere_keeps_few_candidates(spark):
    """Left places near, far and on the other side of the globe; right places in tight clusters and on top of each other."""
    rng = random.Random(12)
    right = [(21 + rng.gauss(0, 0.01), 72 + rng.gauss(0, 0.01)) for _ in range(1500)] + [(-33 + rng.gauss(0, 0.001), 151.0 + rng.gauss(0, 0.001)) for _ in range(700)] + [(50.0, -3.0 + k / 10) for k in range(30)] + [(10.0, 10.0)] * 400
    left = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)] + [(21 + rng.gauss(0, 0.02), 72 + rng.gauss(0, 0.02)) for _ in range(100)] + [(90.0, 0.0), (-90.0, 0.0), (0.0, 180.0), (10.0, 10.0)] + [(5.0, 5.0)] * 200
    a = spark.createDataFrame([(k, *p) for k, p in enumerate(left)] + [(9999, None, 1.0)], "id long, lat double, lon double")
    b = spark.createDataFrame([*right, (None, None)], "lat double, lon double")
    got = {r["id"]: r["m"] for r in nearest_any(a, b, "m").collect()}
    known = sorted(set(right))
    assert set(got) == set(range(len(left)))
    assert all(abs(got[k] - min(metres(*p, *r) for r in known)) < 1e-6 for k, p in enumerate(left))
    counts = [r["count"] for r in nearest_pairs(a, b).groupBy("place").count().collect()]
    assert len(counts) == len(set(left)) and max(counts) <= 60 and sum(counts) <= 12 * len(counts)
    assert nearest_any(a, b.limit(0), "m").count() == 0


def test_nearest_of_layers(spark):
    rng = random.Random(5)
    point = lambda: (21 + rng.random(), 72 + rng.random())
    left, layers = [(k, *point()) for k in range(40)], {"x": [point() for _ in range(30)], "y": [(24.0, 69.0)], "z": []}
    frames = {n: spark.createDataFrame(v, "lat double, lon double") for n, v in layers.items()}
    for r in nearest_of_layers(spark.createDataFrame(left, "id long, lat double, lon double"), frames, 20_000).collect():
        for n, v in layers.items():
            want = min((m for m in (metres(*left[r["id"]][1:], *p) for p in v) if m <= 20_000), default=None)
            assert r[n] is None if want is None else abs(r[n] - want) < 1e-6


def test_layers_are_searched_by_their_different_places(spark, monkeypatch):
    """A layer's points at one place are one: 2,000 points at four places are few, and are broadcast as such."""
    layer = [(k, 21 + k % 4 * 0.05, 72.0) for k in range(2000)]
    left = spark.createDataFrame([(k, 21 + k * 0.01, 72.03) for k in range(20)], "id long, lat double, lon double")
    frames = {"a": spark.createDataFrame(layer, "id long, lat double, lon double")}
    monkeypatch.setattr("emberline.operators.spatial.BROADCAST_POINTS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = nearest_of_layers(left, frames, 20_000)
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: r["a"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for k in range(20):
        assert got[k] == pytest.approx(min(metres(21 + k * 0.01, 72.03, x, y) for _, x, y in layer[:4]), abs=1e-6)


def test_density_clusters_border_takes_the_lowest(spark):
    step = 300 / 111_320
    rows = [(0, 0.0), (1, 0.1), (2, 0.2), (3, 1.1), (4, 2.0), (5, 2.1), (6, 2.2), (7, 9.0)]
    points = spark.createDataFrame([(i, 21 + k * step, 72.0) for i, k in rows], "id long, lat double, lon double")
    got = {r["id"]: r["cluster_id"] for r in density_clusters(points, 300.0, 4).collect()}
    # 0-2 and 4-6 are cores through the border point between them only if it reaches them
    assert got[7] == -1 and got[3] == 0


def test_nearest(spark):
    left = spark.createDataFrame([(1, 21.0, 72.0), (2, 24.0, 69.0)], "id long, lat double, lon double")
    right = spark.createDataFrame([(21.08, 72.0), (21.09, 72.0)], "lat double, lon double")
    got = {r["id"]: r["m"] for r in nearest_within(left, right, 20_000, "m").collect()}
    assert set(got) == {1} and abs(got[1] - metres(21, 72, 21.08, 72)) < 1e-6
    far = {r["id"]: r["m"] for r in nearest_any(left, right, "m").collect()}
    assert abs(far[2] - min(metres(24, 69, 21.08, 72), metres(24, 69, 21.09, 72))) < 1e-6
    assert nearest_within(left, right.limit(0), 20_000, "m").count() == 0


def test_nearest_first_then_its_radius(spark):
    left = spark.createDataFrame([(1, 21.0, 72.0)], "id long, lat double, lon double")
    small_near_large_far = spark.createDataFrame([(0, 21.01, 72.0, 500.0), (1, 21.02, 72.0, 5000.0)], "centre int, lat double, lon double, radius_m double")
    assert nearest_in_own_radius(left, small_near_large_far).count() == 0
    exact = small_near_large_far.filter("centre = 0").withColumn("radius_m", haversine(F.lit(21.0), F.lit(72.0), F.lit(21.01), F.lit(72.0)))
    assert nearest_in_own_radius(left, exact).first()["centre"] == 0
    assert nearest_in_own_radius(left, exact.limit(0)).count() == 0


def test_top_in_radius_counts_all(spark):
    left = spark.createDataFrame([(1, 21.0, 72.0, 1000.0)], "id long, lat double, lon double, r double")
    right = spark.createDataFrame([(k, 21.0 + k * 0.001, 72.0) for k in range(20)], "k long, lat double, lon double")
    rows = top_in_radius(left, right, "r", 3000.0, 5, ["k"]).orderBy("rank").collect()
    assert [r["r_k"] for r in rows] == [0, 1, 2, 3, 4] and rows[0]["found"] == 9


def test_many_places_at_a_site_give_few_links(spark, monkeypatch):
    """1,500 places of one site over ten days, and 20 of a site beside it: links are of parts, not of pairs of places."""
    rng = random.Random(21)
    rows = [(21.0 + rng.random() * 0.006, 72.0 + rng.random() * 0.006, k % 10) for k in range(1500)] + [(21.011, 72.0 + 1e-5 * k, 3) for k in range(20)]
    seen = []

    def counted(edges, *args):
        seen.append(edges.count())
        return connected_components(edges, *args)

    monkeypatch.setattr(E, "connected_components", counted)
    found = E.event_components(detections(spark, rows))
    assert {r["component"] for r in found.collect()} == {0} and seen[0] <= 30


def test_components_of_dense_and_odd_places(spark):
    """Against all pairs, with days apart, places that are no numbers, and several gaps between days."""
    rng = random.Random(22)
    for eps_days in (0, 1, 2):
        rows = [(21 + rng.random() * 0.05, 72 + rng.random() * 0.05, rng.randrange(9)) for _ in range(220)] + [(float("nan"), 72.0, 0), (float("nan"), 72.0, 1), (21.0, float("inf"), 0)]
        near = lambda a, b: all(map(math.isfinite, (*a[:2], *b[:2]))) and metres(*a[:2], *b[:2]) <= 750 and abs(a[2] - b[2]) <= eps_days  # noqa: B023, E731
        want = list(range(len(rows)))
        changed = True
        while changed:
            changed = False
            for a in range(len(rows)):
                for b in range(a):
                    if near(rows[a], rows[b]) and want[a] != want[b]:
                        want[a] = want[b] = min(want[a], want[b])
                        changed = True
        for few in (0, E.ONE_TASK_EDGES):
            got = {r["id"]: r["component"] for r in E.event_components(detections(spark, rows), eps_days=eps_days, one_task=few).collect()}
            assert got == dict(enumerate(want))
