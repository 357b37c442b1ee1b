import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from emberline.functions import scalars as S
from emberline.operators import clusters as C
from emberline.operators import contracts, dashboard, labels, stats
from emberline.plans import learning
from emberline.sources import ingest
from emberline.streaming import cycle


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("n,tier", [(72, "Limited"), (73, "Moderate"), (142, "Moderate"), (143, "Strong")])
def test_recurrence_tiers(spark, n, tier):
    assert value(spark, S.recurrence_strength(F.lit(n))) == tier


def test_thresholds(spark):
    assert value(spark, S.short_window(F.lit(80))) and not value(spark, S.short_window(F.lit(81)))
    assert not value(spark, S.burst_concentrated(F.lit(0.5)))
    assert [value(spark, S.day_night_pattern(F.lit(x))) for x in (0.71, 0.7, 0.3, 0.29)] == ["mostly_night", "mixed", "mixed", "mostly_day"]
    assert [value(spark, S.search_radius(F.lit(x))) for x in (10.0, 700.0, 9000.0)] == [750.0, 1200.0, 3000.0]


def test_time_parts(spark):
    assert value(spark, S.minutes_of_day(F.lit("745"))) == 465 and value(spark, S.minutes_of_day(F.lit("0005"))) == 5


def test_count_strings(spark):
    assert value(spark, S.parse_counts(F.lit("2019:3;2020:5"))) == {2019: 3, 2020: 5}
    assert value(spark, S.parse_counts(F.lit(""))) == {} and value(spark, S.parse_counts(F.lit(None).cast("string"))) == {}


def test_first_listed_tag_wins(spark):
    tags = F.create_map(F.lit("power"), F.lit("plant"), F.lit("landuse"), F.lit("industrial"))
    assert value(spark, S.classify_tags(tags))["tag"] == "landuse=industrial"
    assert value(spark, S.classify_tags(F.create_map(F.lit("x"), F.lit("y"))))["label"] == "Unknown"


def evidence(spark, **over):
    base = {"event_id": "E1", "start_date": date(2024, 11, 1), "duration_days": 2, "night_fraction": 0.5, "mean_frp": 5.0, "dist_industrial_m": None, "dist_plant_m": None, "dist_flare_m": None, "dist_kiln_m": None, "overlap_strength": None, "overlap_multiyear": None, "land_cover_class": None}
    schema = "event_id string, start_date date, duration_days int, night_fraction double, mean_frp double, dist_industrial_m double, dist_plant_m double, dist_flare_m double, dist_kiln_m double, overlap_strength string, overlap_multiyear boolean, land_cover_class string"
    return labels.silver_labels(spark.createDataFrame([tuple((base | over).values())], schema)).first()


@pytest.mark.parametrize(
    "over,label,reason",
    [
        ({}, "Unknown_Ambiguous", "insufficient_evidence"),
        ({"dist_plant_m": 1000.0, "overlap_strength": "Strong"}, "Industrial", None),
        ({"dist_plant_m": 1000.1, "overlap_strength": "Strong"}, "Unknown_Ambiguous", "insufficient_evidence"),
        ({"dist_plant_m": 10.0, "overlap_strength": "Limited"}, "Unknown_Ambiguous", "insufficient_evidence"),
        ({"dist_flare_m": 900.0}, "Gas_Flare", None),
        ({"dist_kiln_m": 500.0}, "Brick_Kiln", None),
        ({"dist_kiln_m": 501.0}, "Unknown_Ambiguous", "insufficient_evidence"),
        ({"dist_kiln_m": 100.0, "start_date": date(2024, 7, 1)}, "Unknown_Ambiguous", "insufficient_evidence"),
        ({"land_cover_class": "Cropland"}, "Crop_Residue", None),
        ({"land_cover_class": "Tree cover", "start_date": date(2024, 3, 1)}, "Forest_Wildfire", None),
        ({"land_cover_class": "Cropland", "dist_kiln_m": 100.0}, "Unknown_Ambiguous", "conflicting_evidence"),
    ],
)
def test_label_rules(spark, over, label, reason):
    row = evidence(spark, **over)
    assert row["silver_label"] == label and row["ambiguity_reason"] == reason
    assert row["excluded_from_training"] == (label == "Unknown_Ambiguous")


def test_safe_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0)], "a double, b double, c double")
    row = df.agg(stats.safe_corr(F.col("a"), F.col("b")), stats.safe_corr(F.col("a"), F.col("c")), stats.safe_corr(F.col("a"), F.col("c"), 0.0)).first()
    assert abs(row[0] - 1) < 1e-12 and row[1] is None and row[2] == 0.0


def test_trend_and_months_of_an_idle_cluster(spark):
    years = spark.createDataFrame([(0, "", 0, None, None, False, "", "")], "cluster_id int, years_detected string, unique_years int, first_year int, last_year int, recurs_across_multiple_years boolean, per_year_detection_counts string, per_year_unique_dates string")
    assigned = spark.createDataFrame([], "cluster_id int, year int, acq_date date")
    row = C.longitudinal(years, assigned).first()
    assert row["trend_direction"] == "stable" and row["top3_months_share"] == 0.0 and row["dominant_month"] is None and row["cv_annual_detections"] == 0.0


def test_contracts(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double")
    with pytest.raises(contracts.ContractError):
        contracts.unique(a.union(a), "k")
    with pytest.raises(contracts.ContractError):
        contracts.same_keys(a, a.filter("k = 1"), "k")
    with pytest.raises(contracts.ContractError):
        contracts.consistent(a, a.withColumn("x", F.col("x") + 1e-3), "k", ["x"])
    contracts.consistent(a, a.withColumn("x", F.col("x") + 1e-9), "k", ["x"])
    with pytest.raises(contracts.ContractError):
        contracts.disjoint(["a", "b"], {"b"})
    with pytest.raises(contracts.ContractError):
        contracts.aligned(a, a.limit(1), ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.inventoried(["a", "b"], ["a"], [])


def test_dashboard_windows():
    assert dashboard.temporal_range("7d", date(2026, 11, 21)) == ("2026-11-15", "2026-11-21")
    assert dashboard.temporal_range("24h", date(2026, 1, 1)) == ("2025-12-31", "2026-01-01")
    assert dashboard.temporal_range("calendar", date(2026, 1, 1)) is None


def test_chunks_cover_a_year_without_gap_or_overlap():
    chunks = ingest.date_chunks(date(2024, 1, 1), date(2024, 12, 31))
    days = [d for a, b in chunks for d in range(a.toordinal(), b.toordinal() + 1)]
    assert days == list(range(date(2024, 1, 1).toordinal(), date(2024, 12, 31).toordinal() + 1))
    assert max((b - a).days + 1 for a, b in chunks) == 5
    with pytest.raises(ValueError):
        ingest.date_chunks(date(2024, 1, 2), date(2024, 1, 1))


def test_sources_touch():
    plan = ingest.source_plan(date(2026, 5, 3))
    assert plan[0][2].toordinal() + 1 == plan[1][1].toordinal()
    with pytest.raises(ValueError):
        ingest.source_plan(date(2026, 4, 1))
    assert ingest.window_start(date(2026, 5, 3), 365, date(2026, 1, 1)) == date(2026, 1, 1)


def test_merge_is_idempotent(spark):
    rows = spark.createDataFrame([("21.0", "72.0", "2024-01-01", "0745", "N", "5"), ("21.00", "72.0", "2024-01-01", "0745", "N", "6")], "latitude string, longitude string, acq_date string, acq_time string, satellite string, frp string")
    once = ingest.merge(rows, rows.withColumn("frp", F.lit("9")))
    assert once.count() == 2 and {r["frp"] for r in once.collect()} == {"5", "6"}
    assert ingest.merge(once, rows).count() == 2


def test_csv_scan(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('latitude,longitude,bright_ti4,note\n21.5,72.5,300,"a, ""b"""\n,72,1,x\nnope,72,1,y\n26,72,1,z\n24.7,68.0,2')
    rows = ingest.bounded(ingest.rename(ingest.read_raw_csv(spark, str(path)))).orderBy("latitude").collect()
    assert [r["latitude"] for r in rows] == ["21.5", "24.7"] and rows[0]["note"] == 'a, "b"' and rows[0]["brightness"] == "300"
    with pytest.raises(ValueError, match="frp"):
        ingest.check_columns(ingest.read_raw_csv(spark, str(path)))


def fake_fetch(url):
    *_, days, start = url.split("/")
    return 200, "latitude,longitude,acq_date\n" + f"21.0,72.0,{start}\n" * int(days)


def test_area_source(spark):
    spark.dataSource.register(ingest.AreaSource)
    read = spark.read.format("detection_area").option("start", "2024-01-01").option("end", "2024-01-12").option("base", "http://x").option("source", "s").option("box", "68,20,74.5,24.7").option("fetch", "tests.test_rules.fake_fetch")
    rows = read.load()
    assert rows.count() == 12 and rows.select("acq_date").distinct().count() == 3
    with pytest.raises(RuntimeError):
        ingest.check_body(200, "Invalid MAP_KEY.")
    with pytest.raises(RuntimeError):
        ingest.check_body(500, "")


def test_map_elements(spark):
    body = '{"elements": [{"type": "node", "id": 1, "lat": 21.0, "lon": 72.0, "tags": {"b": "2", "a": "1"}}, {"type": "way", "id": 2, "center": {"lat": 22.0, "lon": 71.0}}, {"type": "way", "id": 3}]}'
    rows = ingest.map_elements(spark.createDataFrame([(body,)], "json string")).orderBy("osm_id").collect()
    assert [(r["osm_id"], r["lat"], r["tag_text"]) for r in rows] == [(1, 21.0, "a=1;b=2"), (2, 22.0, "")]


def test_splits_and_panel(spark):
    df = spark.createDataFrame([(21.1, 72.1), (21.4, 72.4), (21.6, 72.1)], "centroid_lat double, centroid_lon double")
    rows = learning.spatial_split(df).collect()
    assert rows[0]["assignment"] == rows[1]["assignment"] != rows[2]["assignment"]
    with pytest.raises(ValueError):
        learning.panel(df, ((2022, 2023),))


def test_cycle_is_idempotent_and_failures_keep_freshness(spark, tmp_path):
    schema = "id long, lat double, lon double, acq_date date, acq_time string, frp double, daynight string"
    rows = spark.createDataFrame([(1, 21.0, 72.0, date(2024, 1, 1), "0700", 5.0, "D"), (2, 21.001, 72.0, date(2024, 1, 2), "0700", 6.0, "N")], schema)
    store = cycle.Store(spark, str(tmp_path / "s"))
    first = cycle.guarded_cycle(store, lambda: rows, date(2024, 1, 3))
    again = cycle.guarded_cycle(store, lambda: rows, date(2024, 1, 3))
    assert first["status"] == again["status"] == "updated" and first["n_detections"] == again["n_detections"] == 2 and again["n_events"] == 1
    before = (tmp_path / "s" / "freshness.json").read_text()
    assert cycle.guarded_cycle(store, lambda: 1 / 0, date(2024, 1, 4))["status"] == "failed"
    assert (tmp_path / "s" / "freshness.json").read_text() == before


def test_stream(spark, tmp_path):
    schema = "id long, lat double, lon double, acq_date date, acq_time string, frp double, daynight string"
    rows = spark.createDataFrame([(1, 21.0, 72.0, date(2024, 1, 1), "0700", 5.0, "D"), (2, 21.001, 72.0, date(2024, 1, 2), "0700", 6.0, "N")], schema)
    rows.write.parquet(str(tmp_path / "in"))
    store = cycle.Store(spark, str(tmp_path / "s"))
    q = cycle.start(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "c"), lambda: date(2024, 1, 5), once=True)
    q.awaitTermination(120)
    assert store.read("events").count() == 1


def test_display(spark):
    got = [value(spark, c) for c in (S.display_distance(F.lit(1234.6)), S.display_distance(F.lit(None).cast("double")), S.display_percent(F.lit(0.456)), S.display_power(F.lit(None).cast("double")), S.display_overlap(F.lit(3), F.lit(None).cast("string")), S.display_overlap(F.lit(None).cast("int"), F.lit("x")))]
    assert got == ["1,235 m", "— (none within search radius)", "45.6%", "—", "Overlaps persistent cluster #3 (recurrence: unknown).", "No persistent-cluster overlap."]
    ages = [value(spark, S.display_age(F.lit(s))) for s in (59, 60, 3599, 3600, 86399, 172800)]
    assert ages == ["less than a minute ago", "1 minute ago", "59 minutes ago", "1 hour ago", "23 hours ago", "2 days ago"]
    stamp = F.lit("2026-11-21 20:57:45").cast("timestamp")
    assert value(spark, S.display_clock(stamp)) == "02:27 IST" and value(spark, S.display_date(stamp)) == "22 Nov 2026"
    assert value(spark, S.seconds_since(stamp, F.lit("2026-11-21 20:58:45").cast("timestamp"))) == 60
    assert value(spark, S.is_stale(F.lit(3601))) and not value(spark, S.is_stale(F.lit(3600)))


def test_models(spark, tmp_path):
    rows = [(f"E{k}", ["a", "b", "c"][k % 3], float(k % 3) + (k % 7) / 50, float(k % 5)) for k in range(90)]
    df = spark.createDataFrame(rows, "event_id string, label string, x double, y double")
    model = learning.fit_boosted(df, "label", ["x", "y"], rounds=3, depth=2)
    out = learning.predict(model, df)
    assert out.filter("label = predicted_class").count() >= 85
    assert out.filter("abs(prob_a + prob_b + prob_c - 1) > 1e-9").count() == 0
    learning.save_boosted(model, str(tmp_path / "m"))
    again = learning.predict(learning.load_boosted(spark, str(tmp_path / "m")), df)
    assert out.select("event_id", "predicted_class").exceptAll(again.select("event_id", "predicted_class")).isEmpty()


def test_discover_years(spark, tmp_path):
    for name in ("raw_2019.csv", "raw_2026.csv", "other.txt"):
        (tmp_path / name).write_text("x")
    assert list(ingest.discover_years(spark, str(tmp_path))) == [2019, 2026]
    assert list(ingest.discover_years(spark, str(tmp_path), years=(2019,))) == [2019]
