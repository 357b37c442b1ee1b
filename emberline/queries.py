"""Registered queries over views derived from the star-schema tables. `emberline.oracles` has the SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import clusters as C
from .operators import contracts, dashboard, evidence, labels, reports, stats
from .operators import events as E
from .operators.graph import density_clusters
from .operators.spatial import nearest_in_own_radius, place_pairs
from .plans import evaluation, learning
from .plans.storage import shared_folder, stored
from .sources import adapter, blocks, ingest, runs
from .streaming import cycle, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BASELINE_YEAR, CLUSTER_EPS, CLUSTER_LEAST = 2023, 375.0, 8
SWEEP = [(eps, least) for eps in (250, 300, 375, 400, 500) for least in (3, 5, 8)]
STATIC = ("centroid_lat", "centroid_lon", "extent_radius_m", "nearest_distance_m", "n_industrial", "n_power")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def det(spark: SparkSession, d: str) -> DataFrame:
    return adapter.spark_view(spark, d, adapter.DET)


def hist(spark: SparkSession, d: str) -> DataFrame:
    return adapter.spark_view(spark, d, adapter.HIST).withColumn("year", F.year("acq_date"))


def layers(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {name: adapter.spark_view(spark, d, view) for name, view in adapter.LAYERS.items()}


def reference() -> F.Column:
    return F.lit(adapter.REFERENCE).cast("date")


def members_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Detections with their component, and the names of the events among these."""
    rows = E.linked_rows(det(spark, d).drop("brightness", "bright_t31", "satellite"))
    return rows, stored(E.event_names(rows), "names")


def events_of(spark: SparkSession, d: str) -> DataFrame:
    rows, members = members_of(spark, d)
    return stored(E.event_table(rows, members, reference()), "events")


def labelled_of(spark: SparkSession, d: str) -> DataFrame:
    """Baseline-year detections with their cluster."""
    base = stored(hist(spark, d).filter(F.col("year") == BASELINE_YEAR), "baseline")
    marks = density_clusters(base, CLUSTER_EPS, CLUSTER_LEAST, stored(place_pairs(base, CLUSTER_EPS), "pairs"))
    return stored(base.join(marks, "id"), "labelled")


def stats_of(labelled: DataFrame) -> DataFrame:
    return stored(C.cluster_stats(labelled), "clusters")


def profile_of(labelled: DataFrame, clusters: DataFrame) -> DataFrame:
    return C.recurrence_profile(C.date_metrics(labelled, clusters))


def assigned_of(spark: SparkSession, d: str, labelled: DataFrame, clusters: DataFrame) -> DataFrame:
    """All years: the baseline keeps its clusters, others take the nearest cluster whose radius holds them, or -1."""
    others = hist(spark, d).filter(F.col("year") != BASELINE_YEAR)
    centres = clusters.select(F.col("cluster_id").alias("centre"), F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"), F.col("extent_radius_m").alias("radius_m"))
    near = nearest_in_own_radius(others, centres).select("id", F.col("centre").alias("cluster_id"))
    matched = others.join(near, "id", "left").withColumn("method", F.when(F.col("cluster_id").isNull(), "unmatched_historical").otherwise("nearest_centroid_within_radius")).withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    base = labelled.withColumn("method", F.lit("dbscan_2023"))
    return stored(base.unionByName(matched.select(*base.columns)), "assigned")


def context_of(spark: SparkSession, d: str, clusters: DataFrame) -> DataFrame:
    return evidence.map_context(clusters, adapter.features(spark, d, S.MAP_TAGS))


def review_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labelled detections, clusters, one wide row for each cluster)."""
    labelled = labelled_of(spark, d)
    clusters = stats_of(labelled)
    contracts.unique(clusters, "cluster_id")
    context = stored(context_of(spark, d, clusters), "context")
    contracts.same_keys(clusters, context, "cluster_id")
    return labelled, clusters, stored(profile_of(labelled, clusters).join(context, "cluster_id"), "review")


def integrated_of(spark: SparkSession, d: str) -> DataFrame:
    labelled, clusters, review = review_of(spark, d)
    assigned = assigned_of(spark, d, labelled, clusters)
    years = C.longitudinal(C.cross_year(clusters, assigned), assigned)
    return stored(C.integrated(review.join(years, "cluster_id")), "integrated")


def evidence_of(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """events: where the caller has them stored."""
    events = events_of(spark, d) if events is None else events
    labelled = labelled_of(spark, d)
    clusters = stats_of(labelled)
    years = C.cross_year(clusters, assigned_of(spark, d, labelled, clusters)).select("cluster_id", F.col("recurs_across_multiple_years").alias("recurs"))
    return stored(evidence.event_evidence(events, layers(spark, d), clusters.join(years, "cluster_id"), adapter.raster(spark)), "evidence")


def labelled_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with a portable stand-in for a label, so that splits and metrics have an oracle."""
    kinds = F.array(*map(F.lit, labels.TRAINED))
    n = F.substring("event_id", 4, 6).cast("int")
    return events_of(spark, d).withColumns({"silver_label": F.get(kinds, n % 4), "predicted_class": F.get(kinds, F.when(n % 7 == 0, (n + 1) % 4).otherwise(n % 4)), "score": (n * 37 % 101) / F.lit(101.0)})


@query
def bbox_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), (F.lit(19.5) + (F.col("user_id") % 60) / 10.0).cast("string").alias("latitude"), F.when(F.col("event_id") % 50 == 0, "n/a").otherwise((F.lit(67.0) + (F.col("user_id") % 80) / 10.0).cast("string")).alias("longitude"), F.col("ts").cast("date").alias("acq_date"))
    kept = ingest.with_year(ingest.bounded(rows))
    return kept.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query
def dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = det(spark, d).select("id", F.col("lat").cast("decimal(9,4)").alias("lat"), F.col("lon").cast("decimal(9,4)").alias("lon"), "acq_date", "acq_time", "frp")
    old = rows.filter("id % 3 <> 0")
    again = rows.withColumn("frp", F.col("frp") + 1000)
    merged = ingest.merge(old, again, ("lat", "lon", "acq_date", "acq_time"), "id")
    return merged.groupBy((F.col("frp") >= 1000).alias("is_new")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").cast("long").alias("id_sum"))


@query
def combine_years(spark: SparkSession, d: str) -> DataFrame:
    recent = det(spark, d).select("id", "lat", "lon", "acq_date", "frp", "brightness").withColumn("provenance", F.lit("recent"))
    old = hist(spark, d).select("id", "lat", "lon", "acq_date", "frp").withColumn("provenance", F.lit("archive"))
    both = ingest.with_year(ingest.combine([old, recent]))
    return both.groupBy("year", "provenance").agg(F.count(F.lit(1)).alias("n"), F.count("brightness").alias("n_brightness"), S.settled(F.avg("frp"), 4).alias("mean_frp"))


@query
def date_chunks(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    ranges = orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.min(F.col("o_orderdate").cast("date")).alias("start"), F.max(F.col("o_orderdate").cast("date")).alias("end"))
    return ingest.chunk_frame(ranges.select("start", "end"))


@query
def grid_groups(spark: SparkSession, d: str) -> DataFrame:
    return C.grid_groups(det(spark, d))


@query
def top20_cells(spark: SparkSession, d: str) -> DataFrame:
    return C.top_cells(C.grid_groups(det(spark, d)).select("cell_id", "unique_dates", "detection_count"))


@query
def grid_scales(spark: SparkSession, d: str) -> DataFrame:
    return C.occupied_cells(det(spark, d))


@query
def event_edges(spark: SparkSession, d: str) -> DataFrame:
    return E.event_edges(det(spark, d)).select("a", "b", F.round("metres", 3).alias("metres"), "days")


@query
def event_components(spark: SparkSession, d: str) -> DataFrame:
    return E.event_components(det(spark, d))


@query
def event_components_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The same without the short cut for few edges: what runs at scale."""
    return E.event_components(det(spark, d), one_task=0)


@query
def event_table(spark: SparkSession, d: str) -> DataFrame:
    rows, members = members_of(spark, d)
    return E.event_table(rows, members, reference())


@query
def event_behavior(spark: SparkSession, d: str) -> DataFrame:
    return E.event_behavior(*members_of(spark, d))


@query
def frp_trend(spark: SparkSession, d: str) -> DataFrame:
    return E.frp_trend(*members_of(spark, d))


@query
def leakage_corr(spark: SparkSession, d: str) -> DataFrame:
    rows, members = members_of(spark, d)
    table = E.frp_trend(rows, members).filter("frp_trend_computable").join(E.event_table(rows, members, reference()), "event_id")
    return stats.correlation_audit(table, "frp_trend_slope", ["duration_days", "detection_count", "mean_frp", "max_frp", "night_fraction", "spatial_extent_m"])


@query
def class_means(spark: SparkSession, d: str) -> DataFrame:
    return stats.class_means(labelled_events(spark, d), "silver_label", ["mean_frp", "spatial_extent_m"])


@query
def nearest_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence.distances(events_of(spark, d), layers(spark, d))


@query
def cluster_overlap(spark: SparkSession, d: str) -> DataFrame:
    return evidence.cluster_overlap(events_of(spark, d), stats_of(labelled_of(spark, d)))


@query
def osm_topk(spark: SparkSession, d: str) -> DataFrame:
    top = evidence.map_features(stats_of(labelled_of(spark, d)), adapter.features(spark, d, S.MAP_TAGS))
    return top.withColumn("metres", F.round("metres", 1))


@query
def osm_nearest_named(spark: SparkSession, d: str) -> DataFrame:
    return context_of(spark, d, stats_of(labelled_of(spark, d)))


@query
def land_cover(spark: SparkSession, d: str) -> DataFrame:
    return evidence.land_cover(events_of(spark, d), adapter.raster(spark))


@query
def lc_diversity(spark: SparkSession, d: str) -> DataFrame:
    return evidence.land_cover_diversity(events_of(spark, d), adapter.raster(spark))


@query
def window_diversity(spark: SparkSession, d: str) -> DataFrame:
    """The pixel under each event and the classes in its window of 9 by 9 pixels, from tiles that are read by block."""
    folder = f"{shared_folder(spark)}/emberline/tiles-{uuid.uuid4().hex}"
    tiles = blocks.Tiles(spark, adapter.write_tiles(spark, folder), "emberline.sources.blocks.file_ranges", f"{folder}/cache")
    points = events_of(spark, d).select("event_id", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"))
    return blocks.sample(points, tiles, 4, "event_id")


@query
def event_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence_of(spark, d)


@query
def silver_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.silver_labels(evidence_of(spark, d))


@query
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return labels.silver_labels(evidence_of(spark, d)).groupBy("silver_label", "ambiguity_reason").agg(F.count(F.lit(1)).alias("n"))


@query
def dbscan(spark: SparkSession, d: str) -> DataFrame:
    return labelled_of(spark, d).select("id", "cluster_id")


@query
def dbscan_sweep(spark: SparkSession, d: str) -> DataFrame:
    """One join at the largest radius serves every setting."""
    base = stored(hist(spark, d).filter(F.col("year") == BASELINE_YEAR), "baseline")
    pairs = stored(place_pairs(base, max(e for e, _ in SWEEP)), "pairs")
    out = None
    for eps, least in SWEEP:
        marks = base.join(density_clusters(base, eps, least, pairs), "id")
        sizes = marks.filter("cluster_id <> -1").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("acq_date").alias("dates"))
        noise = marks.agg(F.count_if(F.col("cluster_id") == -1).alias("n_noise"), F.count(F.lit(1)).alias("n_all"))
        one = sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.percentile("n", F.lit(0.5)), F.lit(0.0)).alias("median_size"), F.count_if(F.col("dates") > 1).alias("n_repeated_date_clusters"))
        row = one.join(noise).select(F.lit(eps).alias("eps_m"), F.lit(least).alias("min_samples"), "n_clusters", "n_noise", F.round(F.try_divide(F.col("n_noise") * 100.0, F.col("n_all")), 4).alias("noise_pct"), "largest", "median_size", "n_repeated_date_clusters")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c, k: S.settled(c, k).alias(c)
    return stats_of(labelled_of(spark, d)).select("cluster_id", r("centroid_lat", 6), r("centroid_lon", 6), "detection_count", "unique_dates", "first_date", "last_date", "active_span_days", r("mean_frp", 4), "max_frp", "day_count", "night_count", r("bbox_min_lat", 6), r("bbox_max_lat", 6), r("bbox_min_lon", 6), r("bbox_max_lon", 6), r("extent_radius_m", 3))


@query
def cluster_date_metrics(spark: SparkSession, d: str) -> DataFrame:
    labelled = labelled_of(spark, d)
    names = ("detections_per_active_date", "occurrence_rate", "night_fraction", "frp_ratio", "top_day_share", "top3_days_share")
    return C.date_metrics(labelled, stats_of(labelled)).select("cluster_id", *(F.round(c, 6).alias(c) for c in names))


@query
def recurrence_profile(spark: SparkSession, d: str) -> DataFrame:
    labelled = labelled_of(spark, d)
    return profile_of(labelled, stats_of(labelled)).select("cluster_id", "recurrence_strength", "short_window_recurrence", "burst_concentrated")


@query
def cross_year(spark: SparkSession, d: str) -> DataFrame:
    labelled = labelled_of(spark, d)
    clusters = stats_of(labelled)
    return C.cross_year(clusters, assigned_of(spark, d, labelled, clusters))


@query
def year_assignments(spark: SparkSession, d: str) -> DataFrame:
    labelled = labelled_of(spark, d)
    return assigned_of(spark, d, labelled, stats_of(labelled)).groupBy("year", "method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("n_clusters"))


@query
def longitudinal(spark: SparkSession, d: str) -> DataFrame:
    labelled = labelled_of(spark, d)
    clusters = stats_of(labelled)
    assigned = assigned_of(spark, d, labelled, clusters)
    return C.longitudinal(C.cross_year(clusters, assigned), assigned).drop("per_year_detection_counts", "per_year_unique_dates")


@query
def integrated(spark: SparkSession, d: str) -> DataFrame:
    return integrated_of(spark, d).select("cluster_id", "persistence_category", "activity_category", "persistence_activity_quadrant", "seasonality_category", "has_notable_osm_context", "evidence_notes")


@query
def intelligence(spark: SparkSession, d: str) -> DataFrame:
    rows = integrated_of(spark, d)
    groups = rows.select("cluster_id", F.concat(F.lit("Group "), F.char(F.lit(65) + F.col("cluster_id") % 3)).alias("unsupervised_group"))
    return C.intelligence(rows, groups).select("cluster_id", "unsupervised_group", "corroboration_2023_recurrence", "corroboration_5yr_persistence", "corroboration_osm_context", "evidence_corroboration_count")


@query
def iqr_flags(spark: SparkSession, d: str) -> DataFrame:
    labelled = labelled_of(spark, d)
    return stats.iqr_flags(C.date_metrics(labelled, stats_of(labelled)), "cluster_id", C.OUTLIER_METRICS)


@query
def deep_dive(spark: SparkSession, d: str) -> DataFrame:
    return C.deep_dive(review_of(spark, d)[2]).select("cluster_id", "day_night_pattern", "osm_context_bucket", "n_metrics_outlier", "n_illustrative_defs_satisfied", "contradiction_notes")


@query
def gaps(spark: SparkSession, d: str) -> DataFrame:
    return stats.largest_gaps(hist(spark, d), "frp", 3, "year").select("year", "rank", F.round("before", 3).alias("before"), F.round("after", 3).alias("after"), F.round("gap", 3).alias("gap"))


@query
def quantile_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantile_summary(hist(spark, d), "frp")


@query
def daynight(spark: SparkSession, d: str) -> DataFrame:
    night = F.count_if(F.col("daynight") == "N")
    return hist(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("daynight") == "D").alias("n_day"), night.alias("n_night"), F.round(night * 100.0 / F.count(F.lit(1)), 4).alias("pct_night"))


@query
def time_concentration(spark: SparkSession, d: str) -> DataFrame:
    rows = hist(spark, d).withColumn("hour", S.hours_of_day(F.col("acq_time")))
    counts = rows.groupBy("daynight", F.round("hour", 2).alias("h")).agg(F.count(F.lit(1)).alias("n")).groupBy("daynight").agg(F.min(F.struct((-F.col("n")).alias("n"), "h")).alias("m"))
    whole = rows.groupBy("daynight").agg(F.round(F.percentile("hour", F.lit(0.5)), 4).alias("median_hour"), F.round(F.stddev_pop("hour"), 4).alias("std_hour"), F.round(F.max("hour") - F.min("hour"), 4).alias("range_hours"))
    return whole.join(counts, "daynight").select("daynight", "median_hour", "std_hour", "range_hours", F.col("m.h").alias("mode_hour"))


@query
def cross_date_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distances between all detections of different dates in a cluster."""
    return C.cross_date_distances(labelled_of(spark, d).filter("cluster_id <> -1"), "cluster_id")


@query
def weighted_centroid(spark: SparkSession, d: str) -> DataFrame:
    cells = C.grid_groups(det(spark, d))
    box = cells.filter(F.col("cell_lat_center").between(21.0, 23.0) & F.col("cell_lon_center").between(69.0, 73.0))
    w = F.col("detection_count")
    return box.agg(F.count(F.lit(1)).alias("n_cells"), F.sum(w).alias("n_detections"), F.round(F.sum(F.col("cell_lat_center") * w) / F.sum(w), 5).alias("lat"), F.round(F.sum(F.col("cell_lon_center") * w) / F.sum(w), 5).alias("lon"))


@query
def box_clusters(spark: SparkSession, d: str) -> DataFrame:
    return labelled_of(spark, d).filter((F.col("cluster_id") != -1) & F.col("lat").between(21.0, 22.5) & F.col("lon").between(68.0, 71.0)).select("cluster_id").distinct()


@query
def spatial_split(spark: SparkSession, d: str) -> DataFrame:
    return learning.split_report(learning.spatial_split(labelled_events(spark, d)), "silver_label")


@query
def nn_same_class(spark: SparkSession, d: str) -> DataFrame:
    found = learning.nearest_same_class(stored(learning.spatial_split(labelled_events(spark, d)), "split"), "silver_label")
    return learning.distance_summary(found, "silver_label")


@query
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    shifted = labelled_events(spark, d).withColumn("start_date", F.add_months("start_date", -12 * (F.substring("event_id", 4, 6).cast("int") % 6)))
    return learning.temporal_split(shifted).groupBy("split", "silver_label").agg(F.count(F.lit(1)).alias("n"))


@query
def panel(spark: SparkSession, d: str) -> DataFrame:
    return learning.panel(integrated_of(spark, d))


@query
def metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.classification_metrics(labelled_events(spark, d), "silver_label", "predicted_class")


@query
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_events(spark, d).withColumn("positive", (F.col("silver_label") == F.col("predicted_class")).cast("int"))
    return stats.average_precision(rows, "positive", "score", "silver_label")


@query
def ari_nmi(spark: SparkSession, d: str) -> DataFrame:
    return stats.agreement(labelled_events(spark, d), "silver_label", "predicted_class")


@query
def group_profiles(spark: SparkSession, d: str) -> DataFrame:
    clusters = stats_of(labelled_of(spark, d)).withColumn("unsupervised_group", F.concat(F.lit("Group "), F.char(F.lit(65) + F.col("cluster_id") % 3)))
    return learning.group_profiles(clusters, "unsupervised_group", ["detection_count", "unique_dates", "mean_frp"])


@query
def contract_report(spark: SparkSession, d: str) -> DataFrame:
    """What contracts would find between the clusters and a copy that lacks one row and differs in another."""
    clusters = stats_of(labelled_of(spark, d)).select("cluster_id", F.col("detection_count").cast("double").alias("detection_count"), F.col("unique_dates").cast("double").alias("unique_dates"))
    other = clusters.filter("cluster_id <> 1").withColumn("detection_count", F.col("detection_count") + F.when(F.col("cluster_id") == 2, 1.0).otherwise(0.0))
    return contracts.key_differences(clusters, other, "cluster_id").select("cluster_id", F.col("side").alias("finding")).unionByName(contracts.differing(clusters, other, "cluster_id", ["detection_count", "unique_dates"]).select("cluster_id", F.col("column").alias("finding")))


@query
def dash_filter(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.apply_filters(labelled_events(spark, d), ["Industrial", "Gas_Flare"], ["closed"], start="2024-03-01", end="2024-09-30", id_prefix=" evt0002 ").select("event_id", "start_date", "predicted_class", "status")


@query
def dash_window(spark: SparkSession, d: str) -> DataFrame:
    events = events_of(spark, d)
    out = None
    for kind in ("today", "24h", "7d"):
        first, last = dashboard.temporal_range(kind, date(2024, 7, 15))
        kept = dashboard.apply_filters(events, start=first, end=last)
        row = dashboard.date_bounds(kept).join(kept.agg(F.count(F.lit(1)).alias("n"))).withColumn("window", F.lit(kind))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query
def dash_display(spark: SparkSession, d: str) -> DataFrame:
    events = events_of(spark, d)
    near = evidence.distances(events, {"dist_plant_m": layers(spark, d)["dist_plant_m"]}).join(events, "event_id")
    return near.select("event_id", S.display_distance(F.col("dist_plant_m")).alias("distance"), S.display_percent(F.col("night_fraction")).alias("night"), S.display_power(F.col("max_frp")).alias("power"))


@query
def marker_tiers(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.marker_tiers(events_of(spark, d))


@query
def stream_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Two cycles over overlapping windows give the events of all rows at once."""
    rows = det(spark, d)
    store = cycle.Store(spark, f"{shared_folder(spark)}/emberline/stream-{uuid.uuid4().hex}")
    cycle.run_cycle(store, rows.filter(F.col("acq_date") <= F.lit("2024-06-30").cast("date")), date(2024, 6, 30))
    cycle.run_cycle(store, rows.filter(F.col("acq_date") >= F.lit("2024-06-23").cast("date")), date.fromisoformat(adapter.REFERENCE))
    out = store.read("events")
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n_events"), F.sum("detection_count").alias("n_detections"), F.min("start_date").alias("first_start"), F.max("end_date").alias("last_end"))


@query
def stream_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that a stream has closed after two starts: rows come up to nine days after their day, most of them twice."""
    rows = det(spark, d)
    delay = (F.col("id") * 13 % 10).cast("int")
    once = rows.withColumn("seen", F.date_add("acq_date", delay))
    sent = once.unionByName(once.filter(delay < live.WINDOW_DAYS - 1).withColumn("seen", F.date_add("seen", 1)))
    folder = f"{shared_folder(spark)}/emberline/live-{uuid.uuid4().hex}"
    store = cycle.Store(spark, f"{folder}/store")
    for cut in (F.col("seen") <= F.lit("2024-06-30").cast("date"), F.col("seen") > F.lit("2024-06-30").cast("date")):
        sent.filter(cut).write.mode("append").parquet(f"{folder}/in")
        live.start(spark.readStream.schema(sent.schema).parquet(f"{folder}/in"), store, f"{folder}/checkpoint", once=True).awaitTermination()
    return live.closed_events(store).drop("stable_key").withColumn("late", F.lit(live.late_rows(store)).cast("long"))


@query
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    """What changes in a table of days when rows come and go."""
    rows, store = det(spark, d), cycle.Store(spark, f"{shared_folder(spark)}/emberline/feed-{uuid.uuid4().hex}")
    halves = (rows.filter((F.col("acq_date") <= F.lit("2024-06-30").cast("date")) & (F.col("id") % 50 != 0)), rows.filter(F.col("acq_date") >= F.lit("2024-02-01").cast("date")))
    for k, half in enumerate(halves):
        pending: dict = {}
        store.write("days", half.groupBy("acq_date").agg(F.count(F.lit(1)).alias("n"), F.max("frp").alias("max_frp")), pending)
        store.publish(pending, k)
    return store.changes("days", ["acq_date"], 1, 2)


@query
def kmeans_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = review_of(spark, d)[2].select("cluster_id", *(F.col(c).cast("double").alias(c) for c in ("detection_count", "unique_dates", "active_span_days", "mean_frp", "night_fraction", "top_day_share")))
    features = rows.columns[1:]
    grouped, _ = learning.kmeans_sweep(rows, features)
    return learning.principal_components(grouped, features).join(learning.ward_groups(rows, "cluster_id", features, 3), "cluster_id").select("cluster_id", "unsupervised_group", "ward_group", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query
def inference_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events with a class and probabilities from a model that was trained on rule labels."""
    rows, members = members_of(spark, d)
    events = stored(E.event_table(rows, members, reference()), "events")
    table = stored(events.join(E.event_behavior(rows, members), "event_id"), "features")
    marked = labels.silver_labels(evidence_of(spark, d, events)).select("event_id", "silver_label").filter(F.col("silver_label").isin(*labels.TRAINED))
    numeric = ["duration_days", "spatial_extent_m", "detection_count", "mean_frp", "night_fraction", "frac_high_confidence", "mean_scan", "elongation_ratio", "time_of_day_std_minutes", "detections_per_day"]
    training = stored(table.join(marked, "event_id"), "training")
    model = learning.fit_boosted(training, "silver_label", numeric)
    scored = learning.predict(model, table)
    return scored.select("event_id", "predicted_class", *(F.round(c, 4).alias(c) for c in scored.columns if c.startswith("prob_")))


def raw_of(rows: DataFrame) -> DataFrame:
    """Detections as the source gives them: every cell as text, under the source's names."""
    names = {"latitude": "lat", "longitude": "lon", "bright_ti4": "brightness", "bright_ti5": "bright_t31"}
    fixed = {"satellite": "N", "instrument": "V", "version": "2"}
    column = lambda c: F.col(names.get(c, c)).cast("string") if names.get(c, c) in rows.columns else F.lit(fixed.get(c)).cast("string")
    return rows.select(*(column(c).alias(c) for c in ingest.RAW_COLUMNS))


@query
def two_source_ingest(spark: SparkSession, d: str) -> DataFrame:
    """A year from an archive up to June and a recent source from July, without repeated keys."""
    rows = det(spark, d)
    fetch = lambda source, start, end: raw_of(rows.filter(F.col("acq_date").between(F.lit(start), F.lit(end))))
    whole = runs.two_sources(fetch, date.fromisoformat(adapter.REFERENCE), date(2024, 1, 1), date(2024, 6, 30), date(2024, 7, 1))
    day = F.col("acq_date").cast("date")
    return whole.groupBy("viirs_source").agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))


@query
def ingest_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over years: the second writes again what it is forced to, but not the baseline year."""
    rows = hist(spark, d)
    fetch = lambda source, start, end: raw_of(rows.filter(F.col("acq_date").between(F.lit(start), F.lit(end))))
    folder = f"{shared_folder(spark)}/emberline/years-{uuid.uuid4().hex}"
    first = runs.ingest_years(spark, fetch, folder, [2022, BASELINE_YEAR]).withColumn("run", F.lit(1))
    again = runs.ingest_years(spark, fetch, folder, [2022, BASELINE_YEAR, 2050], force=True).withColumn("run", F.lit(2))
    return first.unionByName(again).select("run", "year", "status", "rows")


@query
def joined_features(spark: SparkSession, d: str) -> DataFrame:
    rows, members = members_of(spark, d)
    table = stored(E.event_table(rows, members, reference()), "events")
    return evaluation.joined_features(table.select("event_id", "mean_frp", "centroid_lat"), E.frp_trend(rows, members), table, "frp_trend_slope", "frp_trend_computable")


@query
def redundancy_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whether the trend is another feature, a place or a land-cover class in disguise."""
    rows, members = members_of(spark, d)
    table = stored(E.event_table(rows, members, reference()), "events")
    cover = evidence.land_cover(table, adapter.raster(spark))
    kinds = {"is_cropland": "Cropland", "is_tree_cover": "Tree cover"}
    known = E.frp_trend(rows, members).filter("frp_trend_computable").join(table, "event_id").join(cover, "event_id")
    known = known.withColumns({k: F.coalesce(F.col("land_cover_class") == v, F.lit(False)).cast("double") for k, v in kinds.items()})
    return stats.correlation_audit(known, "frp_trend_slope", ["centroid_lat", "centroid_lon", "mean_frp", "night_fraction", *kinds], 0.9)


@query
def feature_pairs(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlation_pairs(events_of(spark, d), ["duration_days", "detection_count", "mean_frp", "max_frp", "night_fraction", "spatial_extent_m"])


@query
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.counts_by(integrated_of(spark, d), ["persistence_activity_quadrant", "seasonality_category", "trend_direction", "recurrence_strength", "nearest_group"])


@query
def category_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return reports.crosstab(integrated_of(spark, d), "recurrence_strength", "trend_direction", ["increasing", "decreasing", "stable"])


@query
def top_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = integrated_of(spark, d)
    lists = [
        reports.top_list(rows, "most_active", "cluster_id", "total_detections_5yr", 5, F.col("activity_category") == "High-activity"),
        reports.top_list(rows, "least_active", "cluster_id", "total_detections_5yr", 5, F.col("activity_category") == "Low-activity", falling=False),
        reports.top_list(rows, "most_seasonal", "cluster_id", "top3_months_share", 8, F.col("seasonality_category") == "Strongly seasonal"),
        reports.top_list(rows, "most_variable", "cluster_id", "cv_annual_detections", 5, F.col("mean_annual_detections") >= 5),
    ]
    out = lists[0]
    for one in lists[1:]:
        out = out.unionByName(one)
    return out


@query
def frp_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.histogram(hist(spark, d), "frp", 0.0, 500.0, 20)


@query
def figure_marks(spark: SparkSession, d: str) -> DataFrame:
    return reports.marks(integrated_of(spark, d), "unique_years", "total_detections_5yr", "persistence_activity_quadrant")


@query
def figure_heat(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by the strength of a year's recurrence and the number of years."""
    return reports.heat(integrated_of(spark, d), "recurrence_strength", "unique_years", ["Strong", "Moderate", "Limited"])


@query
def figure_bars(spark: SparkSession, d: str) -> DataFrame:
    """Trends by persistence, pairs without clusters included."""
    return reports.heat(integrated_of(spark, d), "trend_direction", "persistence_category", ["increasing", "stable", "decreasing"])


@query
def date_order(spark: SparkSession, d: str) -> DataFrame:
    """Detections in the order of time, equal times by id."""
    return reports.positions(det(spark, d).select("id", "acq_date", "acq_time"), "acq_date", ["acq_time", "id"])


@query
def ward_heights(spark: SparkSession, d: str) -> DataFrame:
    """What the merges of the clusters' agglomeration add up to, and the first of them."""
    found = learning.ward_summary(stats_of(labelled_of(spark, d)), "cluster_id", ["detection_count", "unique_dates", "mean_frp", "centroid_lat"])
    return found.select("n_rows", "n_merges", S.settled("scatter", 4).alias("scatter"), S.settled("first_height", 4).alias("first_height"))


@query
def median_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.medians_by(hist(spark, d), "daynight", ["frp", "lat"])


@query
def fixed_radius_lookup(spark: SparkSession, d: str) -> DataFrame:
    return evidence.nearest_feature(stats_of(labelled_of(spark, d)), adapter.features(spark, d, S.MAP_TAGS), S.FIXED_RADIUS_TAGS)


def labelled_features(spark: SparkSession, d: str) -> DataFrame:
    """Events with rule labels of trained classes, all features and a start date that is spread over the years of the splits."""
    rows, members = members_of(spark, d)
    events = stored(E.event_table(rows, members, reference()), "events")
    table = stored(events.join(E.event_behavior(rows, members), "event_id"), "features")
    marked = labels.silver_labels(evidence_of(spark, d, events)).select("event_id", "silver_label").filter(F.col("silver_label").isin(*labels.TRAINED))
    spread = table.withColumn("start_date", F.add_months("start_date", -12 * (F.substring("event_id", 4, 6).cast("int") % 6)))
    return stored(evaluation.joined_features(spread.join(marked, "event_id"), E.frp_trend(rows, members), spread, "frp_trend_slope", "frp_trend_computable").withColumn("trend_known", S.bool_int(F.col("frp_trend_computable"))), "training")


BASE_FEATURES = ["duration_days", "spatial_extent_m", "detection_count", "mean_frp", "night_fraction", "frac_high_confidence", "mean_scan", "elongation_ratio", "time_of_day_std_minutes", "detections_per_day"]


@query
def feature_grid(spark: SparkSession, d: str) -> DataFrame:
    """Two feature sets, two splits and all models, with the same settings throughout."""
    sets = {"base": (BASE_FEATURES, []), "with_trend": ([*BASE_FEATURES, "frp_trend_slope", "trend_known"], [])}
    return evaluation.run_grid(labelled_features(spark, d), "silver_label", sets, forbidden={"land_cover_class", "dist_flare_m"})


@query
def spatial_holdout(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.spatial_holdout(labelled_features(spark, d), "silver_label", BASE_FEATURES)


@query
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The cluster table's features for learning, and how many places the vector names."""
    rows = evaluation.feature_matrix(integrated_of(spark, d))
    names = evaluation.place_names(rows)
    at = vector_to_array("features")
    return rows.select("cluster_id", *(S.settled(at[k], 6).alias(n) for k, n in enumerate(names)), F.size(at).alias("places"))


@query
def next_year_splits(spark: SparkSession, d: str) -> DataFrame:
    """Whether a cluster is seen in the next year, by forward-chaining splits of the panel."""
    return evaluation.next_year(integrated_of(spark, d), ("centroid_lat", "centroid_lon", "extent_radius_m"))


@query
def model_weights(spark: SparkSession, d: str) -> DataFrame:
    """What each model weighs, ranked."""
    rows, out = labelled_features(spark, d), None
    for name, fit in evaluation.MODELS.items():
        one = evaluation.weights(fit(rows, "silver_label", BASE_FEATURES)).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("weight", F.round("weight", 6))
