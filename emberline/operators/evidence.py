"""Evidence around events and clusters: distances to layers, cluster overlap, map features, land cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import GROUPS, classify_tags, geometry_class, named_code, recurrence_strength, search_radius
from .spatial import TIE_DIGITS, candidates, nearest_in_own_radius, nearest_of_layers, top_in_radius

CAP_METRES = 20_000.0
TOP = 5
CELL = 0.25  # degrees of a land-cover cell
WINDOW = 1  # cells on either side for diversity


def distances(events: DataFrame, layers: dict[str, DataFrame], cap_m: float = CAP_METRES) -> DataFrame:
    """event_id with a rounded distance to the nearest point of each layer, null beyond the cap."""
    points = events.select("event_id", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"))
    return nearest_of_layers(points, layers, cap_m, "event_id").select("event_id", *(F.round(name, 1).alias(name) for name in layers))


def cluster_overlap(events: DataFrame, clusters: DataFrame) -> DataFrame:
    """event_id, overlaps_cluster_id and the distance: the nearest cluster, if the event lies inside its own radius."""
    points = events.select("event_id", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"))
    centres = clusters.select(F.col("cluster_id").alias("centre"), F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"), F.col("extent_radius_m").alias("radius_m"))
    found = nearest_in_own_radius(points, centres, "event_id").select("event_id", F.col("centre").alias("overlaps_cluster_id"), F.round("metres", 1).alias("cluster_distance_m"))
    return points.select("event_id").join(found, "event_id", "left")


def cell_of(lat: Column, lon: Column, size: float = CELL) -> tuple[Column, Column]:
    return F.floor(lat / size).cast("int"), F.floor(lon / size).cast("int")


def land_cover(events: DataFrame, raster: DataFrame) -> DataFrame:
    """event_id, land_cover_code, land_cover_class: the raster cell under the centroid; null where there is none."""
    row, col = cell_of(F.col("centroid_lat"), F.col("centroid_lon"))
    keyed = events.select("event_id", row.alias("row"), col.alias("col"))
    return keyed.join(raster, ["row", "col"], "left").select("event_id", F.col("code").alias("land_cover_code"), named_code(F.col("code")).alias("land_cover_class"))


def land_cover_diversity(events: DataFrame, raster: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct codes other than 0 in the window around the centroid's cell; null, and not computable, if there are none."""
    row, col = cell_of(F.col("centroid_lat"), F.col("centroid_lon"))
    steps = F.array(*map(F.lit, range(-window, window + 1)))
    cells = events.select("event_id", row.alias("_r"), col.alias("_c")).withColumn("_dr", F.explode(steps)).withColumn("_dc", F.explode(steps))
    keyed = cells.select("event_id", (F.col("_r") + F.col("_dr")).alias("row"), (F.col("_c") + F.col("_dc")).alias("col"))
    out = keyed.join(raster, ["row", "col"], "left").groupBy("event_id").agg(F.count_distinct(F.when(F.col("code") != 0, F.col("code"))).alias("n"))
    return out.select("event_id", F.nullif("n", F.lit(0)).alias("land_cover_diversity"), (F.col("n") > 0).alias("diversity_computable"))


def map_features(clusters: DataFrame, features: DataFrame) -> DataFrame:
    """The TOP nearest map features within each cluster's search radius, classified, with rank and the number of all."""
    left = clusters.select(F.col("cluster_id").alias("id"), F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"), search_radius(F.col("extent_radius_m")).alias("search_radius_m"))
    right = features.select("feature_id", "element", "lat", "lon", "name", classify_tags(F.col("tags")).alias("kind"))
    top = top_in_radius(left, right, "search_radius_m", 3000.0, TOP, ["feature_id"])
    return top.select(
        F.col("id").alias("cluster_id"), "rank", "found", F.col("r_feature_id").alias("feature_id"), F.col("r_kind.tag").alias("tag"), F.col("r_kind.label").alias("label"), F.col("r_kind.group").alias("group"),
        F.coalesce("r_name", F.lit("")).alias("name"), (F.coalesce("r_name", F.lit("")) != "").alias("is_named"), geometry_class(F.col("r_element"), F.col("r_kind.tag")).alias("geometry_class"), F.col("metres"),
    )


def nearest_feature(clusters: DataFrame, features: DataFrame, tags: list[tuple], radius_m: float = 2000.0) -> DataFrame:
    """(cluster_id, n_found, tag, label, name, metres): the one nearest feature with a listed tag within a fixed radius."""
    left = clusters.select("cluster_id", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"))
    right = features.select("feature_id", "lat", "lon", "name", classify_tags(F.col("tags"), tags).alias("kind")).filter(F.col("kind.tag") != "unknown")
    first = F.min(F.struct(F.round("metres", TIE_DIGITS).alias("near"), "r_feature_id", "r_kind", "r_name", "metres")).alias("m")
    found = candidates(left, right, radius_m).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), first).withColumnRenamed("cluster_id", "_id")
    return left.join(found, F.col("cluster_id") == F.col("_id"), "left").select("cluster_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_found"), F.col("m.r_kind.tag").alias("tag"), F.col("m.r_kind.label").alias("label"), F.col("m.r_name").alias("name"), F.round("m.metres", 1).alias("metres"))


def map_context(clusters: DataFrame, features: DataFrame) -> DataFrame:
    """One row for each cluster: nearest feature, nearest named one, counts by group of the top features, and a summary."""
    top = map_features(clusters, features)
    part = F.concat(F.col("tag"), F.lit("@"), F.round("metres", 0).cast("int").cast("string"), F.lit("m("), F.when(F.col("is_named"), F.col("name")).otherwise("unnamed"), F.lit(", "), F.col("geometry_class"), F.lit(")"))
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    named = F.min(F.when(F.col("is_named"), F.struct("rank", "tag", "label", "name", "metres")))
    summary = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"]), "; ")  # TOP parts at most
    found = top.groupBy(F.col("cluster_id").alias("_id")).agg(
        F.max("found").alias("found"), first("tag").alias("nearest_tag"), first("label").alias("nearest_label"), first("group").alias("nearest_group"), first("name").alias("nearest_name"), first("is_named").alias("nearest_is_named"),
        first("geometry_class").alias("nearest_geometry_class"), first("metres").alias("metres"), named.alias("named"), summary.alias("summary"), *(F.count_if(F.col("group") == g).alias(f"n_{g}") for g in GROUPS),
    )
    return clusters.select("cluster_id", search_radius(F.col("extent_radius_m")).alias("radius")).join(found, F.col("cluster_id") == F.col("_id"), "left").select(
        "cluster_id", F.round("radius", 4).alias("search_radius_m"), F.coalesce("found", F.lit(0)).cast("long").alias("features_found_in_radius"), "nearest_tag", "nearest_label", "nearest_group", "nearest_name", "nearest_is_named",
        "nearest_geometry_class", F.round("metres", 1).alias("nearest_distance_m"), F.col("named.name").alias("nearest_named_name"), F.round("named.metres", 1).alias("nearest_named_distance_m"),
        *(F.coalesce(f"n_{g}", F.lit(0)).cast("long").alias(f"n_{g}") for g in GROUPS), F.coalesce("summary", F.lit("")).alias("top_features_summary"),
    )


def event_evidence(events: DataFrame, layers: dict[str, DataFrame], clusters: DataFrame, raster: DataFrame) -> DataFrame:
    """Events with all evidence. clusters: (cluster_id, centroid, extent_radius_m, unique_dates, recurs)."""
    facts = clusters.select("cluster_id", recurrence_strength(F.col("unique_dates")).alias("overlap_strength"), F.col("recurs").alias("overlap_multiyear"))
    overlap = cluster_overlap(events, clusters).join(facts, F.col("overlaps_cluster_id") == F.col("cluster_id"), "left").drop("cluster_id", "cluster_distance_m")
    return events.join(distances(events, layers), "event_id", "left").join(overlap, "event_id", "left").join(land_cover(events, raster), "event_id", "left")
