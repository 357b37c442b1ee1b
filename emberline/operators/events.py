"""Spatiotemporal events: links, components, numbering, summaries and behaviour features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import METRES_PER_DEGREE, elongation, haversine
from ..functions.scalars import event_status, minutes_of_day
from ..functions.scalars import settled as _settled
from ..plans.storage import stored
from .graph import ONE_TASK_EDGES, connected_components
from .linking import linked_in_blocks
from .spatial import BROADCAST_POINTS, pairs_within

EPS_METRES = 750.0
EPS_DAYS = 1
LEAST_DETECTIONS = 2
LON_METRES = METRES_PER_DEGREE * 0.924892  # at the study area's middle latitude


def event_edges(det: DataFrame, eps_m: float = EPS_METRES, eps_days: int = EPS_DAYS) -> DataFrame:
    """(a, b, metres, days): detections that belong to one event directly."""
    day = F.datediff(F.col("acq_date"), F.lit("1970-01-01").cast("date"))
    return pairs_within(det.select("id", "lat", "lon", day.alias("day")), eps_m, eps_days)


def place_days(det: DataFrame) -> DataFrame:
    """(id, lat, lon, acq_date, n): detections at one place on one day as one node, named by the smallest id. Detections without a place or
    day are in none."""
    whole = det.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("acq_date").isNotNull())
    return whole.groupBy("lat", "lon", "acq_date").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


def linked_rows(det: DataFrame, eps_m: float = EPS_METRES, eps_days: int = EPS_DAYS, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Detections, with all their columns, and `component`, the smallest detection id of their event; one without links is its own.

    Rows are shuffled once, to blocks (`linking`), and keep their root there; only roots that meet beyond a block are edges. one_task: see
    `connected_components`.
    """
    rows = linked_in_blocks(det, eps_m, eps_days)
    met = rows.filter("_shared").groupBy("id").agg(F.min("_root").alias("a"), F.collect_set("_root").alias("_all"))  # one for each block of a row
    edges = met.select("a", F.explode("_all").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    found = stored(connected_components(edges, "a", "b", one_task), "roots")
    small = found.count() <= BROADCAST_POINTS
    own = rows.filter("_home").join(F.broadcast(found) if small else found, F.col("_root") == F.col("node"), "left")
    out = own.select(*det.columns, F.coalesce("component", "_root").alias("component"))
    return out if small else stored(out, "components")


def event_components(det: DataFrame, eps_m: float = EPS_METRES, eps_days: int = EPS_DAYS, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(id, component) of `linked_rows`."""
    return linked_rows(det.select("id", "lat", "lon", "acq_date"), eps_m, eps_days, one_task).select("id", "component")


def global_rank(rows: DataFrame, coarse: str, order: list[str], out: str) -> DataFrame:
    """Positions from 0 in the order (coarse, *order) without one task for all rows: ranks inside each value of `coarse`,
    plus the counts of the values before it."""
    inside = Window.partitionBy(coarse).orderBy(*order)
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(F.col(coarse).alias("_c")).agg(F.count(F.lit(1)).alias("_n")).select("_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = rows.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(starts, ranked[coarse].eqNullSafe(starts["_c"])).withColumn(out, (F.col("_start") + F.col("_in")).cast("long")).drop("_c", "_start", "_in")


def event_names(linked: DataFrame, least: int = LEAST_DETECTIONS, prefix: str = "EVT") -> DataFrame:
    """(stable_key, event_id) of components (component, lat, lon, acq_date) with at least `least` detections. Ids are ranks by start, end and
    centroid, so they may shift when data grow; stable_key, the smallest detection id, does not."""
    sizes = linked.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.min("acq_date").alias("start_date"), F.max("acq_date").alias("end_date"), F.round(F.avg("lat"), 9).alias("clat"), F.round(F.avg("lon"), 9).alias("clon")
    )
    ranked = global_rank(sizes.filter(F.col("n") >= least), "start_date", ["end_date", "clat", "clon", "component"], "rank")
    return ranked.select(F.col("component").alias("stable_key"), F.format_string(prefix + "%06d", "rank").alias("event_id"))


def event_members(det: DataFrame, components: DataFrame, least: int = LEAST_DETECTIONS, prefix: str = "EVT") -> DataFrame:
    """(id, event_id, stable_key): the detections of events with at least `least` of them; see `event_names`."""
    named = event_names(det.join(components, "id"), least, prefix)
    return components.join(named, F.col("component") == F.col("stable_key")).select("id", "event_id", "stable_key")


def by_event(det: DataFrame, members: DataFrame, summary: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What summary(rows, key) makes of each event. members: of `event_members`; for `linked_rows`, the `event_names`: then components
    are summed up, and only what comes out gets an event's id, so that no detection is shuffled for it."""
    if "component" not in det.columns:
        return summary(det.join(members, "id"), "event_id")
    table = summary(det, "component")
    return table.join(members, F.col("component") == F.col("stable_key")).select("event_id", *(c for c in table.columns if c != "component"))


def event_table(det: DataFrame, members: DataFrame, reference: Column) -> DataFrame:
    """One row for each event."""
    return by_event(det, members, lambda rows, key: _table(rows, key, reference))


def _table(rows: DataFrame, key: str, reference: Column) -> DataFrame:
    if key == "event_id":
        rows = stored(rows, "members")
    centres = stored(rows.groupBy(key).agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon")), "centres")
    small = centres.count() <= BROADCAST_POINTS
    placed = rows.select(key, "lat", "lon", "acq_date", "frp", "daynight").join(F.broadcast(centres) if small else centres, key)
    out = placed.groupBy(key).agg(
        F.min("acq_date").alias("start_date"),
        F.max("acq_date").alias("end_date"),
        F.max("clat").alias("clat"),
        F.max("clon").alias("clon"),
        F.max(haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))).alias("extent"),
        F.count(F.lit(1)).alias("detection_count"),
        F.avg("frp").alias("mean"),
        F.max("frp").alias("max_frp"),
        F.avg(F.when(F.col("daynight") == "N", 1.0).otherwise(0.0)).alias("night"),
    )
    return out.select(
        key, "start_date", "end_date", (F.datediff("end_date", "start_date") + 1).alias("duration_days"),
        _settled("clat", 6).alias("centroid_lat"), _settled("clon", 6).alias("centroid_lon"), F.round("extent", 1).alias("spatial_extent_m"), "detection_count",
        _settled("mean", 3).alias("mean_frp"), "max_frp", F.round("night", 4).alias("night_fraction"), event_status(F.col("end_date"), reference).alias("status"),
    )


def event_behavior(det: DataFrame, members: DataFrame) -> DataFrame:
    """Confidence shares, scan geometry, elongation, spread of the time of day and detections a day of each event."""
    return by_event(det, members, _behavior)


def _behavior(rows: DataFrame, key: str) -> DataFrame:
    x, y = F.col("lon") * LON_METRES, F.col("lat") * METRES_PER_DEGREE
    minutes = minutes_of_day(F.col("acq_time"))
    out = rows.groupBy(key).agg(
        F.avg(F.when(F.col("confidence") == "h", 1.0).otherwise(0.0)).alias("high"),
        F.avg(F.when(F.col("confidence") == "l", 1.0).otherwise(0.0)).alias("low"),
        F.avg("scan").alias("scan"),
        F.avg("track").alias("track"),
        F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"),
        F.coalesce(F.stddev_pop(minutes), F.lit(0.0)).alias("spread"),
        (F.count(F.lit(1)) / (F.datediff(F.max("acq_date"), F.min("acq_date")) + 1)).alias("rate"),
    )
    return out.select(
        key, _settled("high", 6).alias("frac_high_confidence"), _settled("low", 6).alias("frac_low_confidence"), _settled("scan", 6).alias("mean_scan"), _settled("track", 6).alias("mean_track"),
        _settled(elongation(F.col("vx"), F.col("vy"), F.col("cxy")), 4).alias("elongation_ratio"), _settled("spread", 4).alias("time_of_day_std_minutes"), _settled("rate", 6).alias("detections_per_day"),
    )


def frp_trend(det: DataFrame, members: DataFrame) -> DataFrame:
    """Slope of daily mean power over the index of the active day; null, and not computable, with fewer than two days."""
    return by_event(det, members, _trend)


def _trend(rows: DataFrame, key: str) -> DataFrame:
    daily = rows.groupBy(key, "acq_date").agg(F.avg("frp").alias("day_mean"))
    indexed = daily.withColumn("at", (F.row_number().over(Window.partitionBy(key).orderBy("acq_date")) - 1).cast("double"))
    out = indexed.groupBy(key).agg(F.count(F.lit(1)).alias("n_unique_days"), F.regr_slope("day_mean", "at").alias("slope"))
    computable = F.col("n_unique_days") >= 2
    return out.select(key, F.when(computable, F.round("slope", 6)).alias("frp_trend_slope"), computable.alias("frp_trend_computable"), "n_unique_days")
