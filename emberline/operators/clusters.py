"""Persistent clusters: summaries, recurrence, years and months, integrated evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions.geo import grid_cell, haversine
from ..plans.storage import stored
from .stats import iqr_flags, quantiles

SUMMARY_YEARS = (2019, 2020, 2021, 2022, 2023)
LATER_YEARS = (2024, 2025)
MONTHS = tuple(range(1, 13))
OUTLIER_METRICS = ["unique_dates", "occurrence_rate", "detection_count", "active_span_days", "mean_frp", "max_frp", "frp_ratio", "top_day_share"]
#: (name, rule): example definitions of persistence, to see whose class depends on the choice.
DEFINITIONS = [
    ("unique_dates>=20", lambda: F.col("unique_dates") >= 20),
    ("occurrence_rate>=0.10", lambda: F.col("occurrence_rate") >= 0.10),
    ("unique_dates>=20_and_occurrence>=0.10", lambda: (F.col("unique_dates") >= 20) & (F.col("occurrence_rate") >= 0.10)),
    ("active_span>=300", lambda: F.col("active_span_days") >= 300),
    ("gap_based_top_tier", lambda: F.col("unique_dates") >= 143),
]


#: The wording of evidence notes and contradiction notes; {} stands for a value of the row.
NOTES = {
    "understated": "2023 recurrence_strength={} but persistent across all 5 years (2023 volume alone understates multi-year persistence)",
    "one_year": "2023 recurrence_strength=Strong but only detected in {}/5 years (2023 was evidently an unusually active year for this zone)",
    "short_window": "short_window_recurrence=True (2023) but 5-year seasonality is not concentrated (top3_months_share < 0.5) -- the short 2023 window may not reflect a broader seasonal pattern",
    "no_context": "no OSM context found nearby despite persisting across all 5 years (context evidence incomplete, not evidence of absence)",
    "named_but_quiet": "named industrial OSM feature nearby ({}) despite below-median 5-year activity -- proximity is not evidence this feature is the thermal source",
    "day_night": "day_night_pattern={}",
    "one_day": "single_day_dominated(>50%)",
    "three_days": "top3_days_dominated(>50%,but_no_single_day>50%)",
    "peak": "extreme_frp_ratio_outlier",
    "sparse": "long_span_but_low_occurrence",
    "busy_without_context": "above_median_recurrence_but_no_osm_context",
    "named_but_rare": "named_industrial_nearby_but_below_median_recurrence",
    "several": "compound_outlier(n_metrics={})",
    "definitions": "definition_sensitive({}/5_illustrative_defs)",
}


def note(name: str, value: Column | None = None) -> Column:
    """A note's text, with a value in its place."""
    before, _, after = NOTES[name].partition("{}")
    return F.lit(before) if value is None else F.concat(F.lit(before), value.cast("string"), F.lit(after))


def _summary() -> list[Column]:
    flag = lambda v: F.count_if(F.col("daynight") == v)
    return [
        F.count(F.lit(1)).alias("detection_count"), F.count_distinct("acq_date").alias("unique_dates"), F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date"),
        F.datediff(F.max("acq_date"), F.min("acq_date")).alias("active_span_days"), F.avg("frp").alias("mean_frp"), F.max("frp").alias("max_frp"), flag("D").alias("day_count"), flag("N").alias("night_count"),
    ]


def grid_groups(det: DataFrame, size_m: float = 375.0) -> DataFrame:
    """One row for each occupied grid cell."""
    out = det.groupBy(grid_cell(F.col("lat"), F.col("lon"), size_m).alias("cell_id")).agg(F.avg("lat").alias("la"), F.avg("lon").alias("lo"), *_summary())
    return out.select("cell_id", S.settled("la", 6).alias("cell_lat_center"), S.settled("lo", 6).alias("cell_lon_center"), "detection_count", "unique_dates", "first_date", "last_date", "active_span_days",
                      S.settled("mean_frp", 4).alias("mean_frp"), "max_frp", "day_count", "night_count")


def top_cells(groups: DataFrame, n: int = 20) -> DataFrame:
    return groups.orderBy(F.desc("unique_dates"), "cell_id").limit(n)


def occupied_cells(det: DataFrame, scales: tuple[int, ...] = (100, 250, 375, 500, 1000)) -> DataFrame:
    """Occupied cells and detections a cell at each scale."""
    cell = lambda m: F.struct(F.lit(m).alias("scale_m"), grid_cell(F.col("lat"), F.col("lon"), m).alias("cell"))
    each = det.select(F.explode(F.array(*map(cell, scales))).alias("x")).select("x.*").groupBy("scale_m", "cell").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("scale_m").agg(F.count(F.lit(1)).alias("occupied_cells"), F.round(F.avg("n"), 4).alias("mean_per_cell"), F.max("n").alias("max_per_cell"))


def cluster_stats(labelled: DataFrame) -> DataFrame:
    """One row for each cluster; noise (-1) is left out. The extent is the farthest member from the centroid."""
    members = labelled.filter(F.col("cluster_id") != -1)
    base = members.groupBy("cluster_id").agg(F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"), *_summary(), F.min("lat").alias("bbox_min_lat"), F.max("lat").alias("bbox_max_lat"), F.min("lon").alias("bbox_min_lon"), F.max("lon").alias("bbox_max_lon"))
    centres = base.select(F.col("cluster_id").alias("_c"), F.col("centroid_lat").alias("_la"), F.col("centroid_lon").alias("_lo"))
    extent = members.join(centres, F.col("cluster_id") == F.col("_c")).groupBy("_c").agg(F.max(haversine(F.col("lat"), F.col("lon"), F.col("_la"), F.col("_lo"))).alias("extent_radius_m"))
    return base.join(extent, F.col("cluster_id") == F.col("_c")).drop("_c")


def cross_date_distances(members: DataFrame, key: str) -> DataFrame:
    """(key, n_pairs, min_m, median_m, max_m) over all pairs of points of different dates in each group.

    Points at one place are compared once: a pair of places stands for as many pairs of points as have different dates,
    and a place for its own at no distance. The join of a group's places is split if one group has most of them.
    """
    spots = stored(members.groupBy(key, "lat", "lon", "acq_date").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("_first")), "spots")
    named = stored(spots.groupBy(key, "lat", "lon").agg(F.min("_first").alias("p"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("same")), "places")
    other = named.select(F.col(key).alias("_k"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("p").alias("q"), F.col("N").alias("M"))
    pairs = named.join(other, (F.col(key) == F.col("_k")) & (F.col("p") < F.col("q"))).select(key, "p", "q", haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")).alias("metres"), (F.col("N") * F.col("M")).alias("w"))
    dated = spots.join(named.select(F.col(key).alias("_k"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "p"), (F.col(key) == F.col("_k")) & (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon"))).select(key, "acq_date", "p", "n")
    dated = stored(dated, "dated")
    again = dated.select(F.col(key).alias("_k"), F.col("acq_date").alias("_d"), F.col("p").alias("q"), F.col("n").alias("m"))
    together = dated.join(again, (F.col(key) == F.col("_k")) & (F.col("acq_date") == F.col("_d")) & (F.col("p") < F.col("q"))).groupBy(F.col(key).alias("_k"), F.col("p").alias("_p"), F.col("q").alias("_q")).agg(F.sum(F.col("n") * F.col("m")).alias("_w"))
    left = pairs.join(together, (F.col(key) == F.col("_k")) & (F.col("p") == F.col("_p")) & (F.col("q") == F.col("_q")), "left").select(key, "metres", (F.col("w") - F.coalesce("_w", F.lit(0))).alias("w"))
    own = named.select(key, F.lit(0.0).alias("metres"), ((F.col("N") * F.col("N") - F.col("same")) / 2).cast("long").alias("w"))
    weighed = stored(left.unionByName(own).filter("w > 0"), "distances")
    ends = weighed.groupBy(key).agg(F.sum("w").alias("n_pairs"), F.round(F.min("metres"), 2).alias("min_m"), F.round(F.max("metres"), 2).alias("max_m"))
    middle = quantiles(weighed, key, "metres", {"median_m": 0.5}, "w").select(F.col(key).alias("_k"), F.round("median_m", 2).alias("median_m"))
    return ends.join(middle, F.col(key) == F.col("_k")).select(key, "n_pairs", "min_m", "median_m", "max_m")


def date_metrics(labelled: DataFrame, stats: DataFrame) -> DataFrame:
    """Detections an active date, occurrence rate, night share, power ratio, shares of the busiest day and three days."""
    daily = labelled.filter(F.col("cluster_id") != -1).groupBy("cluster_id", "acq_date").agg(F.count(F.lit(1)).alias("n"))
    ranked = daily.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "acq_date")))
    top = ranked.groupBy(F.col("cluster_id").alias("_c")).agg(F.sum(F.when(F.col("rank") == 1, F.col("n")).otherwise(0)).alias("t1"), F.sum(F.when(F.col("rank") <= 3, F.col("n")).otherwise(0)).alias("t3"))
    n = F.col("detection_count")
    return stats.join(top, F.col("cluster_id") == F.col("_c")).drop("_c").withColumns(
        {
            "detections_per_active_date": n / F.col("unique_dates"), "occurrence_rate": F.col("unique_dates") / (F.col("active_span_days") + 1), "night_fraction": F.col("night_count") / n,
            "frp_ratio": F.try_divide(F.col("max_frp"), F.col("mean_frp")), "top_day_share": F.col("t1") / n, "top3_days_share": F.col("t3") / n,
        }
    ).drop("t1", "t3")


def recurrence_profile(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({"recurrence_strength": S.recurrence_strength(F.col("unique_dates")), "short_window_recurrence": S.short_window(F.col("active_span_days")), "burst_concentrated": S.burst_concentrated(F.col("top3_days_share"))})


def cross_year(definitions: DataFrame, assigned: DataFrame) -> DataFrame:
    """Years with detections of every cluster: counts over all years, the summary over SUMMARY_YEARS; clusters without rows have zeros."""
    yearly = assigned.filter(F.col("cluster_id") != -1).groupBy("cluster_id", "year").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("acq_date").alias("days"))
    entry = lambda c: S.format_counts(F.collect_list(F.struct(F.col("year").alias("key"), F.col(c).alias("count"))))  # noqa: E731  an entry for each year
    inside = F.col("year").isin(*SUMMARY_YEARS)
    years = F.array_sort(F.collect_list(F.when(inside, F.col("year"))))
    found = yearly.groupBy(F.col("cluster_id").alias("_c")).agg(entry("n").alias("counts"), entry("days").alias("days"), years.alias("years"))
    n = F.coalesce(F.size("years"), F.lit(0))
    n = F.when(F.col("years").isNull(), 0).otherwise(n)
    return definitions.select("cluster_id").join(found, F.col("cluster_id") == F.col("_c"), "left").select(
        "cluster_id", F.coalesce(F.array_join("years", ";"), F.lit("")).alias("years_detected"), n.alias("unique_years"), F.array_min("years").alias("first_year"), F.array_max("years").alias("last_year"), (n >= 2).alias("recurs_across_multiple_years"),
        F.coalesce("counts", F.lit("")).alias("per_year_detection_counts"), F.coalesce("days", F.lit("")).alias("per_year_unique_dates"),
    )


def longitudinal(years: DataFrame, assigned: DataFrame) -> DataFrame:
    """Annual counts and statistics, trend, months and seasonality of every cluster in `cross_year` rows."""
    counts, days = S.parse_counts(F.col("per_year_detection_counts")), S.parse_counts(F.col("per_year_unique_dates"))
    each = years.withColumns({"_n": counts, "_d": days})
    for y in (*SUMMARY_YEARS, *LATER_YEARS):
        each = each.withColumns({f"detections_{y}": F.coalesce(F.try_element_at("_n", F.lit(y)), F.lit(0)), f"active_days_{y}": F.coalesce(F.try_element_at("_d", F.lit(y)), F.lit(0))})
    cols = [F.col(f"detections_{y}") for y in SUMMARY_YEARS]
    k = len(cols)
    total = sum(cols[1:], cols[0])
    mean = total / F.lit(float(k))
    squares = sum(((c - mean) * (c - mean) for c in cols), F.lit(0.0))
    centre = (k - 1) / 2
    slope = sum((c * (i - centre) for i, c in enumerate(cols)), F.lit(0.0)) / sum((i - centre) ** 2 for i in range(k))
    each = each.withColumns({"total_detections_5yr": total.cast("long"), "mean_annual_detections": mean, "std_annual_detections": F.sqrt(squares / (k - 1)), "trend_slope": slope})
    each = each.withColumns(
        {
            "cv_annual_detections": F.coalesce(F.try_divide(F.col("std_annual_detections"), F.col("mean_annual_detections")), F.lit(0.0)),
            "trend_direction": F.when((F.col("mean_annual_detections") == 0) | (F.abs("trend_slope") < 0.10 * F.col("mean_annual_detections")), "stable").when(F.col("trend_slope") > 0, "increasing").otherwise("decreasing"),
        }
    )
    inside = assigned.filter((F.col("cluster_id") != -1) & F.col("year").isin(*SUMMARY_YEARS))
    monthly = inside.groupBy(F.col("cluster_id").alias("_c")).agg(*(F.count_if(F.month("acq_date") == m).cast("int").alias(f"_m{m}") for m in MONTHS))
    filled = each.join(monthly, F.col("cluster_id") == F.col("_c"), "left").withColumn("_months", F.array(*(F.coalesce(f"_m{m}", F.lit(0)) for m in MONTHS)))
    top3 = F.aggregate(F.slice(F.sort_array("_months", False), 1, 3), F.lit(0), lambda a, x: a + x)
    whole = F.aggregate("_months", F.lit(0), lambda a, x: a + x)
    return filled.select(
        *[c for c in years.columns], *(f"detections_{y}" for y in (*SUMMARY_YEARS, *LATER_YEARS)), *(f"active_days_{y}" for y in (*SUMMARY_YEARS, *LATER_YEARS)),
        "total_detections_5yr", F.round("mean_annual_detections", 6).alias("mean_annual_detections"), F.round("std_annual_detections", 6).alias("std_annual_detections"), F.round("cv_annual_detections", 6).alias("cv_annual_detections"),
        F.round("trend_slope", 6).alias("trend_slope"), "trend_direction",
        F.array_join(F.transform("_months", lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x.cast("string"))), ";").alias("per_month_detection_counts"),
        F.round(F.coalesce(F.try_divide(top3, whole), F.lit(0.0)), 6).alias("top3_months_share"), F.when(whole > 0, F.array_position("_months", F.array_max("_months")).cast("int")).alias("dominant_month"),
    )


def integrated(rows: DataFrame) -> DataFrame:
    """Categories against the median and upper quartile of all clusters, and notes where independent evidence disagrees."""
    cut = rows.agg(F.percentile("total_detections_5yr", F.lit(0.5)), F.percentile("top3_months_share", F.lit(0.75))).first()
    median, p75 = (F.round(F.lit(v).cast("double"), 9) for v in cut)
    persistence, activity = S.persistence_category(F.col("unique_years")), S.activity_category(F.col("total_detections_5yr"), median)
    years, strength = F.col("unique_years"), F.col("recurrence_strength")
    named_industry = F.coalesce(F.col("nearest_is_named") & (F.col("nearest_group") == "industrial"), F.lit(False))
    notes = F.concat_ws(
        "; ",
        F.when(strength.isin("Moderate", "Limited") & (years == 5), note("understated", strength)),
        F.when((strength == "Strong") & (years < 5), note("one_year", years)),
        F.when(F.col("short_window_recurrence") & (F.col("top3_months_share") < 0.5), note("short_window")),
        F.when((F.col("features_found_in_radius") == 0) & (years == 5), note("no_context")),
        F.when(named_industry & (F.col("total_detections_5yr") < median), note("named_but_quiet", F.coalesce("nearest_name", F.lit("")))),
    )
    return rows.withColumns(
        {
            "persistence_category": persistence, "activity_category": activity, "persistence_activity_quadrant": F.concat(persistence, F.lit(" / "), activity),
            "seasonality_category": S.seasonality_category(F.col("top3_months_share"), p75), "has_notable_osm_context": F.col("features_found_in_radius") > 0, "evidence_notes": notes,
        }
    )


def intelligence(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Integrated rows with the discovered group, for reference only, and how many of three independent signs agree."""
    signs = {"corroboration_2023_recurrence": F.col("recurrence_strength").isin("Strong", "Moderate"), "corroboration_5yr_persistence": F.col("unique_years") == 5, "corroboration_osm_context": F.col("has_notable_osm_context")}
    return rows.join(groups.select("cluster_id", "unsupervised_group"), "cluster_id").withColumns(signs).withColumn("evidence_corroboration_count", sum((F.col(s).cast("int") for s in signs), F.lit(0)))


def deep_dive(rows: DataFrame) -> DataFrame:
    """Outlier flags, example definitions and contradiction notes of every cluster."""
    cut = rows.agg(F.percentile("unique_dates", F.lit(0.5)), F.percentile("occurrence_rate", F.lit(0.25)), F.percentile("active_span_days", F.lit(0.75))).first()
    median, p25, p75 = (F.round(F.lit(v).cast("double"), 9) for v in cut)
    flagged = rows.join(iqr_flags(rows, "cluster_id", OUTLIER_METRICS), "cluster_id")
    meets = {f"meets_illustrative__{n}": rule() for n, rule in DEFINITIONS}
    out = flagged.withColumns(meets).withColumn("n_illustrative_defs_satisfied", sum((F.col(f"`{m}`").cast("int") for m in meets), F.lit(0)))
    n, pattern = F.col("n_illustrative_defs_satisfied"), S.day_night_pattern(F.col("night_fraction"))
    named_industry = F.coalesce(F.col("nearest_is_named") & (F.col("nearest_group") == "industrial"), F.lit(False))
    notes = F.concat_ws(
        "; ",
        F.when(pattern != "mostly_night", note("day_night", pattern)),
        F.when(F.col("top_day_share") > 0.5, note("one_day")).when(F.col("top3_days_share") > 0.5, note("three_days")),
        F.when(F.col("outlier_frp_ratio"), note("peak")),
        F.when((F.col("active_span_days") >= p75) & (F.round("occurrence_rate", 9) <= p25), note("sparse")),
        F.when((F.col("features_found_in_radius") == 0) & (F.col("unique_dates") > median), note("busy_without_context")),
        F.when(named_industry & (F.col("unique_dates") < median), note("named_but_rare")),
        F.when(F.col("n_metrics_outlier") >= 3, note("several", F.col("n_metrics_outlier"))),
        F.when(n.between(1, len(DEFINITIONS) - 1), note("definitions", n)),
    )
    bucket = S.map_context_bucket(F.col("features_found_in_radius"), F.col("nearest_group"), F.coalesce("nearest_is_named", F.lit(False)))
    return out.withColumns({"day_night_pattern": pattern, "osm_context_bucket": bucket, "contradiction_notes": notes})
