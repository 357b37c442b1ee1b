"""Auditable rule labels for events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown_Ambiguous"
TRAINED = ("Industrial", "Gas_Flare", "Crop_Residue", "Forest_Wildfire")


def _true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def industrial(median: Column) -> Column:
    near = _true(F.col("dist_industrial_m") <= 1000) | _true(F.col("dist_plant_m") <= 1000)
    return near & _true(F.col("night_fraction") > 0) & _true(F.col("overlap_strength").isin("Strong", "Moderate"))


def gas_flare(median: Column) -> Column:
    return _true(F.col("dist_flare_m") <= 1000) & (_true(F.col("overlap_multiyear")) | _true(F.col("mean_frp") >= median))


def brick_kiln(median: Column) -> Column:
    return _true(F.col("dist_kiln_m") <= 500) & F.month("start_date").isin(11, 12, 1, 2, 3, 4, 5) & (F.col("duration_days") <= 3)


def crop_residue(median: Column) -> Column:
    return _true(F.col("land_cover_class") == "Cropland") & (F.col("duration_days") <= 3) & F.month("start_date").isin(10, 11, 12, 4, 5)


def forest_wildfire(median: Column) -> Column:
    return _true(F.col("land_cover_class") == "Tree cover") & (F.col("duration_days") <= 3) & F.month("start_date").isin(3, 4, 5, 6)


#: (class, rule id, rule), in the order in which conflicts are listed. A registry: callers may pass their own.
RULES: list[tuple[str, str, Callable[[Column], Column]]] = [
    ("Industrial", "R1", industrial),
    ("Gas_Flare", "R2", gas_flare),
    ("Brick_Kiln", "R3", brick_kiln),
    ("Crop_Residue", "R4", crop_residue),
    ("Forest_Wildfire", "R5", forest_wildfire),
]


def silver_labels(evidence: DataFrame, rules: list[tuple[str, str, Callable[[Column], Column]]] = RULES) -> DataFrame:
    """One match gives its class; none or several give Unknown_Ambiguous, with the reason. The median of mean_frp is over all events."""
    median = evidence.agg(F.percentile("mean_frp", F.lit(0.5))).first()[0]
    at = F.lit(median).cast("double")
    hits = F.filter(F.array(*(F.when(rule(at), F.struct(F.lit(name).alias("name"), F.lit(rid).alias("rule"))) for name, rid, rule in rules)), lambda x: x.isNotNull())
    n = F.size("_hits")
    return evidence.withColumn("_hits", hits).select(
        "event_id",
        F.when(n == 1, F.get("_hits", F.lit(0))["name"]).otherwise(UNKNOWN).alias("silver_label"),
        F.when(n == 1, F.get("_hits", F.lit(0))["rule"]).alias("label_rule_id"),
        F.when(n > 1, F.array_join(F.transform("_hits", lambda x: x["name"]), ";")).alias("conflict_classes"),
        n.alias("n_classes_matched"),
        F.when(n == 0, "insufficient_evidence").when(n > 1, "conflicting_evidence").alias("ambiguity_reason"),
        (n != 1).alias("excluded_from_training"),
    )
