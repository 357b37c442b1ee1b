"""Report tables: counts by key, crosstabs, histograms, medians by bucket, and top lists with a minimum of support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .events import global_rank
from .stats import quantiles


def counts_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """(field, value, n): for each of some columns, how many rows have each value."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value")) for k in keys))).alias("x")
    return df.select(each).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A row for each value of `row`, a count for each of the stated values of `column`, and the total."""
    return df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values), F.count(F.lit(1)).alias("total"))


def heat(df: DataFrame, row: str, column: str, rows: list[str]) -> DataFrame:
    """(row, column, n) for every pair of a stated row and a value of `column`, pairs without rows as 0; ordered by the stated rows."""
    kinds = F.array(*map(F.lit, rows))
    each = df.select(F.col(column).cast("string").alias(column)).filter(F.col(column).isNotNull()).distinct().select(column, F.posexplode(kinds).alias("_at", row))
    counts = df.groupBy(F.col(row).cast("string").alias("_row"), F.col(column).cast("string").alias("_column")).agg(F.count(F.lit(1)).alias("n"))
    met = each.join(counts, (F.col(row) == F.col("_row")) & (F.col(column) == F.col("_column")), "left")
    return met.orderBy("_at", column).select(row, column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def marks(df: DataFrame, x: str, y: str, series: str) -> DataFrame:
    """(series, x, y, n): the different marks of a scatter plot, and how many rows each stands for."""
    return df.groupBy(series, x, y).agg(F.count(F.lit(1)).alias("n"))


def positions(df: DataFrame, coarse: str, order: list[str], out: str = "position") -> DataFrame:
    """Rows with their place from 0 in the order (coarse, *order), found without one task for all rows. `order` should end in
    a key, so that equal rows keep one order."""
    return global_rank(df, coarse, order, out)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, low, high, n): counts in equal bins of [low, high]; the last bin holds its upper end. Bins without rows are left out."""
    width = (high - low) / bins
    inside = df.filter(F.col(value).between(low, high))
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    return inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", F.round(F.lit(low) + F.col("bin") * width, 9).alias("low"), F.round(F.lit(low) + (F.col("bin") + 1) * width, 9).alias("high"), "n")


def medians_by(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, median)"""
    each = df.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields))).alias("x")).select(F.struct(F.col(key).alias("k"), F.col("x.field").alias("f")).alias("g"), "x.value")
    return quantiles(each, "g", "value", {"median": 0.5}).select(F.col("g.k").alias(key), F.col("g.f").alias("field"), F.round("median", 4).alias("median"))


def top_list(df: DataFrame, name: str, key: str, metric: str, k: int, support: Column | None = None, falling: bool = True) -> DataFrame:
    """(list, rank, key, value): the k rows with the largest (or smallest) metric among those with enough support; ties by key."""
    kept = df if support is None else df.filter(support)
    order = (F.desc("value") if falling else F.asc("value"), F.col(key))
    few = kept.select(F.col(key), F.col(metric).cast("double").alias("value")).orderBy(*order).limit(k)
    ranked = few.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows
    return ranked.select(F.lit(name).alias("list"), "rank", key, F.round("value", 6).alias("value"))
