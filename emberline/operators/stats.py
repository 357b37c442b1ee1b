"""Statistics with the corner cases pinned down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import settled


def safe_corr(x: Column, y: Column, on_constant: float | None = None) -> Column:
    """Pearson's r by sums; `on_constant` where either side has no variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    vx, vy = F.var_pop(a), F.var_pop(b)
    return F.when((vx > 1e-18) & (vy > 1e-18), F.covar_pop(a, b) / F.sqrt(F.greatest(vx * vy, F.lit(1e-300)))).otherwise(F.lit(on_constant).cast("double"))


#: Buckets of a group's range in rank_select.
BUCKETS = 1024


def rank_select(df: DataFrame, group: str, value: str, ranks: Column, weight: str | None = None) -> DataFrame:
    """(group, n, rank, value): the values at the ranks (from 0) of each group's sorted values, without a task that holds a group.

    Values are counted in BUCKETS equal parts of the group's range; only the buckets that hold a rank are counted value by value.
    ranks: an array of longs made from the column `n`, the number of the group's values. weight: a column of counts. The frame is
    read three times.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    span = rows.groupBy("_g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("w").alias("n")).select(F.col("_g").alias("_s"), "low", "high", "n")
    share = F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low"))
    placed = rows.join(span, F.col("_g").eqNullSafe(F.col("_s"))).withColumn("bucket", F.coalesce(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)), F.lit(0)).cast("int"))
    sizes = placed.groupBy("_g", "bucket").agg(F.sum("w").alias("c"), F.max("n").alias("n"))
    before = Window.partitionBy("_g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))  # BUCKETS rows a group
    wanted = starts.withColumn("rank", F.explode(F.array_distinct(ranks))).filter((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("c")))
    wanted = wanted.select(F.col("_g").alias("_w"), F.col("bucket").alias("_b"), "n", "rank", (F.col("rank") - F.col("start")).alias("inside"))
    here = F.col("_g").eqNullSafe(F.col("_w")) & (F.col("bucket") == F.col("_b"))
    counted = placed.join(wanted.select("_w", "_b").distinct(), here, "left_semi").groupBy("_g", "bucket", "v").agg(F.sum("w").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_g", "bucket").orderBy("v"))
    found = counted.withColumn("upto", upto).join(wanted, here & (F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("c")))
    return found.select(F.col("_g").alias(group), "n", "rank", F.col("v").alias("value"))


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float], weight: str | None = None) -> DataFrame:
    """(group, a column for each name in shares): quantiles with linear interpolation between neighbours, by `rank_select`."""
    at = lambda q: F.lit(q) * (F.col("n") - 1)
    ranks = F.array(*(f(at(q)).cast("long") for q in shares.values() for f in (F.floor, F.ceil)))
    found = rank_select(df, group, value, ranks, weight)
    pick = lambda rank: F.max(F.when(F.col("rank") == rank.cast("long"), F.col("value")))
    parts = {name: (pick(F.floor(at(q))), pick(F.ceil(at(q))), F.max(at(q) - F.floor(at(q)))) for name, q in shares.items()}
    return found.groupBy(group).agg(*((low + (high - low) * part).alias(name) for name, (low, high, part) in parts.items()))


def quantile_summary(df: DataFrame, column: str) -> DataFrame:
    """min, quartiles with linear interpolation, max, mean, and p90 as the value at position int(0.9 (n - 1))."""
    values = df.filter(F.col(column).isNotNull()).select(F.lit(0).alias("_all"), F.col(column).cast("double").alias("v"))
    plain = values.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("v"), 6).alias("min"), F.round(F.max("v"), 6).alias("max"), F.round(F.avg("v"), 6).alias("mean"))
    at = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    place = F.floor((F.col("n") - 1) * 0.9).cast("long")
    ranks = F.array(*(f(F.lit(q) * (F.col("n") - 1)).cast("long") for q in at.values() for f in (F.floor, F.ceil)), place)
    found = rank_select(values, "_all", "v", ranks)
    pick = lambda rank: F.max(F.when(F.col("rank") == rank.cast("long"), F.col("value")))
    columns = []
    for name, q in at.items():
        x = F.lit(q) * (F.col("n") - 1)
        low, high, part = pick(F.floor(x)), pick(F.ceil(x)), F.max(x - F.floor(x))
        columns.append(F.round(low + (high - low) * part, 6).alias(name))
    picked = found.agg(*columns, F.round(pick(place), 6).alias("p90"))
    return plain.join(picked).select("n", "min", "p25", "median", "p75", "max", "mean", "p90")  # one row each


def correlation_audit(df: DataFrame, target: str, fields: list[str], limit: float = 0.8) -> DataFrame:
    """(field, r, safe): r of every field with the target over rows where both are given; safe if |r| <= limit."""
    row = df.agg(*(safe_corr(F.col(f), F.col(target)).alias(f) for f in fields))
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.round(f, 4).alias("r")) for f in fields))).alias("p")
    return row.select(pairs).select("p.field", "p.r", F.coalesce(F.abs("p.r") <= limit, F.lit(True)).alias("safe"))


def correlation_pairs(df: DataFrame, fields: list[str], limit: float = 0.9) -> DataFrame:
    """(a, b, r, independent): r of every pair of fields over rows where both are given; independent if |r| <= limit."""
    pairs = [(a, b) for k, a in enumerate(fields) for b in fields[k + 1 :]]
    row = df.agg(*(safe_corr(F.col(a), F.col(b)).alias(f"_{k}") for k, (a, b) in enumerate(pairs)))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"_{k}", 4).alias("r")) for k, (a, b) in enumerate(pairs)))).alias("p")
    return row.select(each).select("p.a", "p.b", "p.r", F.coalesce(F.abs("p.r") <= limit, F.lit(True)).alias("independent"))


def class_means(df: DataFrame, label: str, fields: list[str]) -> DataFrame:
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *(settled(F.avg(f), 4).alias(f"mean_{f}") for f in fields), *(F.round(F.percentile(f, F.lit(0.5)), 4).alias(f"median_{f}") for f in fields)
    )


def largest_gaps(df: DataFrame, column: str, top: int, group: str) -> DataFrame:
    """The largest gaps between neighbours of each group's sorted different values, by gap and then value before, falling.

    Neighbours meet within BUCKETS equal parts of the group's range; between parts, the largest value of one and the
    smallest of the next that has any. So no task sorts all values of a group.
    """
    distinct = df.select(F.col(group).alias("_g"), F.col(column).alias("v")).filter(F.col("v").isNotNull()).distinct()
    span = distinct.groupBy("_g").agg(F.min("v").alias("low"), F.max("v").alias("high")).select(F.col("_g").alias("_s"), "low", "high")
    share = F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low"))
    placed = distinct.join(span, F.col("_g").eqNullSafe(F.col("_s"))).select("_g", "v", F.coalesce(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)), F.lit(0)).cast("int").alias("bucket"))
    inner = placed.withColumn("before", F.lag("v").over(Window.partitionBy("_g", "bucket").orderBy("v"))).select("_g", "before", F.col("v").alias("after"))
    ends = placed.groupBy("_g", "bucket").agg(F.min("v").alias("after"), F.max("v").alias("_last"))  # BUCKETS rows a group
    outer = ends.withColumn("before", F.lag("_last").over(Window.partitionBy("_g").orderBy("bucket"))).select("_g", "before", "after")
    gaps = inner.unionByName(outer).filter(F.col("before").isNotNull()).withColumn("gap", F.col("after") - F.col("before"))
    # the top of each part first, so that the last ranking has few rows
    part = F.row_number().over(Window.partitionBy("_g", F.pmod(F.xxhash64("after"), F.lit(256))).orderBy(F.desc("gap"), F.desc("before")))
    some = gaps.withColumn("_rank", part).filter(F.col("_rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("gap"), F.desc("before"))))
    return ranked.filter(F.col("rank") <= top).select(F.col("_g").alias(group), "before", "after", "gap", "rank")


def iqr_flags(df: DataFrame, key: str, metrics: list[str], factor: float = 1.5) -> DataFrame:
    """key, outlier_<metric> for each, and how many: outside the quartiles by more than factor times their distance."""
    bounds = df.agg(*(F.percentile(m, F.array(F.lit(0.25), F.lit(0.75))).alias(f"_{m}") for m in metrics)).first()
    flags = {}
    for m in metrics:
        low, high = bounds[f"_{m}"] or (None, None)
        out = F.lit(None).cast("boolean") if low is None else (F.col(m) < low - factor * (high - low)) | (F.col(m) > high + factor * (high - low))
        flags[f"outlier_{m}"] = F.coalesce(out, F.lit(False))
    many = sum((f.cast("int") for f in flags.values()), F.lit(0))
    return df.select(key, *(f.alias(n) for n, f in flags.items()), many.alias("n_metrics_outlier"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings, from their contingency table."""
    table = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    choose = lambda x: x * (x - 1) / 2
    side = lambda c: table.groupBy(c).agg(F.sum("n").alias("n"))
    n = table.agg(F.sum("n").alias("N"), F.sum(choose(F.col("n"))).alias("both"), F.sum(F.col("n") * F.log("n")).alias("hab"))
    sa = side(a).agg(F.sum(choose(F.col("n"))).alias("pa"), F.sum(F.col("n") * F.log("n")).alias("ha"))
    sb = side(b).agg(F.sum(choose(F.col("n"))).alias("pb"), F.sum(F.col("n") * F.log("n")).alias("hb"))
    one = n.join(sa).join(sb)  # one row each
    N = F.col("N")
    expected = F.try_divide(F.col("pa") * F.col("pb"), choose(N))
    ari = F.try_divide(F.col("both") - expected, (F.col("pa") + F.col("pb")) / 2 - expected)
    ea, eb = F.log(N) - F.col("ha") / N, F.log(N) - F.col("hb") / N
    mutual = (F.col("hab") - F.col("ha") - F.col("hb")) / N + F.log(N)
    return one.select(F.round(F.coalesce(ari, F.lit(1.0)), 6).alias("ari"), F.round(F.coalesce(F.try_divide(mutual, (ea + eb) / 2), F.lit(1.0)), 6).alias("nmi"))


def classification_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support): one row a class and one, named `macro`, with their means and the accuracy."""
    each = df.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x")).select("x.*")
    hits = df.filter(F.col(label) == F.col(predicted)).groupBy(F.col(label).alias("h")).agg(F.count(F.lit(1)).alias("hit"))
    counts = each.groupBy("c").agg(F.sum("t").alias("support"), F.sum("p").alias("called")).join(hits, F.col("c") == F.col("h"), "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    precision, recall = (F.coalesce(F.try_divide(F.col("hit"), F.col(x)), F.lit(0.0)) for x in ("called", "support"))
    rows = counts.select("c", precision.alias("precision"), recall.alias("recall"), F.col("support").cast("long").alias("support"), "hit")
    rows = rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    macro = rows.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"), F.try_divide(F.sum("hit"), F.sum("support")).alias("accuracy"))
    tidy = lambda d, name, acc: d.select(name.alias("class"), *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")), "support", acc.alias("accuracy"))
    return tidy(rows, F.col("c"), F.lit(None).cast("double")).unionByName(tidy(macro, F.lit("macro"), F.round("accuracy", 6)))


def average_precision(df: DataFrame, positive: str, score: str, group: str) -> DataFrame:
    """(group, average_precision): sum of precision times gain in recall over falling scores; equal scores count together."""
    by_score = df.groupBy(group, score).agg(F.sum(F.col(positive).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(group).orderBy(F.desc(score))
    run = by_score.withColumns({"tp": F.sum("pos").over(down), "seen": F.sum("n").over(down)})
    out = run.groupBy(group).agg(F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("s"), F.sum("pos").alias("p"))
    return out.select(group, F.round(F.coalesce(F.try_divide(F.col("s"), F.col("p")), F.lit(0.0)), 6).alias("average_precision"))
