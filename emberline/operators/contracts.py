"""Checks that fail a job, or report what breaks a rule, before rows are used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored


class ContractError(ValueError):
    """A table breaks what its users rely on."""


def unique(df: DataFrame, key: str, expected: int | None = None) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d")).first()
    if row["n"] != row["d"]:
        raise ContractError(f"{row['n'] - row['d']} rows repeat or lack {key}")
    if expected is not None and row["n"] != expected:
        raise ContractError(f"{row['n']} rows of {key}; {expected} are expected")
    return df


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two tables has."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    return left.unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("extra")))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> None:
    found = stored(key_differences(a, b, key), "differences")
    counts = found.groupBy("side").agg(F.count(F.lit(1)).alias("n")).orderBy("side").collect()  # two rows at most
    if counts:
        some = {r["side"]: [x[0] for x in found.filter(F.col("side") == r["side"]).select(key).orderBy(key).limit(10).collect()] for r in counts}
        raise ContractError("; ".join(f"{r['side']} {r['n']}: {some[r['side']]}" for r in counts))


def differing(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(key, column): where shared numbers of two tables differ by more than the tolerance."""
    joined = a.select(key, *columns).join(b.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns)), F.col(key) == F.col("_k"))
    bad = F.filter(F.array(*(F.when(~F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.col(c).isNull() & F.col(f"_{c}").isNull()), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return joined.select(key, F.explode(bad).alias("column"))


def consistent(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: float = 1e-6) -> None:
    first = differing(a, b, key, columns, tolerance).first()
    if first:
        raise ContractError(f"{first['column']} differs for {key} {first[key]}")


def aligned(a: DataFrame, b: DataFrame, columns: list[str]) -> None:
    """Two tables agree row for row on some columns."""
    if not a.select(*columns).exceptAll(b.select(*columns)).isEmpty() or not b.select(*columns).exceptAll(a.select(*columns)).isEmpty():
        raise ContractError("regenerated rows differ from stored ones")


def disjoint(features: list[str], forbidden: set[str]) -> None:
    both = sorted(set(features) & forbidden)
    if both:
        raise ContractError(f"forbidden features: {', '.join(both)}")


def inventoried(columns: list[str], included: list[str], excluded: list[str]) -> None:
    """Every column is declared included or excluded, and none both."""
    disjoint(included, set(excluded))
    odd = set(columns) ^ {*included, *excluded}
    if odd:
        raise ContractError(f"not declared, or not there: {', '.join(sorted(odd))}")
