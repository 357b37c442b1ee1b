"""What the operators on embeddings share: whole vectors as integers, and Arrow lists as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a matrix that a task works on at once.
AT_ONCE = 1 << 20


def whole(vector: Column) -> Column:
    """A vector that is there and holds no null, NaN or infinite entry."""
    bad = F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vector: Column, factor: int, plus: int = 0) -> Column:
    """floor(factor * entry) + plus of each entry, taken as a double, as an array of longs."""
    return F.transform(vector, lambda e: F.floor(F.lit(float(factor)) * e.cast("double")).cast("long") + F.lit(plus).cast("long"))


def integers(df: DataFrame, id_column: str, vector_column: str, factor: int, plus: int = 0) -> DataFrame:
    """(vec_id, x) of the whole vectors; other columns, whatever their names, are not carried."""
    v = F.col(vector_column).cast("array<double>")
    return df.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).filter(whole(F.col("v"))).select("vec_id", scaled(F.col("v"), factor, plus).alias("x"))


def matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x entries) of a column of equally long lists, some rows at a time."""
    lists = batch.column(column)
    if not len(lists):
        return
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(lists), -1)
    step = max(1, AT_ONCE // max(1, x.shape[1]))
    for at in range(0, len(x), step):
        yield at, x[at : at + step]
