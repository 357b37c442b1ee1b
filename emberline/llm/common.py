"""What the corpus operators share: table reading, shared storage, gapless ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import shared_folder, stored  # noqa: F401


#: Rows of an Arrow batch where the session says nothing: Spark's own 10,000 are over 30 MB of texts, held by the JVM and the worker several times.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SPARK_ROWS = "10000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the folder may be in any store that Spark reads.

    A session with Spark's own length of Arrow batches gets BATCH_ROWS, as texts are long; another length stays.
    """
    if spark.conf.get(_BATCH, _SPARK_ROWS) == _SPARK_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def anew_text(name: str) -> Column:
    """A string column's value as a new expression; see `operators.graph.anew`."""
    return F.concat(F.col(name), F.lit(""))


def utf8(text: Column | str) -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")


def rank_buckets(rows: int, per_bucket: int = 20_000, least: int = 64) -> int:
    """Buckets for gapless_rank: a function of the row count alone."""
    return max(least, -(-rows // per_bucket))


def gapless_rank(df: DataFrame, group: str, key: Column, order: list, buckets: int, out: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without a gap, although one group may hold most rows.

    A group is cut into buckets by a hash of `key` and of the partition of the scan that a row comes from, so rows that are equal throughout
    are dealt out too; rows are numbered inside a (group, bucket), and the counts of the buckets before it, summed over one small row
    for each (group, bucket), are added. Numbers follow (bucket, order). df: as `stored` gives it, since its partitions are read
    twice and must be the same ones.
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(key, F.spark_partition_id()), F.lit(buckets)))
    sizes = bucketed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("_group"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_start"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    numbered = bucketed.withColumn("_in", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(out, (F.col("_start") + F.col("_in")).cast("long")).drop("_group", "_b", "_bucket", "_start", "_in")


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % folds


def marked(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(_doc, y): every label of 0 or 1 of the training folds, once for each doc_id; 1 if one label of it says so."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y")).select(F.col("doc_id").alias("_doc"), "y")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, text, y): every labelled training row, once for each doc_id: of several texts of one doc_id the smallest counts."""
    rows = marked(labels, label, folds, held_out)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(rows.hint("merge"), F.col("doc_id") == F.col("_doc"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def unused(name: str, columns: list[str]) -> str:
    """`name`, with underscores before it until no column has it (in any case of letters)."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name = "_" + name
    return name
