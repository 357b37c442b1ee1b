"""The corpus pipeline: five stages, each written as Parquet in the shared folder and read again by the next one.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of
their input, extra ones included, whatever their names. Models are trained on labelled rows of the stage's own input.
Rows are judged as rows: rows that share a doc_id, or have none, are kept or dropped each by its own text. An empty table
gives an empty table in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import decontamination, packing, quality, simhash, toxicity
from emberline.llm.common import stored, table, unused
from emberline.operators.graph import merged


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic (a score of 0.5 or more) go.

    Null and empty texts score the intercept; repeated rows share their fate.
    """
    model, out = toxicity.train(docs, table(spark, sf_dir, "labels")), unused("score", docs.columns)
    return toxicity.score(docs, model, tuple(docs.columns), out).filter(F.col(out) < 0.5).drop(out)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that rank below the quality cut (a score under 0.5) go.

    Null and empty texts have the features of no words; repeated rows share their fate.
    """
    model, out = quality.train(docs, table(spark, sf_dir, "labels")), unused("score", docs.columns)
    return quality.score(docs, model, tuple(docs.columns), out).filter(F.col(out) >= 0.5).drop(out)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that with the smallest doc_id (null last), of equal ones the first.

    Rows that share a doc_id but not their group each stay. Null and empty texts are one group. Rows get a number of their
    own, which is written with them, so that it stays the same.
    """
    row, fp = unused("_row", docs.columns), unused("_fp", docs.columns)
    rows = stored(simhash.with_fingerprint(docs.withColumn(row, F.monotonically_increasing_id()), fp), "rows")
    return rows.join(merged(simhash.first_rows(rows, fp, row)), row, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text; null and empty texts hold none."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of training sequences; repeated rows and null and empty texts are packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The classifiers and the packing plan can't be said in SQL; a brute-force version tests the rows.
ORACLE_SQL = None
