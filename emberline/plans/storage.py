"""Durable cuts of a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, as in tests, a temporary folder; only on a local master, as executors elsewhere can't see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="emberline-")
    spark.sparkContext.setCheckpointDir(local)
    return f"file://{local}"


def _target(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/emberline/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and a lost executor loses nothing of it."""
    path = _target(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, *values: Column) -> tuple[DataFrame, tuple]:
    """`stored`, and the values of aggregate expressions over the rows, from what was written.

    An Observation would save the second job, but leaves a part in the session that models can't be sent to tasks with.
    """
    out = stored(df, name)
    row = out.agg(*(v.alias(f"v{k}") for k, v in enumerate(values))).first()
    return out, tuple(row)
