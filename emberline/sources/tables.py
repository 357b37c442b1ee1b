"""Loaders of processed tables and point layers: declared columns, cast strictly, with a unique key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import unique
from .ingest import check_body, parse_csv, thermal_plants

#: The columns that a plant has in its source, of those that are kept.
PLANT_COLUMNS = ("name", "gppd_idnr", "capacity_mw", "latitude", "longitude", "primary_fuel", "commissioning_year", "country")


def load(spark: SparkSession, path: str, columns: dict[str, str], key: str | None = None, form: str | None = None) -> DataFrame:
    """The declared columns of a Parquet or headed CSV table, as their types. A column that is missing, a cell that doesn't parse and a
    key that repeats fail the job; in text, an empty cell is null and flags are `true` or `false` in any case."""
    kind = form or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path) if kind == "csv" else spark.read.format(kind).load(path)
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    text = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) if dict(rows.dtypes)[c] == "string" else F.col(c)
    out = rows.select(*(text(c).cast(t).alias(c) if t != "string" else F.col(c).cast("string").alias(c) for c, t in columns.items()))
    return unique(out, key) if key else out


def points(spark: SparkSession, path: str, lat: str = "lat", lon: str = "lon", carry: dict[str, str] | None = None) -> DataFrame:
    """(lat, lon, ...carried columns) of a layer of points; one without a place on the globe fails the job."""
    rows = load(spark, path, {lat: "double", lon: "double", **(carry or {})}).withColumnsRenamed({lat: "lat", lon: "lon"})
    good = F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False))
    return rows.withColumn("lat", F.when(good, F.col("lat")).otherwise(F.raise_error(F.lit("a point without a place")).cast("double")))


def fetch_plants(spark: SparkSession, path: str, url: str, get: Callable[[str], tuple[int, str]], force: bool = False) -> DataFrame:
    """The thermal plants of the area, fetched once: a table of the country's plants, filtered and staged. A bad answer raises and
    stages nothing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if force or not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        names, rows = parse_csv(check_body(*get(url)))
        missing = [c for c in PLANT_COLUMNS if c not in names]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        frame = spark.createDataFrame([tuple(r[c] for c in PLANT_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in PLANT_COLUMNS))
        thermal_plants(frame).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
