"""Ingest runs: fetch, rename, check, de-duplicate, write, and report a status for each year or source."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import ARCHIVE_END, KEY, RECENT_START, check_columns, combine, first_wins, rename, source_plan

Fetch = Callable[[str, date, date], DataFrame]
#: The year whose clusters are the baseline; it is never fetched again.
BASELINE = 2023


def area_fetch(spark: SparkSession, base: str, box: tuple[float, float, float, float], fetch: str, key_variable: str = "AREA_API_KEY") -> Fetch:
    """A fetch of raw rows through the area source: one task for each date chunk. The key is read on the driver, by its variable's name."""
    from .ingest import AreaSource

    spark.dataSource.register(AreaSource)

    def run(source: str, start: date, end: date) -> DataFrame:
        options = {"base": base, "box": ",".join(f"{x:g}" for x in box), "fetch": fetch, "key_variable": key_variable, "source": source, "start": start.isoformat(), "end": end.isoformat()}
        return spark.read.format("detection_area").options(**options).load()

    return run


def tidy(raw: DataFrame) -> DataFrame:
    """Raw rows renamed, with all required columns, the first row of each key only."""
    rows = check_columns(rename(raw))
    return first_wins(rows, KEY, [c for c in rows.columns if c not in KEY])


def two_sources(fetch: Fetch, run_date: date, year_start: date, archive_end: date = ARCHIVE_END, recent_start: date = RECENT_START) -> DataFrame:
    """A year from its archive and, from where that ends, the recent source; `viirs_source` says which. The first of equal keys stays."""
    parts = [rename(fetch(source, start, end)).withColumn("viirs_source", F.lit(source)) for source, start, end in source_plan(run_date, year_start, archive_end, recent_start)]
    rows = check_columns(combine(parts))
    return first_wins(rows, KEY, ["viirs_source", *(c for c in rows.columns if c not in (*KEY, "viirs_source"))])


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def ingest_year(spark: SparkSession, fetch: Fetch, folder: str, year: int, source: str = "archive", end: date | None = None, force: bool = False) -> dict:
    """Write a year's rows once, as a partition `year=`: `written`, `skipped` where it is there (unless forced), `no_data`, or
    `failed` with the reason. A wrong setting (no key, a wrong column) raises: it would fail for every year."""
    path = f"{folder.rstrip('/')}/year={year}"
    if not force and _there(spark, path):
        return {"year": year, "status": "skipped", "rows": None, "reason": None}
    raw = rename(fetch(source, date(year, 1, 1), end or date(year, 12, 31)))
    check_columns(raw)
    try:
        rows = tidy(raw).drop("viirs_source", "year")
        if rows.isEmpty():
            return {"year": year, "status": "no_data", "rows": 0, "reason": None}
        rows.write.mode("overwrite").parquet(path)
    except Exception as e:
        return {"year": year, "status": "failed", "rows": None, "reason": f"{type(e).__name__}: {str(e)[:200]}"}
    return {"year": year, "status": "written", "rows": spark.read.parquet(path).count(), "reason": None}


def ingest_years(spark: SparkSession, fetch: Fetch, folder: str, years: list[int], force: bool = False, baseline: int = BASELINE) -> DataFrame:
    """(year, status, rows, reason) of a run over years. The baseline year is never fetched again once it is there."""
    found = [ingest_year(spark, fetch, folder, y, force=force and y != baseline) for y in years]
    return spark.createDataFrame([(r["year"], r["status"], r["rows"], r["reason"]) for r in found], "year int, status string, rows long, reason string")


def read_year(spark: SparkSession, folder: str, year: int) -> DataFrame:
    """One year of the ingested table; other years' partitions aren't read."""
    return spark.read.parquet(folder).filter(F.col("year") == year)


def read_years(spark: SparkSession, folder: str, years: list[int]) -> DataFrame:
    return spark.read.parquet(folder).filter(F.col("year").isin(*years))
