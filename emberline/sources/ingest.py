"""Ingestion: scans, renames, contracts, merges, date chunks, map elements, and a partitioned reader for an area API."""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.geo import in_area, tile_name

#: The columns of the detections' source, their names here, and the key of a detection.
RAW_COLUMNS = ("latitude", "longitude", "bright_ti4", "scan", "track", "acq_date", "acq_time", "satellite", "instrument", "confidence", "version", "bright_ti5", "frp", "daynight")
RENAMES = {"bright_ti4": "brightness", "bright_ti5": "bright_t31"}
REQUIRED = ("latitude", "longitude", "brightness", "scan", "track", "acq_date", "acq_time", "satellite", "confidence", "bright_t31", "frp", "daynight")
KEY = ("latitude", "longitude", "acq_date", "acq_time", "satellite")
#: The last day of the archive and the first of the recent source; they must touch.
ARCHIVE_END, RECENT_START = date(2026, 4, 27), date(2026, 4, 28)
CHUNK_DAYS = 5
#: Days that a run of the refresh fetches again, its own day included.
WINDOW_DAYS = 7
#: Tries of a request, with a pause before each but the first that grows with their number.
ATTEMPTS, PAUSE_S = 3, 1.5


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV with every cell as text; quotes doubled inside quotes, missing trailing cells null."""
    head = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return head.csv(path)


def rename(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in df.columns})


def check_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def bounded(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows inside the study area; rows whose coordinates are missing or don't parse are dropped."""
    return df.filter(in_area(F.expr(f"try_cast({lat} as double)"), F.expr(f"try_cast({lon} as double)")))


def typed(df: DataFrame) -> DataFrame:
    """Raw text rows as detections. Coordinates, date and power must parse: a bad cell fails the job."""
    number = lambda c: F.expr(f"cast({c} as double)")
    loose = lambda c: F.expr(f"try_cast({c} as double)") if c in df.columns else F.lit(None).cast("double")
    return df.select(
        number("latitude").alias("lat"), number("longitude").alias("lon"), F.expr("cast(acq_date as date)").alias("acq_date"), F.expr("cast(frp as double)").alias("frp"), "daynight",
        *(loose(c).alias(c) for c in ("brightness", "bright_t31", "scan", "track")), *(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("acq_time", "satellite", "confidence")),
    )


def with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.substring(F.col("acq_date").cast("string"), 1, 4).cast("int"))


def discover_years(spark: SparkSession, folder: str, pattern: str = r"_(\d{4})\.csv$", years: tuple[int, ...] | None = None) -> dict[int, str]:
    """Raw files of a folder by the year in their name; `years` keeps other years, such as the current one, out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = {}
    for status in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path):
        name = re.search(pattern, status.getPath().getName())
        if name and (years is None or int(name[1]) in years):
            found[int(name[1])] = status.getPath().toString()
    return dict(sorted(found.items()))


def combine(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with different columns; a column that a frame lacks is null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def first_wins(df: DataFrame, key: tuple[str, ...], order: list[str]) -> DataFrame:
    """The first row of each key, found by partial minima. Keys are compared as they are: as text, "21.0" and "21.00" differ.

    Rows that are equal in `order` are told apart by their other columns, and equal rows are one.
    """
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order, *(c for c in rest if c not in order)))
    return df.groupBy(*key).agg(first.alias("_first")).select(*(F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in df.columns))


def merge(existing: DataFrame, fetched: DataFrame, key: tuple[str, ...] = KEY, order: str | None = None) -> DataFrame:
    """Existing rows, and fetched ones whose key is new. Merging the same rows again adds none."""
    tagged = combine([existing.withColumn("_source", F.lit(0)), fetched.withColumn("_source", F.lit(1))])
    tie = [order] if order else [c for c in existing.columns if c not in key]
    return first_wins(tagged, key, ["_source", *tie]).drop("_source")


def date_chunks(start: date, end: date, days: int = CHUNK_DAYS) -> list[tuple[date, date]]:
    """Windows of at most `days` days that cover start..end without gap or overlap."""
    if end < start:
        raise ValueError("the range is inverted")
    out, at = [], start
    while at <= end:
        stop = min(end, at + timedelta(days=days - 1))
        out.append((at, stop))
        at = stop + timedelta(days=1)
    return out


def chunk_frame(ranges: DataFrame, days: int = CHUNK_DAYS) -> DataFrame:
    """The same for a frame of (start, end) dates."""
    starts = F.explode(F.sequence("start", "end", F.expr(f"interval {days} days"))).alias("chunk_start")
    return ranges.select("start", "end", starts).select("start", "end", "chunk_start", F.least("end", F.date_add("chunk_start", days - 1)).alias("chunk_end"))


def window_start(run_date: date, days: int, source_start: date) -> date:
    """First day of a re-fetch window that ends with run_date, not before the source begins."""
    return max(source_start, run_date - timedelta(days=days - 1))


def source_plan(run_date: date, year_start: date = date(2026, 1, 1), archive_end: date = ARCHIVE_END, recent_start: date = RECENT_START) -> list[tuple[str, date, date]]:
    """(source, first day, last day) of the current year: the archive up to its end, then the recent source."""
    if recent_start != archive_end + timedelta(days=1):
        raise ValueError("the sources leave a gap or overlap")
    if run_date < recent_start:
        raise ValueError("the run date lies before the recent source begins")
    return [("archive", year_start, archive_end), ("recent", recent_start, run_date)]


def api_key(variable: str = "AREA_API_KEY") -> str:
    key = os.environ.get(variable, "")
    if not key:
        raise RuntimeError(f"{variable} is not set")
    return key


def area_url(base: str, key: str, source: str, box: tuple[float, float, float, float], days: int, start: date) -> str:
    """box: west, south, east, north."""
    return "/".join([base.rstrip("/"), key, source, ",".join(f"{x:g}" for x in box), str(days), start.isoformat()])


def check_body(status: int, body: str) -> str:
    """A response's text; refuses error statuses and bodies that report an invalid request or key."""
    head = body[:50].lower()
    if status != 200:
        raise RuntimeError(f"status {status}")
    if body.strip().lower().startswith("invalid") or "map_key" in head:
        raise RuntimeError(f"refused: {body[:50]}")
    return body


def parse_csv(body: str) -> tuple[list[str], list[dict[str, str]]]:
    reader = csv.DictReader(io.StringIO(body))
    rows = list(reader)
    return list(reader.fieldnames or []), rows


class _Chunk(InputPartition):
    def __init__(self, start: str, days: int, key: str):
        self.start, self.days, self.key = start, days, key


def fetched_rows(options: dict[str, str], chunk: _Chunk) -> Iterator[dict[str, str]]:
    """The rows of one chunk; `fetch(url) -> (status, text)` is found by dotted name, so that tests bring their own. A request
    that breaks is made again up to ATTEMPTS times; one that is refused is not."""
    import importlib
    import time

    module, name = options["fetch"].rsplit(".", 1)
    fetch: Callable[[str], tuple[int, str]] = getattr(importlib.import_module(module), name)
    box = tuple(float(x) for x in options["box"].split(","))
    url = area_url(options["base"], chunk.key, options["source"], box, chunk.days, date.fromisoformat(chunk.start))
    pause = float(options.get("pause_s", PAUSE_S))
    for k in range(ATTEMPTS):
        try:
            status, body = fetch(url)
        except OSError:
            status, body = 0, ""
        if status not in (0, 429, 500, 502, 503, 504) or k == ATTEMPTS - 1:
            break
        time.sleep(pause * (k + 1))
    yield from parse_csv(check_body(status, body))[1]


class AreaReader(DataSourceReader):
    """One partition for each date chunk.

    The key is read on the driver from the variable that `key_variable` names, and travels with the chunks, not in the
    options, which plans and logs show.
    """

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.fieldNames(), options

    def partitions(self) -> list[InputPartition]:
        key = api_key(self.options.get("key_variable", "AREA_API_KEY"))
        start, end = (date.fromisoformat(self.options[k]) for k in ("start", "end"))
        return [_Chunk(a.isoformat(), (b - a).days + 1, key) for a, b in date_chunks(start, end)]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        for row in fetched_rows(self.options, partition):
            yield tuple(row.get(n) for n in self.names)


class AreaSource(DataSource):
    """`spark.read.format("detection_area")` over an HTTP area API."""

    @classmethod
    def name(cls) -> str:
        return "detection_area"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in RAW_COLUMNS)

    def reader(self, schema: StructType) -> DataSourceReader:
        return AreaReader(schema, dict(self.options))


class _Run(_Chunk):
    """A chunk of a batch's window, with the days after which and up to which the batch's runs are."""

    def __init__(self, start: str, days: int, key: str, after: str, last: str):
        super().__init__(start, days, key)
        self.after, self.last = after, last


class AreaStreamReader(DataSourceStreamReader):
    """Runs of the area API as a stream. An offset is the day of the last run; a batch of the runs after one day up to another
    fetches their windows together: from WINDOW_DAYS - 1 days before the first run up to the last. Offsets are kept by the
    checkpoint, so a restart goes on with the day after, and the days that it was away are within the next batch's window.

    `seen` is the day of the run that a row counts as fetched by: the last one of the batch whose window has the row's day.
    """

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.fieldNames(), options
        self.window = int(options.get("window_days", WINDOW_DAYS))

    def initialOffset(self) -> dict:
        return {"day": (date.fromisoformat(self.options["first_run"]) - timedelta(days=1)).isoformat()}

    def latestOffset(self) -> dict:
        """Today, or the day that `last_run` names."""
        return {"day": max(self.options.get("last_run") or date.today().isoformat(), self.initialOffset()["day"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["day"] <= start["day"]:
            return []
        key = api_key(self.options.get("key_variable", "AREA_API_KEY"))
        first = window_start(date.fromisoformat(start["day"]) + timedelta(days=1), self.window, date.fromisoformat(self.options.get("source_start", "2000-01-01")))
        return [_Run(a.isoformat(), (b - a).days + 1, key, start["day"], end["day"]) for a, b in date_chunks(first, date.fromisoformat(end["day"]))]

    def read(self, partition: _Run) -> Iterator[tuple]:
        for row in fetched_rows(self.options, partition):
            day = date.fromisoformat(row["acq_date"])
            seen = min(date.fromisoformat(partition.last), day + timedelta(days=self.window - 1))
            yield tuple(seen if n == "seen" else row.get(n) for n in self.names)

    def commit(self, end: dict) -> None:
        """Offsets are in the checkpoint; the API keeps nothing."""


class AreaStream(DataSource):
    """`spark.readStream.format("detection_area_runs")` over the same API."""

    @classmethod
    def name(cls) -> str:
        return "detection_area_runs"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in RAW_COLUMNS) + ", seen date"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return AreaStreamReader(schema, dict(self.options))


ELEMENTS = "array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"


def map_elements(df: DataFrame, column: str = "json") -> DataFrame:
    """Rows of (osm_type, osm_id, lat, lon, tags, tag_text) from JSON texts `{"elements": [...]}`; elements without a place go."""
    body = F.from_json(column, f"struct<elements:{ELEMENTS}>")
    rows = df.select(F.explode(body["elements"]).alias("e"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    placed = rows.select(F.col("e.type").alias("osm_type"), F.col("e.id").alias("osm_id"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), F.coalesce("e.tags", F.create_map().cast("map<string,string>")).alias("tags"))
    return placed.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("tag_text", text)


def thermal_plants(df: DataFrame) -> DataFrame:
    """Thermal power plants of the country inside the area's box; neighbouring states included."""
    lat, lon = F.expr("try_cast(latitude as double)"), F.expr("try_cast(longitude as double)")
    kept = df.filter((F.col("country") == "IND") & F.col("primary_fuel").isin("Coal", "Gas", "Oil") & in_area(lat, lon))
    return kept.select("name", "gppd_idnr", F.expr("try_cast(capacity_mw as double)").alias("capacity_mw"), lat.alias("latitude"), lon.alias("longitude"), "primary_fuel", "commissioning_year")


def needed_tiles(points: DataFrame) -> DataFrame:
    return points.select(tile_name(F.col("lat"), F.col("lon")).alias("tile")).filter(F.col("tile").isNotNull()).distinct()
