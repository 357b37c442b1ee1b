"""Detections, layers and raster derived from the star-schema tables by integer arithmetic, as expressions both engines read.

Each view is (table, filter, {column: expression}). Expressions are portable SQL; `{date:...}` marks what dialects spell
differently.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .raster import encoded

_LAT = "20.1e0 + (({k} * 37) % 450) / 100e0"
_LON = "68.1e0 + (({k} * 61) % 620) / 100e0"
_SITE_LAT = "20.2e0 + ({s} % 10) * 0.4e0"
_SITE_LON = "68.3e0 + (({s} - {s} % 10) / 10) * 0.9e0"

DET = (
    "events",
    "true",
    {
        "id": "event_id",
        "lat": _LAT.format(k="user_id") + " + ((event_id % 7) - 3) * 0.0015e0",
        "lon": _LON.format(k="user_id") + " + ((event_id % 5) - 2) * 0.0015e0",
        "acq_date": "<plus_days cast(ts as date)|cast((user_id % 12) * 30 as int)>",
        "acq_time": "concat(lpad(cast(hour(ts) as <str>), 2, '0'), lpad(cast(minute(ts) as <str>), 2, '0'))",
        "frp": "value",
        "daynight": "case when hour(ts) < 6 or hour(ts) >= 18 then 'N' else 'D' end",
        "confidence": "case event_type when 'purchase' then 'h' when 'error' then 'l' else 'n' end",
        "scan": "0.32e0 + (event_id % 40) / 100e0",
        "track": "0.32e0 + (event_id % 40) / 100e0",
        "brightness": "300e0 + value / 10",
        "bright_t31": "290e0 + value / 20",
        "satellite": "case when event_id % 3 = 0 then '1' else 'N' end",
    },
)
HIST = (
    "orders",
    "true",
    {
        "id": "o_orderkey",
        "lat": _SITE_LAT.format(s="(o_custkey % 60)") + " + case when o_orderkey % 11 = 0 then ((o_orderkey % 97) - 48) * 0.004e0 else ((o_orderkey % 7) - 3) * 0.0006e0 end",
        "lon": _SITE_LON.format(s="(o_custkey % 60)") + " + case when o_orderkey % 11 = 0 then ((o_orderkey % 89) - 44) * 0.004e0 else ((o_orderkey % 5) - 2) * 0.0006e0 end",
        "acq_date": "<plus_years cast(o_orderdate as date)>",
        "acq_time": "concat(lpad(cast(o_orderkey % 24 as <str>), 2, '0'), lpad(cast((o_orderkey * 7) % 60 as <str>), 2, '0'))",
        "frp": "o_totalprice / 1000e0",
        "daynight": "case when (o_orderkey + o_custkey) % 4 = 0 then 'D' else 'N' end",
        "confidence": "case o_orderpriority when '1-URGENT' then 'h' when '5-LOW' then 'l' else 'n' end",
    },
)


def _points(table: str, key: str, where: str = "true") -> tuple[str, str, dict[str, str]]:
    return (table, where, {"id": f"cast({key} as bigint)", "lat": _LAT.format(k=key), "lon": _LON.format(k=key)})


LAYERS = {
    "dist_industrial_m": _points("customer", "c_custkey"),
    "dist_plant_m": _points("supplier", "s_suppkey"),
    "dist_flare_m": _points("nation", "n_nationkey"),
    "dist_kiln_m": _points("region", "r_regionkey"),
}
FEATURES = (
    "part",
    "true",
    {
        "feature_id": "p_partkey",
        "element": "case p_partkey % 3 when 0 then 'node' when 1 then 'way' else 'relation' end",
        "lat": _SITE_LAT.format(s="(p_partkey % 60)") + " + ((p_partkey % 13) - 6) * 0.002e0",
        "lon": _SITE_LON.format(s="(p_partkey % 60)") + " + ((p_partkey % 17) - 8) * 0.002e0",
        "name": "case when p_size % 3 = 0 then p_name end",
        "tag_at": "cast(p_partkey % 22 as int)",
    },
)
#: The last date of `det`, for statuses.
REFERENCE = "2024-12-27"


def spark_view(spark: SparkSession, sf_dir: str, view: tuple[str, str, dict[str, str]]) -> DataFrame:
    table, where, columns = view
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").filter(where).selectExpr(*(f"{_spark(e)} as {c}" for c, e in columns.items()))


def _spark(e: str) -> str:
    if e.startswith("<plus_days "):
        day, n = e[11:-1].split("|")
        return f"date_add({day}, {n})"
    if e.startswith("<plus_years "):
        return f"add_months({e[12:-1]}, 288)"
    return e.replace("<str>", "string")


def duck_view(view: tuple[str, str, dict[str, str]]) -> str:
    table, where, columns = view

    def duck(e: str) -> str:
        if e.startswith("<plus_days "):
            day, n = e[11:-1].split("|")
            return f"{day} + {n}"
        if e.startswith("<plus_years "):
            return f"cast({e[12:-1]} + interval 24 year as date)"
        return e.replace("<str>", "varchar")

    return f"select {', '.join(f'{duck(e)} as {c}' for c, e in columns.items())} from {table} where {where}"


def features(spark: SparkSession, sf_dir: str, tags: list[tuple]) -> DataFrame:
    """Map features with a map of tags; positions beyond the list have a tag that no rule knows."""
    dimension = F.array(*(F.create_map(F.lit(t[0]), F.lit(t[1])) for t in tags))
    rows = spark_view(spark, sf_dir, FEATURES)
    return rows.withColumn("tags", F.coalesce(F.get(dimension, "tag_at"), F.create_map(F.lit("note"), F.lit("none")))).drop("tag_at")


def raster(spark: SparkSession) -> DataFrame:
    """(row, col, code) land cover on quarter-degree cells of the study area."""
    rows = spark.range(79, 101).select(F.col("id").cast("int").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(271), F.lit(300))))
    codes = F.array(*map(F.lit, (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100)))
    return rows.withColumn("code", F.get(codes, (F.col("row") * 7 + F.col("col")) % 11))


#: Rasters of 3 by 3 degrees as files: pixels of 0.05 degrees, whose code is that of their row and column; the last tile is missing.
TILE_STEP, TILE_PIXELS = 0.05, 60
TILE_CORNERS = tuple((south, west) for south in (18, 21, 24) for west in (66, 69, 72))[:-1]


def write_tiles(spark: SparkSession, folder: str) -> str:
    """Write the tiles to a shared folder; where they are, with `{tile}` for a name."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    row, col = np.indices((TILE_PIXELS, TILE_PIXELS))
    for south, west in TILE_CORNERS:
        pixels = ((row * 7 + col * col + south) % 12 * 10 % 110).astype(np.uint8)
        path = hadoop.Path(f"{folder}/N{south:02d}E{west:03d}.tif")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(encoded(pixels, float(west), south + 3.0, TILE_STEP)))
        out.close()
    return f"{folder}/{{tile}}.tif"


TILES_SQL = f"""select south, west, r as row, c as col, (r * 7 + c * c + south) % 12 * 10 % 110 as code from (values {", ".join(map(str, TILE_CORNERS))}) t(south, west),
    (select unnest(range({TILE_PIXELS})) as r), (select unnest(range({TILE_PIXELS})) as c)"""
RASTER_SQL = """select r as row, c as col, [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100][(r * 7 + c) % 11 + 1] as code
    from (select cast(unnest(range(79, 101)) as int) as r), (select cast(unnest(range(271, 301)) as int) as c)"""
