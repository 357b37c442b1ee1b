"""Map features: queries for an area or around a point, a fetch with a second address and retries, and staging once.

Requests run on the driver, a handful for a whole area; per-point lookups are joins with the staged table
(`operators.evidence`), not requests from executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import map_elements

Post = Callable[[str, str], tuple[int, str]]
ATTEMPTS, PAUSE_S, TIMEOUT_S = 4, 5.0, 180
KINDS = ("node", "way", "relation")
FAILED = "query_failed"
#: What is fetched for the layers of an area, as (key, value pattern) pairs.
AREA_TAGS = {
    "industrial": (("landuse", "industrial"), ("man_made", "works"), ("power", "plant")),
    "flare": (("man_made", "flare"),),
    "kiln": (("man_made", "kiln"), ("industrial", "brickyard")),
}


def _selector(kind: str, key: str, value: str, place: str) -> str:
    return f'{kind}["{key}"="{value}"]({place});'


def area_query(tags: tuple[tuple[str, str], ...], box: tuple[float, float, float, float], timeout: int = TIMEOUT_S) -> str:
    """A query for all elements with one of the tags in a box (west, south, east, north)."""
    west, south, east, north = box
    place = f"{south:g},{west:g},{north:g},{east:g}"
    body = "".join(_selector(kind, k, v, place) for k, v in tags for kind in KINDS)
    return f"[out:json][timeout:{timeout}];({body});out center tags;"


def point_query(tags: list[tuple], lat: float, lon: float, radius_m: float, timeout: int = TIMEOUT_S) -> str:
    """A query for elements with one of the tags around a point; tags may carry labels and groups after key and value."""
    place = f"around:{radius_m:g},{lat:.6f},{lon:.6f}"
    body = "".join(_selector(kind, t[0], t[1], place) for t in tags for kind in KINDS)
    return f"[out:json][timeout:{timeout}];({body});out center tags;"


def fetch(addresses: tuple[str, ...], query: str, post: Post, attempts: int = ATTEMPTS, pause_s: float = PAUSE_S, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The first good answer of an address, each tried in turn, in rounds with pauses that grow by the round; None if all fail."""
    for k in range(attempts):
        for address in addresses:
            try:
                status, body = post(address, query)
            except OSError:
                continue
            if status == 200 and body.lstrip().startswith("{"):
                return body
        if k + 1 < attempts:
            sleep(pause_s * (k + 1))
    return None


def stage(spark: SparkSession, path: str, layers: dict[str, str], addresses: tuple[str, ...], post: Post, **kwargs) -> DataFrame:
    """(layer, osm_type, osm_id, lat, lon, tags, tag_text) of area queries by layer, fetched only for layers that aren't staged;
    a layer whose fetch fails raises, as distances to it would all be wrong."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, query in layers.items():
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/layer={name}")):
            continue
        body = fetch(addresses, query, post, **kwargs)
        if body is None:
            raise RuntimeError(f"{FAILED}: {name}")
        map_elements(spark.createDataFrame([(body,)], "json string")).write.parquet(f"{path}/layer={name}")
    return spark.read.parquet(path)


def lookup(spark: SparkSession, points: list[tuple[int, float, float, float]], tags: list[tuple], addresses: tuple[str, ...], post: Post, **kwargs) -> DataFrame:
    """(id, status, osm_type, osm_id, lat, lon, tags, tag_text): what stands around each of a few points (id, lat, lon, radius), by
    one request each; a point without an answer has the status `query_failed`, one without elements `none`."""
    answers = [(i, fetch(addresses, point_query(tags, lat, lon, radius), post, **kwargs)) for i, lat, lon, radius in points]
    asked = spark.createDataFrame([(i, b) for i, b in answers], "id long, json string")
    parts = [asked.filter(F.col("json").isNull()).select("id", F.lit(FAILED).alias("status"))]
    found = None
    for i, body in answers:
        if body is not None:
            one = map_elements(spark.createDataFrame([(body,)], "json string")).withColumn("id", F.lit(i).cast("long"))
            found = one if found is None else found.unionByName(one)
    rest = asked.filter(F.col("json").isNotNull()).select("id")
    if found is None:
        return parts[0]
    told = rest.join(found, "id", "left").withColumn("status", F.when(F.col("osm_id").isNull(), "none").otherwise("ok"))
    return told.unionByName(parts[0], allowMissingColumns=True)
