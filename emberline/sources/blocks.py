"""Rasters read block by block: only byte ranges that points touch are fetched, and window counts come from prefix sums.

A tile is a GeoTIFF that is reached by a range reader, `read(place, start, size)`, found by dotted name in the tasks; it
returns bytes, or None if there is no such tile. `file_ranges` is one for any store that pyarrow knows, `web_ranges` one for
HTTP. Points meet tiles by name; headers (a few pages) are fetched once for each tile, and blocks once for each block that a
window touches. Both are kept in a cache folder and fetched only if they are missing there, tiles that don't exist included.

A block's pixels are decoded once, and for each class that it has, a prefix sum gives the pixels of that class in any window by
four lookups. A window that lies over several blocks gets a part from each. Windows end at their tile's edge. Places are
pixels: points on one pixel share their window, so a place with a third of all points is one row here.

Defined results: points without a place or outside all tiles have a null code and no diversity; code 0 is no data; repeated
points each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.geo import tile_name
from ..plans.storage import stored
from .raster import Raster, unpacked

Read = Callable[[str, int, int], bytes | None]
TAGS = "width int, height int, high int, wide int, across int, west double, north double, step_x double, step_y double, bits int, packing int, predictor int, order string, starts array<long>, sizes array<long>"
HEADER = f"tile string, found boolean, {TAGS}"
BLOCK = "tile string, block int, raw binary"
#: What is read of a tile at once for its directory.
PAGE_BYTES = 1 << 14
#: Bytes of blocks that a partition of a whole scan reads.
PARTITION_BYTES = 32_000_000


def file_ranges(place: str, start: int, size: int) -> bytes | None:
    """Bytes of a file in any store that pyarrow knows."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(place)
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)


def web_ranges(place: str, start: int, size: int) -> bytes | None:
    """Bytes of a web resource; 404 is None."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(place, headers={"Range": f"bytes={start}-{start + size - 1}"}), timeout=120) as reply:
            body = reply.read()
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return None
        raise
    return body[start : start + size] if reply.status == 200 else body


def _reader(name: str) -> Read:
    module, _, function = name.rpartition(".")
    return getattr(importlib.import_module(module), function)


def header_of(read: Read, place: str) -> Raster | None:
    """A tile's directory, by pages of the file that hold it; None if there is no tile."""
    pages: dict[int, bytes] = {}

    def take(start: int, size: int) -> bytes:
        first, last = start // PAGE_BYTES, (start + max(size, 1) - 1) // PAGE_BYTES
        for k in range(first, last + 1):
            if k not in pages:
                pages[k] = read(place, k * PAGE_BYTES, PAGE_BYTES) or b""
        at = start - first * PAGE_BYTES
        return b"".join(pages[k] for k in range(first, last + 1))[at : at + size]

    return None if read(place, 0, 1) is None else Raster(take)


def _header_row(tile: str, raster: Raster | None) -> tuple:
    if raster is None:
        return tile, False, *([None] * len(TAGS.split(", ")))
    return (
        tile, True, raster.width, raster.height, *raster.block, raster.across, raster.west, raster.north, raster.step_x, raster.step_y, raster.bits, raster.packing, raster.predictor, raster.order,
        list(raster.starts), list(raster.sizes),
    )


class Tiles:
    """Tiles of one raster: where they are (`{tile}` in `place` stands for a name), how they are read, and the cache folder."""

    def __init__(self, spark: SparkSession, place: str, read: str, cache: str):
        self.spark, self.place, self.read, self.cache = spark, place, read, cache.rstrip("/")

    def _held(self, kind: str, ddl: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.cache}/{kind}")
        there = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(ddl).parquet(f"{self.cache}/{kind}") if there else self.spark.createDataFrame([], ddl)

    def headers(self, tiles: DataFrame) -> DataFrame:
        """(tile, found, ...) of each different tile of a frame (tile); those that the cache lacks are fetched."""
        place, name = self.place, self.read

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            read = _reader(name)
            for batch in batches:
                rows = [_header_row(t, header_of(read, place.format(tile=t))) for t in batch["tile"]]
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER.split(", ")])
                yield frame.astype({c.split()[0]: "Int32" for c in HEADER.split(", ") if c.endswith(" int")})

        wanted = stored(tiles.select("tile").filter(F.col("tile").isNotNull()).distinct(), "tiles")
        missing = wanted.join(self._held("headers", HEADER).select("tile"), "tile", "left_anti")
        missing.mapInPandas(run, HEADER).write.mode("append").parquet(f"{self.cache}/headers")
        held = self._held("headers", HEADER).dropDuplicates(["tile"])  # two jobs may have fetched one at the same time
        return held.join(wanted, "tile", "left_semi")

    def blocks(self, wanted: DataFrame, headers: DataFrame) -> DataFrame:
        """(tile, block, raw): the packed bytes of the blocks of a frame (tile, block); those that the cache lacks are fetched."""
        place, name = self.place, self.read

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            read = _reader(name)
            for batch in batches:
                raws = [read(place.format(tile=t), int(a), int(n)) for t, a, n in zip(batch["tile"], batch["start"], batch["size"], strict=True)]
                yield pd.DataFrame({"tile": batch["tile"], "block": batch["block"], "raw": raws})

        each = stored(wanted.select("tile", "block").distinct(), "blocks")
        missing = each.join(self._held("blocks", BLOCK).select("tile", "block"), ["tile", "block"], "left_anti")
        ranges = headers.select("tile", F.posexplode(F.arrays_zip("starts", "sizes")).alias("block", "at")).select("tile", "block", F.col("at.starts").alias("start"), F.col("at.sizes").alias("size"))
        missing.join(ranges, ["tile", "block"]).mapInPandas(run, BLOCK).write.mode("append").parquet(f"{self.cache}/blocks")
        held = self._held("blocks", BLOCK).join(each, ["tile", "block"], "left_semi")
        return held.dropDuplicates(["tile", "block"])


def window_classes(pixels: DataFrame, tiles: Tiles, headers: DataFrame, radius: int) -> DataFrame:
    """(tile, row, col, code, pixels): how many pixels of each class the window around a pixel (tile, row, col) has."""
    spans = {}
    for axis, size, block in (("row", "height", "high"), ("col", "width", "wide")):
        first, last = F.greatest(F.col(axis) - radius, F.lit(0)), F.least(F.col(axis) + radius, F.col(size) - 1)
        spans |= {f"{axis}0": first.cast("int"), f"{axis}1": last.cast("int"), f"{axis}b": F.sequence(F.floor(first / F.col(block)).cast("int"), F.floor(last / F.col(block)).cast("int"))}
    each = pixels.select("tile", "row", "col").distinct().join(headers.filter("found").drop("found", "starts", "sizes"), "tile")
    inside = each.filter((F.col("row") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") >= 0) & (F.col("col") < F.col("width")))
    parts = inside.withColumns(spans).withColumn("i", F.explode("rowb")).withColumn("j", F.explode("colb")).withColumn("block", (F.col("i") * F.col("across") + F.col("j")).cast("int"))
    touched = stored(parts.select("tile", "block", "i", "j", "row", "col", "row0", "row1", "col0", "col1", "high", "wide", "height", "bits", "packing", "predictor", "order"), "windows")
    raws = tiles.blocks(touched, headers)
    out = "tile string, row int, col int, code int, pixels long"

    def run(windows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(windows) or not len(block):
            return pd.DataFrame({c.split()[0]: [] for c in out.split(", ")})
        one = windows.iloc[0]
        high = min(int(one["high"]), int(one["height"]) - int(one["i"]) * int(one["high"]))
        held = unpacked(bytes(block["raw"].iloc[0]), int(one["high"]), int(one["wide"]), high, int(one["bits"]), int(one["packing"]), int(one["predictor"]), one["order"])
        top, left = int(one["i"]) * int(one["high"]), int(one["j"]) * int(one["wide"])
        r0, r1 = (np.clip(windows[c].to_numpy() + d - top, 0, held.shape[0]) for c, d in (("row0", 0), ("row1", 1)))
        c0, c1 = (np.clip(windows[c].to_numpy() + d - left, 0, held.shape[1]) for c, d in (("col0", 0), ("col1", 1)))
        found = []
        for code in np.unique(held):
            sums = np.zeros((held.shape[0] + 1, held.shape[1] + 1), np.int64)
            sums[1:, 1:] = (held == code).cumsum(0).cumsum(1)
            many = sums[r1, c1] - sums[r0, c1] - sums[r1, c0] + sums[r0, c0]
            some = many > 0
            found.append(pd.DataFrame({"tile": windows["tile"][some], "row": windows["row"][some], "col": windows["col"][some], "code": int(code), "pixels": many[some]}))
        return pd.concat(found).astype({"code": "int32"})

    counted = touched.groupBy("tile", "block").cogroup(raws.groupBy("tile", "block")).applyInPandas(run, out)
    return counted.groupBy("tile", "row", "col", "code").agg(F.sum("pixels").alias("pixels"))


def sample(points: DataFrame, tiles: Tiles, radius: int = 0, key: str = "id") -> DataFrame:
    """(key, code, diversity): the pixel under each point (key, lat, lon), null for 0 or none, and how many classes but 0 its window
    has, null if none."""
    named = points.select(key, "lat", "lon", tile_name(F.col("lat"), F.col("lon")).alias("tile"))
    headers = stored(tiles.headers(named), "headers")
    places = headers.filter("found").select("tile", "west", "north", "step_x", "step_y")
    row, col = F.floor((F.col("north") - F.col("lat")) / F.col("step_y")).cast("int"), F.floor((F.col("lon") - F.col("west")) / F.col("step_x")).cast("int")
    at = stored(named.join(places, "tile", "left").select(key, "tile", row.alias("row"), col.alias("col")), "pixels")
    counts = stored(window_classes(at.filter(F.col("row").isNotNull()), tiles, headers, radius), "classes")
    some = counts.filter("code <> 0").groupBy("tile", "row", "col").agg(F.count(F.lit(1)).cast("int").alias("diversity"))
    middle = counts if radius == 0 else window_classes(at.filter(F.col("row").isNotNull()), tiles, headers, 0)
    codes = middle.filter("code <> 0").select("tile", "row", "col", "code")
    return at.join(some, ["tile", "row", "col"], "left").join(codes, ["tile", "row", "col"], "left").select(key, "code", "diversity")


class _Blocks(InputPartition):
    def __init__(self, tile: str, blocks: list[tuple]):
        self.tile, self.blocks = tile, blocks


class BlockReader(DataSourceReader):
    """Partitions are runs of blocks of one tile, of about PARTITION_BYTES; a task reads their byte ranges."""

    def __init__(self, options: dict[str, str]):
        self.place, self.read_name, self.tiles = options["place"], options.get("read", f"{__name__}.file_ranges"), json.loads(options["tiles"])

    def partitions(self) -> list[InputPartition]:
        read, out = _reader(self.read_name), []
        for tile in self.tiles:  # headers only
            raster = header_of(read, self.place.format(tile=tile))
            held, size = [], 0
            for k, (start, n) in enumerate(zip(raster.starts, raster.sizes, strict=True) if raster else ()):
                if held and size + n > PARTITION_BYTES:
                    out.append(_Blocks(tile, held))
                    held, size = [], 0
                held.append((k, start, n, raster.across, *raster.block, raster.height, raster.width, raster.bits, raster.packing, raster.predictor, raster.order))
                size += n
            if held:
                out.append(_Blocks(tile, held))
        return out or [_Blocks("", [])]

    def read(self, partition: _Blocks) -> Iterator[tuple]:
        read = _reader(self.read_name)
        for k, start, n, across, high, wide, height, width, bits, packing, predictor, order in partition.blocks:
            top, left = k // across * high, k % across * wide
            block = unpacked(read(self.place.format(tile=partition.tile), start, n), high, wide, min(high, height - top), bits, packing, predictor, order)
            block = block[: height - top, : width - left]
            yield partition.tile, k, top, left, block.shape[0], block.shape[1], [int(v) for v in block.ravel()]


class RasterBlocks(DataSource):
    """`spark.read.format("raster_blocks")`: all pixels of the tiles that option `tiles` (a JSON list) names, a row for each block."""

    @classmethod
    def name(cls) -> str:
        return "raster_blocks"

    def schema(self) -> str:
        return "tile string, block int, top int, left int, rows int, cols int, pixels array<int>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return BlockReader(dict(self.options))
