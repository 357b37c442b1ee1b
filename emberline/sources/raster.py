"""Land-cover rasters: single-band GeoTIFF tiles read by the tasks that sample them.

Tiles are files named by their corner (`functions.geo.tile_name`). Points meet their tile by a join on that name; a task
opens one tile at a time and decodes only the blocks that its points' windows touch. Tiles that are missing give nulls.

The reader knows little- and big-endian files with 8- or 16-bit unsigned samples, in strips or tiles, plain or deflated,
with or without the horizontal predictor, placed by pixel scale and tie point. Others raise RasterError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import tile_name

_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, STRIP_ROWS, STRIP_BYTES, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_BYTES, SCALE, TIE = 256, 257, 258, 259, 273, 278, 279, 317, 322, 323, 324, 325, 33550, 33922

SLICES = 8


class RasterError(ValueError):
    """A file that the reader can't read."""


def unpacked(raw: bytes, high: int, wide: int, rows: int, bits: int, packing: int, predictor: int, order: str) -> np.ndarray:
    """The pixels of a block of `high` rows; of a strip at the end only `rows` are there, of a tile all."""
    raw = raw if packing == 1 else zlib.decompress(raw)
    here = high if len(raw) >= high * wide * bits // 8 else rows
    block = np.frombuffer(raw, f"{order}u{bits // 8}", here * wide).reshape(here, wide)
    return np.cumsum(block, 1, dtype=np.uint64).astype(f"u{bits // 8}") if predictor == 2 else block


class Raster:
    """One tile, from its bytes or from a function that takes some of them (start, size). Blocks are decoded when first touched."""

    def __init__(self, data: bytes | Callable[[int, int], bytes]):
        self.take = data if callable(data) else lambda start, size: data[start : start + size]
        head = self.take(0, 8)
        if head[:2] not in (b"II", b"MM") or len(head) < 8:
            raise RasterError("not a TIFF file")
        self.order = "<" if head[:2] == b"II" else ">"
        magic, first = struct.unpack(self.order + "HI", head[2:8])
        if magic != 42:
            raise RasterError("not a classic TIFF file")
        self.tags = self._directory(first)
        self.width, self.height = self.tags[WIDTH][0], self.tags[HEIGHT][0]
        self.bits, self.packing = self.tags.get(BITS, (8,))[0], self.tags.get(COMPRESSION, (1,))[0]
        if self.bits not in (8, 16) or self.packing not in (1, 8, 32946):
            raise RasterError(f"samples of {self.bits} bits, compression {self.packing}")
        self.tiled = TILE_AT in self.tags
        self.block = (self.tags[TILE_H][0], self.tags[TILE_W][0]) if self.tiled else (self.tags.get(STRIP_ROWS, (self.height,))[0], self.width)
        if SCALE not in self.tags or TIE not in self.tags:
            raise RasterError("no place on the globe")
        self.step_x, self.step_y = self.tags[SCALE][:2]
        col, row, _, lon, lat = self.tags[TIE][:5]
        self.west, self.north = lon - col * self.step_x, lat + row * self.step_y
        self.across = -(-self.width // self.block[1]) if self.tiled else 1
        self.starts, self.sizes = (self.tags[TILE_AT], self.tags[TILE_BYTES]) if self.tiled else (self.tags[STRIP_AT], self.tags[STRIP_BYTES])
        self.predictor = self.tags.get(PREDICTOR, (1,))[0]
        self._held: dict[int, np.ndarray] = {}

    def _directory(self, at: int) -> dict[int, tuple]:
        (count,) = self._read("H", at)
        found = {}
        for k in range(count):
            tag, kind, n = self._read("HHI", at + 2 + 12 * k)
            if kind not in _SIZES:
                continue
            letter, size = _SIZES[kind]
            place = at + 2 + 12 * k + 8
            if size * n > 4:
                (place,) = self._read("I", place)
            found[tag] = self._read(f"{n}s" if letter == "s" else letter * n, place)
        return found

    def _read(self, form: str, at: int) -> tuple:
        form = self.order + form
        data = self.take(at, struct.calcsize(form))
        if len(data) < struct.calcsize(form):
            raise RasterError("the file ends within its directory")
        return struct.unpack(form, data)

    def _decoded(self, k: int) -> np.ndarray:
        if k not in self._held:
            raw = self.take(self.starts[k], self.sizes[k])
            self._held[k] = unpacked(raw, *self.block, min(self.block[0], self.height - k // self.across * self.block[0]), self.bits, self.packing, self.predictor, self.order)
        return self._held[k]

    def window(self, lat: float, lon: float, radius: int = 0) -> np.ndarray:
        """The pixels around the one that holds a point, `radius` on each side, as far as the tile has them."""
        row, col = int(np.floor((self.north - lat) / self.step_y)), int(np.floor((lon - self.west) / self.step_x))
        top, bottom = max(0, row - radius), min(self.height, row + radius + 1)
        left, right = max(0, col - radius), min(self.width, col + radius + 1)
        if top >= bottom or left >= right:
            return np.zeros((0, 0), np.uint16)
        out = np.zeros((bottom - top, right - left), np.uint16)
        high, wide = self.block
        for i in range(top // high, (bottom - 1) // high + 1):
            for j in range(left // wide, (right - 1) // wide + 1):
                block = self._decoded(i * self.across + j)
                r0, r1, c0, c1 = max(top, i * high), min(bottom, (i + 1) * high), max(left, j * wide), min(right, (j + 1) * wide)
                out[r0 - top : r1 - top, c0 - left : c1 - left] = block[r0 - i * high : r1 - i * high, c0 - j * wide : c1 - j * wide]
        return out


def encoded(pixels: np.ndarray, west: float, north: float, step: float, size: int = 16) -> bytes:
    """A tile of 8-bit pixels as a little-endian GeoTIFF with deflated square blocks: for small rasters of one's own."""
    high, wide = pixels.shape
    padded = np.zeros((-(-high // size) * size, -(-wide // size) * size), np.uint8)
    padded[:high, :wide] = pixels
    packed = [zlib.compress(padded[i : i + size, j : j + size].tobytes()) for i in range(0, padded.shape[0], size) for j in range(0, padded.shape[1], size)]
    starts = np.cumsum([8, *map(len, packed)])[:-1].tolist()
    body = b"".join(packed)
    longs = {WIDTH: [wide], HEIGHT: [high], BITS: [8], COMPRESSION: [8], TILE_W: [size], TILE_H: [size], TILE_AT: starts, TILE_BYTES: [len(p) for p in packed]}
    doubles = {SCALE: [step, step, 0.0], TIE: [0.0, 0.0, 0.0, west, north, 0.0]}
    at, values, rows = 8 + len(body), b"", []
    for tag in sorted([*longs, *doubles]):
        kind, letter, found = (4, "I", longs[tag]) if tag in longs else (12, "d", doubles[tag])
        data = struct.pack(f"<{len(found)}{letter}", *found)
        place = data if len(data) <= 4 else struct.pack("<I", at + len(values))
        values += data if len(data) > 4 else b""
        rows.append(struct.pack("<HHI", tag, kind, len(found)) + place.ljust(4, b"\0"))
    return struct.pack("<2sHI", b"II", 42, at + len(values)) + body + values + struct.pack("<H", len(rows)) + b"".join(rows) + bytes(4)


def tiles(spark: SparkSession, folder: str, suffix: str = ".tif") -> DataFrame:
    """(tile, content): the tile files of a folder, named by their corner."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select(F.regexp_extract("path", r"([NS]\d{2}[EW]\d{3})[^/]*$", 1).alias("tile"), "content").filter(F.col("tile") != "")


def sample(points: DataFrame, held: DataFrame, radius: int = 0, key: str = "id") -> DataFrame:
    """(key, code, diversity): the pixel under each point (key, lat, lon), null for 0 or none, and how many different codes but 0
    the window around it has, null if none. Tasks hold one tile and its points in batches; a tile with most points is one
    group, so points are dealt over SLICES groups of each tile."""
    kind = points.schema[key].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        raster = Raster(bytes(right["content"].iloc[0])) if len(right) else None
        codes, kinds = [], []
        for lat, lon in zip(left["lat"], left["lon"], strict=True):
            middle = raster.window(lat, lon) if raster else np.zeros(0)
            around = raster.window(lat, lon, radius) if raster else np.zeros(0)
            codes.append(int(middle[0, 0]) if middle.size and middle[0, 0] else None)
            kinds.append(len(np.unique(around[around > 0])) or None)
        return pd.DataFrame({key: left[key], "code": pd.array(codes, "Int32"), "diversity": pd.array(kinds, "Int32")})

    named = points.select(key, "lat", "lon", tile_name(F.col("lat"), F.col("lon")).alias("tile"), F.pmod(F.xxhash64(key), F.lit(SLICES)).cast("int").alias("slice"))
    copies = held.select("tile", "content", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    return named.groupBy("tile", "slice").cogroup(copies.groupBy("tile", "slice")).applyInPandas(run, f"{key} {kind}, code int, diversity int")

