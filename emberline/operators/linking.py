"""Links of detections inside blocks of space and time.

A block is BLOCK_CELLS cells of the search distance wide and BLOCK_DAYS long. Each row goes to its own block once, with all its
columns, and is copied (place, day and id only) into the blocks before it within the search distance, so any two rows that are near each
other meet in one block. A task reads its blocks sorted by day, in chunks of rows; between chunks of one block it keeps the different places of the last
days only. What crosses blocks and chunks are links between components found in them, few beside the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import EARTH_RADIUS_M
from ..plans.storage import stored
from .spatial import AREA_LAT, cells_of

BLOCK_CELLS, BLOCK_DAYS = 16, 32
#: Rows that a task links at once, and pairs of places that it compares at once.
CHUNK_ROWS, CHUNK_PAIRS = 100_000, 2_000_000
#: Pairs of cells with more pairs of places are first judged by their outermost places.
FEW_PAIRS = 64
BLOCK = ["_bt", "_bi", "_bj"]


def _linker(eps_m: float, eps_days: int, most_lat: float, chunk_rows: int, chunk_pairs: int, few: int, earth: float) -> Callable:
    """What gives rows of a partition their root. The function carries its own code, so that tasks need nothing but numpy and pyarrow."""
    block = ["_bt", "_bi", "_bj"]
    # cells in which any two places are closer than eps_m, and how many cells away a place within eps_m can lie
    step = math.degrees(0.999 * eps_m / math.sqrt(2) / earth)
    width = math.radians(step) * earth
    far_i, far_j = math.ceil(eps_m / width), math.ceil(eps_m / (width * math.cos(math.radians(most_lat))))
    around = [(d, x, y) for d in range(eps_days + 1) for x in range(-far_i, far_i + 1) for y in range(-far_j, far_j + 1) if (x, y) != (0, 0) and (d or (x, y) > (0, 0))]

    def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """starts[k], starts[k] + 1, ... counts[k] of them, for all k."""
        return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())

    def joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Labels after joining u to v: roots fall to the smallest neighbour's and jump to their label's label. Each root has itself as label."""
        u, v = label[u], label[v]
        now = np.arange(len(label))
        while True:
            low = np.minimum(now[u], now[v])
            new = now.copy()
            for at in (u, v, now[u], now[v]):
                np.minimum.at(new, at, low)
            new = new[new]
            if np.array_equal(new, now):
                return now[label]
            now = new

    def near(lat: np.ndarray, lon: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        a, b = np.sin(np.radians(lat[q] - lat[p]) / 2), np.sin(np.radians(lon[q] - lon[p]) / 2)
        h = a * a + np.cos(np.radians(lat[p])) * np.cos(np.radians(lat[q])) * b * b
        return np.arcsin(np.sqrt(np.minimum(1.0, h))) * (2 * earth) <= eps_m

    def compared(lat: np.ndarray, lon: np.ndarray, first: np.ndarray, many: np.ndarray, g: np.ndarray, h: np.ndarray) -> Iterator[tuple]:
        """Pairs of cells of which two places are near, by all their places, some CHUNK_PAIRS pairs at once."""
        rows = spread(first[g], many[g])  # a place of g against all of h
        mine, other = np.repeat(g, many[g]), np.repeat(h, many[g])
        ends = np.cumsum(many[other])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk_pairs, "right")))
            n = many[other[at:to]]
            hit = near(lat, lon, np.repeat(rows[at:to], n), spread(first[other[at:to]], n))
            which = np.repeat(np.arange(at, to), n)[hit]
            yield mine[which], other[which]
            at = to

    def roots(ids: np.ndarray, lat: np.ndarray, lon: np.ndarray, day: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The smallest id that each row reaches among the rows of its block."""
        i, j = np.floor(lat / step).astype(np.int64), np.floor(lon / step).astype(np.int64)
        order = np.lexsort((lon, lat, day, j, i, blocks))
        s_lat, s_lon, s_day, s_i, s_j, s_b = (x[order] for x in (lat, lon, day, i, j, blocks))
        place = np.ones(len(order), bool)  # rows at one place on one day are one
        place[1:] = (np.diff(s_b) != 0) | (np.diff(s_day) != 0) | (np.diff(s_lat) != 0) | (np.diff(s_lon) != 0)
        cell = np.ones(len(order), bool)
        cell[1:] = (np.diff(s_b) != 0) | (np.diff(s_day) != 0) | (np.diff(s_i) != 0) | (np.diff(s_j) != 0)
        of_row = np.cumsum(cell) - 1
        p_lat, p_lon = s_lat[place], s_lon[place]
        first = np.flatnonzero(cell[place])
        many = np.diff(np.append(first, len(p_lat)))
        c_b, c_day, c_i, c_j = (x[cell] for x in (s_b, s_day, s_i, s_j))
        begin = np.flatnonzero(np.append(True, np.diff(c_b) != 0))
        number = np.cumsum(np.append(0, np.diff(c_b) != 0))
        from_least = lambda x: x - np.minimum.reduceat(x, begin)[number]
        r_i, r_j, r_d = from_least(c_i), from_least(c_j), from_least(c_day)
        across_i, across_j, across_d = int(r_i.max()) + 2 * far_i + 1, int(r_j.max()) + 2 * far_j + 1, int(r_d.max()) + eps_days + 1
        key = ((number * across_i + r_i + far_i) * across_j + r_j + far_j) * across_d + r_d
        label = np.arange(len(key))
        # days of one cell without a gap
        run = np.flatnonzero((np.diff(c_b) == 0) & (np.diff(c_i) == 0) & (np.diff(c_j) == 0) & (np.diff(c_day) <= eps_days))
        label = joined(label, run, run + 1)
        pairs = []
        for d, x, y in around:
            want = key + (x * across_j + y) * across_d + d
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            found = np.flatnonzero(key[at] == want)
            pairs.append(np.stack([found, at[found]]))
        g, h = np.concatenate(pairs, 1)
        small = many[g] * many[h] <= few
        for u, v in compared(p_lat, p_lon, first, many, g[small], h[small]):
            label = joined(label, u, v)
        g, h = g[~small], h[~small]
        if len(g):
            by_lon = np.lexsort((p_lon, np.repeat(np.arange(len(many)), many)))
            outer = [first, first + many - 1, by_lon[first], by_lon[first + many - 1]]
            for a in outer:
                for b in outer:
                    hit = near(p_lat, p_lon, a[g], b[h])
                    label = joined(label, g[hit], h[hit])
            size = max(1, chunk_pairs // 10)
            for at in range(0, len(g), size):
                apart = label[g[at : at + size]] != label[h[at : at + size]]
                for u, v in zip(g[at : at + size][apart], h[at : at + size][apart], strict=True):
                    if label[u] != label[v]:
                        for a, b in compared(p_lat, p_lon, first, many, np.array([u]), np.array([v])):
                            if len(a):
                                label = joined(label, a[:1], b[:1])
                                break
        least = np.full(len(key), np.iinfo(np.int64).max)
        np.minimum.at(least, label[of_row], ids[order])
        out = np.empty(len(ids), np.int64)
        out[order] = least[label[of_row]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # ids, places, days of the block that goes on
        held, rows = [], 0

        def told(held: list, kept: tuple | None) -> tuple[list, tuple | None]:
            table = pa.Table.from_batches(held).combine_chunks()
            names = [c for c in table.column_names if c not in (*block, "_day")]
            read = lambda c, null: table.column(c).fill_null(null).to_numpy()
            ids, lat, lon, day = read("id", 0), read("lat", math.nan), read("lon", math.nan), read("_day", 0).astype(np.int64)
            keys = np.stack([read(c, 0) for c in block])
            number = np.cumsum(np.append(0, (np.diff(keys) != 0).any(0)))
            sure = np.isfinite(lat) & np.isfinite(lon) & table.column("_day").is_valid().to_numpy()
            root = ids.astype(np.int64)
            before = kept if kept is not None and kept[0] == tuple(keys[:, 0]) else None
            early = before[1] if before else np.empty((0,), np.int64)
            joint = lambda k, x: np.concatenate([before[k], x[sure]]) if before else x[sure]
            a_id, a_lat, a_lon, a_day = joint(1, ids), joint(2, lat), joint(3, lon), joint(4, day)
            a_number = np.concatenate([np.zeros(len(early), np.int64), number[sure]])
            all_roots = roots(a_id, a_lat, a_lon, a_day, a_number) if len(a_id) else a_id
            root[sure] = all_roots[len(early) :]
            out = [pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(r)], [*names, "_root"]) for b, r in zip(held, np.split(root, np.cumsum([b.num_rows for b in held])[:-1]), strict=True)]
            if len(early):  # what a root of the chunk before has become
                ends = np.unique(np.stack([early, all_roots[: len(early)]]), axis=1)
                ends = ends[:, ends[0] != ends[1]]
                both = np.concatenate([ends[0], ends[0]]), np.concatenate([ends[0], ends[1]])
                fill = {"id": pa.array(both[0]), "_home": pa.array(np.zeros(len(both[0]), bool)), "_shared": pa.array(np.ones(len(both[0]), bool))}
                out.append(pa.RecordBatch.from_arrays([*(fill[c] if c in fill else pa.nulls(len(both[0]), table.schema.field(c).type) for c in names), pa.array(both[1])], [*names, "_root"]))
            last = a_number == number[-1]
            if not last.any():
                return out, None
            last &= a_day >= a_day[last].max() - eps_days
            spots = np.unique(np.stack([a_lat[last], a_lon[last], a_day[last].astype(float)]), axis=1, return_index=True)[1]
            return out, (tuple(keys[:, -1]), all_roots[last][spots], a_lat[last][spots], a_lon[last][spots], a_day[last][spots])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= chunk_rows:
                out, kept = told(held, kept)
                yield from out
                held, rows = [], 0
        if held:
            yield from told(held, kept)[0]

    return run


def linked_in_blocks(det: DataFrame, eps_m: float, eps_days: int, most_lat: float = AREA_LAT, chunk_rows: int = CHUNK_ROWS, chunk_pairs: int = CHUNK_PAIRS, few: int = FEW_PAIRS) -> DataFrame:
    """Rows (id, lat, lon, acq_date, ...) with _root, the smallest id that they reach inside a block; _home: a row itself, not a copy
    of it or a link between chunks; _shared: rows of the same id with other roots are to be joined with it."""
    days = max(BLOCK_DAYS, eps_days)
    finite = (F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf")) & F.col("acq_date").isNotNull()  # other rows are near nothing
    day = F.datediff(F.col("acq_date"), F.lit("1970-01-01").cast("date"))
    i, j = cells_of(F.col("lat"), F.col("lon"), eps_m, most_lat)
    celled = det.withColumn("_day", day).withColumns({"_i": F.when(finite, i), "_j": F.when(finite, j)})
    # a row in the first cells of a block is near the block before it
    back = lambda hit: F.explode(F.when(hit, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    at = celled.withColumn("_x", back(F.pmod("_i", F.lit(BLOCK_CELLS)) == 0)).withColumn("_y", back(F.pmod("_j", F.lit(BLOCK_CELLS)) == 0)).withColumn("_t", back(finite & (F.pmod("_day", F.lit(days)) < eps_days)))
    home = (F.col("_x") == 0) & (F.col("_y") == 0) & (F.col("_t") == 0)
    near = (F.pmod("_i", F.lit(BLOCK_CELLS)) == 0) | (F.pmod("_j", F.lit(BLOCK_CELLS)) == 0) | (finite & (F.pmod("_day", F.lit(days)) < eps_days))
    spread = lambda column, width, back: F.floor(F.col(column) / width).cast("long") - F.col(back)
    other = F.xxhash64("id")  # spreads rows without a block
    rest = [c for c in det.columns if c not in ("id", "lat", "lon")]
    dealt = at.select(
        "id", "lat", "lon", *(F.when(home, F.col(c)).alias(c) for c in rest), "_day", home.alias("_home"), F.coalesce(near, F.lit(False)).alias("_shared"),
        F.when(finite, spread("_day", days, "_t")).otherwise(0).alias("_bt"), F.coalesce(spread("_i", BLOCK_CELLS, "_x"), other).alias("_bi"), F.coalesce(spread("_j", BLOCK_CELLS, "_y"), F.lit(0)).alias("_bj"),
    )
    sorted_rows = dealt.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "_day")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in dealt.schema if f.name not in (*BLOCK, "_day")] + [T.StructField("_root", T.LongType())])
    return stored(sorted_rows.mapInArrow(_linker(eps_m, eps_days, most_lat, chunk_rows, chunk_pairs, few, EARTH_RADIUS_M), schema), "linked")
