"""Events kept in streaming state: a detection is linked when it arrives, and an event is written once, when nothing can join it.

Rows arrive with the day of the run that fetched them (`seen`), which is the stream's event time. A run fetches the last
WINDOW_DAYS days, so a row whose day lies before that window of its own run is late; it is counted and left out, whatever
batch it comes in. Once the watermark says that no run up to a day will come any more, no accepted row can be older than the
window that ends there, and what ended a day or more before it is closed.

The key of the state is a tile of the map. A detection goes to its own tile and, near a border, to the tiles it could link
into, as a copy that is linked but not counted. A tile's state holds the detections that can still be linked or sent again (a
window of days, not the history) and, for each of its open pieces of events, sums, a convex hull, and the border detections with
the tiles that have them. A timer closes pieces by watermark. An event that touches several tiles leaves a closed piece in each; they share
border detections, so `assemble` joins them, and keeps them until every tile that has one of their detections has sent its piece.

`assemble` runs in each batch and appends closed events to a store as parts of a table, with the batch's number in the same
manifest, so a replayed batch changes nothing and no event is rewritten. Its work grows with the batch, not with the history.

Defined results: a row without a place, day, run day or time is left out; repeated keys count once (of several in a batch the one
with the smallest run day, then the smallest other columns); an empty stream gives no events. Events of one detection are dropped at
the end, as elsewhere. Rows of one run belong into one batch or consecutive ones. What is open can be read from the
checkpoint by `open_pieces`.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.geo import EARTH_RADIUS_M, haversine
from ..functions.scalars import settled
from ..operators.events import EPS_DAYS, EPS_METRES, LEAST_DETECTIONS
from ..operators.graph import connected_components
from ..operators.spatial import AREA_LAT
from ..plans.storage import stored
from ..sources.ingest import WINDOW_DAYS
from .cycle import KEY, keyed
from .store import Lease, Store

TILE_DEGREES = 0.25
#: How long after the newest run's day rows of an earlier run may still come, in event time.
DELAY = "1 day"
#: Points of a piece's outline that are kept before it is reduced to its convex hull.
OUTLINE = 32
DAY_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

NODES = "id long, lat double, lon double, day int, piece long"
PIECES = (
    "piece long, n long, first int, last int, lat double, lon double, frp double, max_frp double, night long, "
    "hull array<double>, nodes array<long>, tiles array<string>"
)
OUT = f"kind string, tile string, {PIECES}"
COLUMNS = [c.split()[0] for c in PIECES.split(", ")]


def _steps(metres: float, most_lat: float) -> tuple[float, float]:
    return metres / 110_500, metres / (111_100 * math.cos(math.radians(most_lat)))


def copies(rows: DataFrame, eps_m: float = EPS_METRES, tile: float = TILE_DEGREES, most_lat: float = AREA_LAT) -> DataFrame:
    """Rows with `home` and `tiles`, one for each of the tiles that a partner within the distance may lie in.

    A tile is wider than twice the distance, so the corners of the box around a point lie in all of them.
    """
    north, east = _steps(eps_m, most_lat)
    if tile <= 2 * max(north, east):
        raise ValueError("a tile must be wider than twice the distance")
    name = lambda lat, lon: F.concat_ws("_", F.floor(lat / tile).cast("string"), F.floor(lon / tile).cast("string"))
    corners = [name(F.col("lat") + a * north, F.col("lon") + b * east) for a in (-1, 1) for b in (-1, 1)]
    placed = rows.withColumns({"home": name(F.col("lat"), F.col("lon")), "tiles": F.array_sort(F.array_distinct(F.array(*corners)))})
    return placed.withColumn("tile", F.explode("tiles"))


def arrivals(stream: DataFrame, eps_m: float = EPS_METRES, tile: float = TILE_DEGREES) -> DataFrame:
    """What the state needs of a stream of detections with `seen`, spread over tiles and with its watermark."""
    rows = keyed(stream).withColumn("id", F.xxhash64(*KEY))
    place = lambda c, text: F.col(c).cast("double") if c in stream.columns else F.expr(f"try_cast({text} as double)")
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    plain = rows.select(
        "id", place("lat", "latitude").alias("lat"), place("lon", "longitude").alias("lon"), day("acq_date").alias("day"), day("seen").alias("run"),
        F.coalesce(F.expr("try_cast(frp as double)"), F.lit(0.0)).alias("frp"), F.coalesce(F.col("daynight") == "N", F.lit(False)).alias("night"), F.col("seen").cast("date").cast("timestamp").alias("seen"),
    )
    whole = plain.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("day").isNotNull() & F.col("run").isNotNull())
    return copies(whole, eps_m, tile).withWatermark("seen", DELAY)


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The corners of the convex hull: the farthest point from anywhere is one of them."""
    spots = sorted(set(points))
    if len(spots) < 3:
        return spots
    chains = []
    for line in (spots, spots[::-1]):
        chain: list[tuple[float, float]] = []
        for p in line:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) < 0:
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return list(dict.fromkeys(chains))


def _metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


class _Tile:
    """One tile's open pieces and the detections that can still be linked, as plain values."""

    def __init__(self, nodes: list[tuple], pieces: list[tuple], eps_m: float, eps_days: int):
        self.eps_m, self.eps_days = eps_m, eps_days
        self.north, self.east = _steps(eps_m, AREA_LAT)
        self.nodes = {n[0]: tuple(n[1:4]) for n in nodes}
        self.of = {n[0]: n[4] for n in nodes}
        self.pieces = {p[0]: dict(zip(COLUMNS[:9], p[:9], strict=True)) | {"hull": list(zip(p[9][::2], p[9][1::2], strict=True)), "nodes": dict(zip(p[10], p[11], strict=True))} for p in pieces}
        self.root: dict[int, int] = {}
        self.spots: dict[tuple, int] = {}
        self.cells: dict[tuple, list[int]] = {}
        for k in self.nodes:
            self._index(k)

    def _cell(self, lat: float, lon: float) -> tuple[int, int]:
        return math.floor(lat / self.north), math.floor(lon / self.east)

    def _index(self, k: int) -> bool:
        """Detections at one place on one day are found by the first of them; whether this is it."""
        lat, lon, day = self.nodes[k]
        if (lat, lon, day) in self.spots:
            return False
        self.spots[lat, lon, day] = k
        self.cells.setdefault((*self._cell(lat, lon), day), []).append(k)
        return True

    def find(self, piece: int) -> int:
        while piece in self.root:
            piece = self.root[piece]
        return piece

    def _join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a == b:
            return
        keep, gone = min(a, b), max(a, b)
        x, y = self.pieces[keep], self.pieces.pop(gone)
        for c in ("n", "lat", "lon", "frp", "night"):
            x[c] += y[c]
        x["first"], x["last"], x["max_frp"] = min(x["first"], y["first"]), max(x["last"], y["last"]), max(x["max_frp"], y["max_frp"])
        x["hull"] = self._outline(x["hull"] + y["hull"])
        x["nodes"] |= y["nodes"]
        self.root[gone] = keep

    @staticmethod
    def _outline(points: list) -> list:
        return points if len(points) <= OUTLINE else _hull(points)

    def add(self, row: Row, counted: bool) -> None:
        """A detection of this tile, or a copy of a neighbour's, which is linked but not counted."""
        k = row["id"]
        if k in self.nodes:
            return
        place = (row["lat"], row["lon"])
        self.nodes[k], self.of[k] = (*place, row["day"]), k
        own = {"n": 1, "lat": place[0], "lon": place[1], "frp": row["frp"], "max_frp": row["frp"], "night": int(row["night"]), "hull": [place]}
        none = {"n": 0, "lat": 0.0, "lon": 0.0, "frp": 0.0, "max_frp": -math.inf, "night": 0, "hull": []}
        self.pieces[k] = {"piece": k, "first": row["day"], "last": row["day"], **(own if counted else none), "nodes": {k: ",".join(row["tiles"])} if len(row["tiles"]) > 1 else {}}
        if not self._index(k):
            self._join(self.of[self.spots[*place, row["day"]]], k)
            return
        i, j = self._cell(*place)
        for day in range(row["day"] - self.eps_days, row["day"] + self.eps_days + 1):
            for a in (i - 1, i, i + 1):
                for b in (j - 1, j, j + 1):
                    for other in self.cells.get((a, b, day), ()):
                        if other != k and _metres(self.nodes[other][:2], place) <= self.eps_m:
                            self._join(self.of[other], k)

    def closed(self, oldest: int) -> list[dict]:
        """Pieces that no detection of day `oldest` or later can join, taken out; detections that can't be linked any more go."""
        done = [p for p, x in self.pieces.items() if x["last"] + self.eps_days < oldest]
        out = [self.pieces.pop(p) for p in done]
        gone = [k for k, n in self.nodes.items() if n[2] + self.eps_days < oldest]
        for k in gone:
            del self.nodes[k], self.of[k]
        return out

    def node_rows(self) -> list[tuple]:
        return [(k, *n, self.find(self.of[k])) for k, n in self.nodes.items()]

    def piece_rows(self) -> list[tuple]:
        return [_values(x) for x in self.pieces.values()]


def _values(x: dict) -> tuple:
    """A piece as a row: its hull as latitudes and longitudes in turn, its border detections and, beside each, the tiles that have it."""
    return (*(x[c] for c in COLUMNS[:9]), [v for p in _hull(x["hull"]) for v in p], sorted(x["nodes"]), [x["nodes"][k] for k in sorted(x["nodes"])])


class TilePieces(StatefulProcessor):
    """The state of a tile: rows are linked as they come, a timer closes pieces."""

    def __init__(self, eps_m: float = EPS_METRES, eps_days: int = EPS_DAYS, window_days: int = WINDOW_DAYS):
        self.eps_m, self.eps_days, self.window_days = eps_m, eps_days, window_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.nodes, self.pieces = handle.getListState("nodes", NODES), handle.getListState("pieces", PIECES)

    def _oldest(self, timer_values) -> int:
        """The first day that a row can have which is neither late nor behind the watermark."""
        return timer_values.getCurrentWatermarkInMs() // DAY_MS - (self.window_days - 1)

    def _load(self) -> _Tile:
        return _Tile([tuple(r) for r in self.nodes.get()], [tuple(r) for r in self.pieces.get()], self.eps_m, self.eps_days)

    def _save(self, tile: _Tile) -> None:
        for state, rows in ((self.nodes, tile.node_rows()), (self.pieces, tile.piece_rows())):
            if rows:
                state.put(rows)
            else:
                state.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        name = key[0]
        tile = self._load()
        late = 0
        best: dict[int, Row] = {}
        for row in rows:
            if row["day"] <= row["run"] - self.window_days:
                late += row["home"] == name
                continue
            held = best.get(row["id"])
            if row["id"] not in tile.nodes and (held is None or (row["run"], row["frp"], row["night"]) < (held["run"], held["frp"], held["night"])):
                best[row["id"]] = row
        before = {x["last"] for x in tile.pieces.values()}
        for k in sorted(best):
            tile.add(best[k], best[k]["home"] == name)
        for last in {x["last"] for x in tile.pieces.values()} - before:
            self.handle.registerTimer((last + self.eps_days + self.window_days) * DAY_MS - 1)
        self._save(tile)
        if late:
            yield Row(kind="late", tile=name, piece=0, n=late, first=None, last=None, lat=None, lon=None, frp=None, max_frp=None, night=None, hull=[], nodes=[], tiles=[])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        tile = self._load()
        done = tile.closed(self._oldest(timerValues))
        self._save(tile)
        for x in done:
            yield Row(kind="piece", tile=key[0], **dict(zip(COLUMNS, _values(x), strict=True)))

    def close(self) -> None:
        pass


def pieces(stream: DataFrame, eps_m: float = EPS_METRES, eps_days: int = EPS_DAYS, tile: float = TILE_DEGREES) -> DataFrame:
    """The stream of closed pieces and counts of late rows."""
    rows = arrivals(stream, eps_m, tile)
    return rows.groupBy("tile").transformWithState(TilePieces(eps_m, eps_days), OUT, "Append", "EventTime")


def _every_other(first: int) -> Column:
    return F.filter("hull", lambda _, k: k % 2 == first)


def whole_events(rows: DataFrame) -> DataFrame:
    """Events from pieces with an `event`: sums of sums, and the extent from the outlines."""
    joined = rows.groupBy("event").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), (F.sum("lat") / F.sum("n")).alias("clat"), (F.sum("lon") / F.sum("n")).alias("clon"), (F.sum("frp") / F.sum("n")).alias("mean"),
        F.max("max_frp").alias("max_frp"), (F.sum("night") / F.sum("n")).alias("night"), F.min("piece").alias("stable_key"), F.flatten(F.collect_list(F.arrays_zip(_every_other(0).alias("lat"), _every_other(1).alias("lon")))).alias("hull"),
    )
    extent: Column = F.array_max(F.transform("hull", lambda p: haversine(p["lat"], p["lon"], F.col("clat"), F.col("clon"))))
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c))
    return joined.filter(F.col("n") >= LEAST_DETECTIONS).select(
        "stable_key", day("first").alias("start_date"), day("last").alias("end_date"), (F.col("last") - F.col("first") + 1).alias("duration_days"), settled("clat", 6).alias("centroid_lat"), settled("clon", 6).alias("centroid_lon"),
        settled(extent, 1).alias("spatial_extent_m"), F.col("n").alias("detection_count"), settled("mean", 3).alias("mean_frp"), "max_frp", settled("night", 4).alias("night_fraction"),
    )


def linked(rows: DataFrame) -> DataFrame:
    """(piece rows, event, whole): pieces that share border detections are one event, which is whole if every tile that has one
    of its border detections has sent its piece. rows: stored, with a number `f` each."""
    nodes = stored(rows.select("f", F.col("tile").alias("_own"), F.explode(F.arrays_zip("nodes", "tiles")).alias("node")).select("f", "_own", F.col("node.nodes").alias("id"), F.split("node.tiles", ",").alias("tiles")), "border")
    first = nodes.groupBy("id").agg(F.min("f").alias("g"))
    parts = connected_components(nodes.join(first, "id").select("f", "g"), "f", "g")
    named = rows.select("f").join(parts, F.col("f") == F.col("node"), "left").select("f", F.coalesce("component", "f").alias("event"))
    met = nodes.join(named, "f").groupBy("event", "id").agg(F.count_distinct("_own").alias("have"), F.max(F.size("tiles")).alias("want"))
    lacking = met.filter(F.col("have") < F.col("want")).select("event").distinct().withColumn("_lacking", F.lit(True))
    return rows.join(named, "f").join(lacking, "event", "left").withColumn("whole", F.col("_lacking").isNull()).drop("_lacking")


def assemble(store: Store, batch: DataFrame, number: int) -> dict:
    """Close what a batch completes: whole events are appended, pieces that wait for others are kept, late rows are counted.

    A batch that the store has published changes nothing, so a batch may be replayed.
    """
    with Lease(store) as lease:
        manifest = store.manifest()
        if number <= int(manifest.get("_batch", "-1")):
            return {"status": "replayed"}
        after, pending = (store.manifests() or [0])[-1], {"_batch": str(number)}
        came = stored(batch, "pieces")
        waiting = store.read("waiting")
        late = came.filter("kind = 'late'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        new = came.filter("kind = 'piece'").drop("kind")
        alone = new.filter(F.size("nodes") == 0).withColumn("event", F.concat_ws(":", "tile", "piece"))
        border = new.filter(F.size("nodes") > 0)
        border = border if waiting is None else border.unionByName(waiting)
        marked = stored(linked(stored(border.withColumn("f", F.monotonically_increasing_id()), "numbered")), "linked")
        done = alone.unionByName(marked.filter("whole").withColumn("event", F.concat(F.lit("f:"), F.col("event").cast("string"))).select(*alone.columns))
        closed = stored(whole_events(done), "closed")
        sizes = {"closed": closed.count(), "late": int(late), "waiting": marked.filter("not whole").count()}
        if sizes["closed"]:
            store.write_parts("closed", closed.withColumn("batch", F.lit(number)), "batch", pending, lease)
        if sizes["waiting"] or waiting is not None:
            store.write("waiting", marked.filter("not whole").select(*new.columns), pending, lease)
        pending["_late"] = str(int(manifest.get("_late", "0")) + sizes["late"])
        store.publish(pending, after, lease)
        store.clean(lease=lease)
        return {"status": "updated", **sizes}


def closed_events(store: Store) -> DataFrame | None:
    """All events that are closed, each once."""
    found = store.read("closed")
    return None if found is None else found.drop("batch")


def late_rows(store: Store) -> int:
    return int(store.manifest().get("_late", "0"))


def start(stream: DataFrame, store: Store, checkpoint: str, once: bool = False, interval: str = "30 minutes", eps_m: float = EPS_METRES, eps_days: int = EPS_DAYS, tile: float = TILE_DEGREES) -> StreamingQuery:
    """Run on a stream of detections with `seen`: every interval, or over what is there. The session needs the RocksDB state store."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    writer = pieces(stream, eps_m, eps_days, tile).writeStream.foreachBatch(lambda batch, number: assemble(store, batch, number))
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append").queryName(f"live-{uuid.uuid4().hex}")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def open_pieces(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(tile, piece, n, first, last, ...): the open pieces that the last batch left in the state."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "pieces").option("flattenCollectionTypes", "true").load()
    return rows.select(F.col("key.tile").alias("tile"), "list_element.*")
