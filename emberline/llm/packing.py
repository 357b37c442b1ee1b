"""Best-fit packing planned over counts of lengths: the driver places at most one number per length, never documents.

1. Workers encode whole texts, append the end id, and cut what is longer than a sequence into whole sequences, with the
   shorter rest first. Each piece is a row of numbers, written to the shared folder.
2. The histogram of piece lengths has at most `size` rows. Best-fit decreasing runs over it: lengths fall, and each goes
   to the open sequence with the least room that holds it. Sequences with equal room are one range of ids, so placing a
   million equal pieces costs as much as placing one. The outcome is a short list of runs: ranks a..b of a length go to
   sequences s, s+1, ..., q pieces in each, from an offset.
3. Every piece gets its rank within its length (two-level, so that a length with a third of all pieces is split) and
   takes the slot of the run that covers its rank.

Defined results: null and empty texts are one end token; repeated rows are packed each; an empty table gives an empty
result; a doc_id that repeats or is null stays one; pieces of one length that tie in doc_id, piece and checksum share the
slots that they take in any order; other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_tokenizer, encoder
from .common import gapless_rank, rank_buckets, stored

SIZE = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUNS = "run_length long, first_rank long, last_rank long, first_sequence long, per_sequence long, first_offset long"
#: A list of runs this long takes some 10 MB, and is broadcast up to here; a longer one is joined by a shuffle.
BROADCAST_RUNS = 200_000


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole sequences, with the shorter rest first."""
    first = total % size or size
    return [(0, first), *((at, size) for at in range(first, total, size))]


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece of each document."""
    name = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = encoder(name), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(model.encode(text.as_py()) + end)
                for k, (at, n) in enumerate(cut(len(ids) // 4, size)):
                    rows.append((doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths. Returns runs (length, first rank, last rank, first sequence, pieces a
    sequence, first offset): rank r of the length is piece (r - first) of the run."""
    rooms: list[int] = []  # the different rooms of open sequences, rising
    open_by_room: dict[int, list[tuple[int, int]]] = {}  # room: ranges (first id, how many)
    runs: list[tuple[int, int, int, int, int, int]] = []
    fresh = 0

    def leave(room: int, first: int, many: int) -> None:
        if room <= 0 or not many:
            return
        if room not in open_by_room:
            open_by_room[room] = []
            insort(rooms, room)
        open_by_room[room].append((first, many))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(at)
            else:
                room, first, many = size, fresh, -(-left // (size // length))
                fresh += many
            each = room // length  # best fit keeps filling the same sequence while the piece still fits
            full = min(many, left // each)
            if full:
                runs.append((length, rank, rank + full * each - 1, first, each, size - room))
                leave(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < many:  # fewer pieces are left than one sequence takes
                runs.append((length, rank, rank + left - 1, first + full, left, size - room))
                leave(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            leave(room, first + full, many - full)
    return runs


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece: where it starts in its document, and its sequence and offset there."""
    spark = docs.sparkSession
    cut_up = stored(pieces(docs, size, tokenizer), "pieces")
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    runs = plan(histogram, size)
    slots = spark.createDataFrame(runs, RUNS)
    ranked = gapless_rank(cut_up, "length", F.struct("doc_id", "piece", "ids_crc32"), ["doc_id", "piece", "ids_crc32"], rank_buckets(sum(histogram.values())), "_rank")
    at = F.col("_rank") - F.col("first_rank")
    return ranked.join(
        F.broadcast(slots) if len(runs) <= BROADCAST_RUNS else slots,
        (F.col("length") == F.col("run_length")) & F.col("_rank").between(F.col("first_rank"), F.col("last_rank")),
    ).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (at % F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )
