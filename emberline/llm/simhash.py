"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the perfect binary Golay code
(23, 12), in which every word decodes to one codeword at distance 3 at most. For a word w, near(w) are the codewords that
w and its 23 neighbours at one flipped bit decode to: six at most. Words at distance 1 give: decode(x) is in near(y).

Fingerprints that differ in 4 bits at most leave (pigeonhole over the segments) either

* a segment without an error: both have its value, which is a key; or
* errors in all three, so two segments have exactly one each: for those, (decode(a), decode(b)) of one fingerprint is
  among near(a') x near(b') of the other. One side gives 1 index key, the other up to 36 probe keys, for 3 segment pairs.

Keys are joined and the difference of the whole fingerprints is verified in the join itself, so only links leave it. To
keep a group of near copies from giving all its pairs, segment keys first link every fingerprint to the smallest one with
the same key, if they are near; components of those links are found; then the joins look only for links between
different components. That loses none: components of the two kinds of links are those of all links.

The components of the first links are the nodes of the second search, so that only links between them are followed again.

Equal fingerprints are one node, made by an aggregation with partial sums, so exact copies cost nothing further. A segment
that a large group shares, and a component or fingerprint with most rows, are skewed sides of joins that are dealt out for
the join alone, so adaptive execution splits them. Tables of fingerprints are joined by sorting (`graph.merged`): none goes
through the driver, however small Spark believes it to be.

Defined results: null and empty texts and texts without words have fingerprint zero, linked like any other; a null doc_id
is its own row and counts after all others; repeated rows each keep their row; equal smallest doc_ids name the same
component; an empty table gives an empty result; other columns, whatever their names, are not carried by near_duplicates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.graph import anew, connected_components, merged
from .common import stored

WORDS_PER_SHINGLE = 4
MOST_BITS = 4
SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)
GENERATOR = 0xC75  # of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str | None) -> int:
    """64 bits, each set if more than half of the shingle hashes have it set."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    n = WORDS_PER_SHINGLE
    # the words joined once; a shingle is the bytes between two word starts
    encoded = [w.encode("utf-8", "replace") for w in words]
    joined, ends, at = b" ".join(encoded), [], -1
    for w in encoded:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :])] if len(words) >= n else [digest(joined, SEED)]  # noqa: B905
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        block = np.array(hashes[k : k + 4096], ">u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, out: str = "fp") -> DataFrame:
    """The rows with all their columns and the fingerprint of `text`, as a signed long in the column `out`."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(names.index("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, LongType())]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


@cache
def decoder() -> np.ndarray:
    """The number of the nearest codeword (its 12 message bits) for each of the 2^23 words."""
    words = np.arange(1 << 23, dtype=np.uint32)

    def remainder(w: np.ndarray) -> np.ndarray:
        w = w.copy()
        for bit in range(22, 10, -1):
            w ^= np.where(w >> bit & 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
        return w

    ones = [1 << k for k in range(23)]
    patterns = [0, *ones, *(a | b for a in ones for b in ones if a < b), *(a | b | c for a in ones for b in ones if a < b for c in ones if b < c)]
    error = np.zeros(1 << 11, np.uint32)
    error[remainder(np.array(patterns, np.uint32))] = patterns
    return ((words ^ error[remainder(words)]) >> 11).astype(np.int16)


def near(words: np.ndarray) -> np.ndarray:
    """The codewords of each word and its neighbours: (n x 6), -1 where there are fewer. The first is the word's own."""
    table = decoder()
    found = np.stack([table[words], *(table[words ^ np.uint32(1 << k)] for k in range(23))], 1)
    rest = np.sort(found, 1)
    fresh = np.concatenate([np.ones((len(rest), 1), bool), rest[:, 1:] != rest[:, :-1]], 1) & (rest != found[:, :1])
    out = np.full((len(rest), 6), -1, np.int64)
    out[:, 0] = found[:, 0]
    rows, at = np.nonzero(fresh)
    place = (np.cumsum(fresh, 1)[rows, at]).astype(np.int64)
    out[rows, place] = rest[rows, at]
    return out


def pair_keys(fps: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys) of the segment pairs: one key a pair for the index side, up to 36 for the probing side."""
    sets = [near((fps >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)) for shift, bits in SEGMENTS]
    rows, keys = [], []
    for kind, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        x, y = sets[a][:, :, None], sets[b][:, None, :]
        if not probe:
            x, y = x[:, :1], y[:, :, :1]
        key = (kind << 24 | x << 12 | y).reshape(len(fps), -1)
        row, at = np.nonzero(((x >= 0) & (y >= 0)).reshape(len(fps), -1))
        rows.append(row)
        keys.append(key[row, at])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(nodes: DataFrame, probe: bool) -> DataFrame:
    """(key, fp, part) rows of the segment pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, part = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for k in range(0, len(fps), 2000):
                rows, keys = pair_keys(fps[k : k + 2000].view(np.uint64), probe)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[k : k + 2000][rows]), pa.array(part[k : k + 2000][rows])], ["key", "fp", "part"])

    return nodes.select("fp", "part").mapInArrow(run, "key long, fp long, part long")


def _segments(nodes: DataFrame) -> DataFrame:
    values = [F.lit(kind << 24).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))) for kind, (shift, bits) in enumerate(SEGMENTS)]
    return nodes.withColumn("key", F.explode(F.array(*values)))


def _differ(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def link_components(nodes: DataFrame) -> DataFrame:
    """(fp, component): the smallest fingerprint (as a signed long) reachable, for every node; its own if it links to none.

    nodes: (fp), each once.
    """
    keyed = _segments(nodes.select("fp"))
    least = keyed.groupBy("key").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(anew(F.col("key")).alias("_key"), "first")
    stars = keyed.join(merged(least), F.col("key") == F.col("_key")).filter((F.col("fp") != F.col("first")) & (_differ("fp", "first") <= MOST_BITS)).select(F.col("fp").alias("src"), F.col("first").alias("dst"))
    parts = connected_components(stars).select(F.col("node").alias("_fp"), F.col("component").alias("_part"))
    labelled = stored(nodes.select("fp").join(merged(parts), F.col("fp") == F.col("_fp"), "left").select("fp", F.coalesce("_part", "fp").alias("part")), "parts")

    def links(index: DataFrame, probe: DataFrame) -> DataFrame:
        other = probe.select(F.col("key").alias("_key"), F.col("fp").alias("_fp"), F.col("part").alias("_part"))
        same = (F.col("key") == F.col("_key")) & (F.col("part") != F.col("_part")) & (_differ("fp", "_fp") <= MOST_BITS)
        return index.join(merged(other), same).select(F.col("part").alias("src"), F.col("_part").alias("dst"))

    whole = _segments(labelled)
    mixed = whole.groupBy("key").agg(F.min("part").alias("_low"), F.max("part").alias("_high")).filter("_low < _high").select(anew(F.col("key")).alias("_mixed"))
    # read back, so that both sides of the join within keys are dealt out for it
    several = stored(whole.join(merged(mixed), F.col("key") == F.col("_mixed"), "left_semi"), "several")
    found = links(several, several).unionByName(links(_keyed(labelled, False), _keyed(labelled, True)))
    joined = connected_components(found).select(F.col("node").alias("_node"), "component")
    # a part with most fingerprints is a skewed side: the components are dealt out anew by their node
    return labelled.join(merged(joined), F.col("part") == F.col("_node"), "left").select("fp", F.coalesce("component", "part").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row with its fingerprint and the smallest doc_id of its component."""
    prints = stored(fingerprints(docs), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    linked = stored(nodes.withColumnRenamed("fp", "_node").join(merged(link_components(nodes)), F.col("_node") == F.col("fp")).select("fp", "first_doc", "component"), "linked")
    smallest = linked.groupBy("component").agg(F.min("first_doc").alias("component_id")).select(anew(F.col("component")).alias("_component"), "component_id")
    named = linked.join(merged(smallest), F.col("component") == F.col("_component")).select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(merged(named), F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(rows: DataFrame, fp: str, row: str) -> DataFrame:
    """(row): of each component the row with the smallest doc_id (null last) and then the smallest row number.

    rows: doc_id, a fingerprint and a row number, which no two rows share.
    """
    order = F.struct(F.col("doc_id").isNull().alias("_none"), F.col("doc_id").alias("_doc"), F.col(row).alias("_row"))
    nodes = stored(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("first")), "nodes")
    linked = nodes.withColumnRenamed("fp", "_node").join(merged(link_components(nodes)), F.col("_node") == F.col("fp"))
    return linked.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first._row").alias(row))
