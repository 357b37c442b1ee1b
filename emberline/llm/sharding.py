"""Jump consistent hashing: stable keys to shards without a ring table, in built-in SQL functions only.

The published generator is a 64-bit linear congruential step, s' = s * 2862933555777941757 + 1 (mod 2^64). Spark's ANSI
arithmetic raises where that product wraps, so a state is held as two unsigned 32-bit halves in longs and multiplied in
16-bit limbs; no step leaves the signed 64-bit range. A key that is a long is its own first state; any other key is hashed.

Rows that defined results cover: a null key counts as 0; a null text has size 1 and checksum 0; repeated rows each keep
a slot of their own; rows that tie in key, checksum and size share the slots that they take in any order; an empty table
gives an empty result; other columns, whatever their names, are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, rank_buckets, stored, utf8

MULTIPLIER = 2862933555777941757
MASK32, MASK16 = 0xFFFFFFFF, 0xFFFF
_A_LOW, _A_HIGH = MULTIPLIER & MASK32, MULTIPLIER >> 32


def _and(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("long"))


def _times_mod32(x: Column, factor: int) -> Column:
    """x * factor modulo 2^32, for x below 2^32."""
    high = _and(x * F.lit(factor >> 16), MASK16)
    return _and(x * F.lit(factor & MASK16) + F.shiftleft(high, 16), MASK32)


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """The next state of the generator, as halves."""
    p0, p1 = low * F.lit(_A_LOW & MASK16), low * F.lit(_A_LOW >> 16)
    low_sum = p0 + F.shiftleft(_and(p1, MASK16), 16) + F.lit(1)
    carry = F.shiftright(low_sum, 32) + F.shiftright(p1, 16)
    new_high = _and(carry + _times_mod32(high, _A_LOW) + _times_mod32(low, _A_HIGH), MASK32)
    return new_high, _and(low_sum, MASK32)


def jump_hash(key: Column, shards: int, is_long: bool = True) -> Column:
    """The shard of a key, from 0 to shards - 1. Going from n to n + 1 shards moves 1 / (n + 1) of the keys, all to shard n.

    The jumps of a key number about ln(shards); the loop runs over at most 256 and raises if a key were not done by then.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = F.coalesce(key.cast("long"), F.lit(0).cast("long")) if is_long else F.xxhash64(key)
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(-1).cast("long").alias("b"), zero.alias("j"), _and(F.shiftrightunsigned(state, 32), MASK32).alias("high"), _and(state, MASK32).alias("low"))

    def jump(acc: Column, _: Column) -> Column:
        high, low = _step(acc["high"], acc["low"])
        draw = (F.shiftright(high, 1) + F.lit(1)).cast("double")
        nxt = F.floor((acc["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / draw)).cast("long")
        return F.when(acc["j"] < F.lit(shards), F.struct(acc["j"].alias("b"), nxt.alias("j"), high.alias("high"), low.alias("low"))).otherwise(acc)

    rounds = F.sequence(F.lit(1), F.lit(min(shards, 256)))
    done = lambda acc: F.when(acc["j"] >= F.lit(shards), acc["b"]).otherwise(F.raise_error(F.lit("a key needs more jumps")).cast("long"))
    return F.aggregate(rounds, start, jump, done).cast("int")


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard, its slot in the shard (gapless from 0) and its shard were one more appended.

    Slots are numbered in two levels (hash buckets inside a shard, then rows inside a bucket), so no task holds a shard, nor all
    rows of a key that a third of the table has.
    """
    kind = docs.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")
    rows = docs.select(
        F.col(key),
        (F.length(utf8(text)) + 1).cast("long").alias("size"),
        F.crc32(utf8(text)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(F.col(key), shards, kind).alias("shard"),
        jump_hash(F.col(key), shards + 1, kind).alias("grown_shard"),
    )
    held = stored(rows, "shards")  # without the texts
    return gapless_rank(held, "shard", F.struct(key, "text_crc32"), [F.col(key), F.col("text_crc32"), F.col("size")], rank_buckets(held.count())).select(
        key, "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
