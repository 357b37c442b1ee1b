"""Stages that judge rows by themselves: repeated and missing ids, different texts under one id, clashing columns."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm import decontamination, simhash
from emberline.operators.graph import connected_components
from tests.llm.test_operators import DOCS, ITEM, components, prose, reference_fingerprint

CLASHES = ("row", "_row", "fp", "score", "_score", "y", "digest", "key", "part", "component", "first")


def extra(df):
    for name in CLASHES:
        df = df.withColumn(name, F.concat(F.lit(name), F.coalesce(F.col("text"), F.lit(""))))
    return df


def test_near_dedup_keeps_every_different_text(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3, k]), prose(k % 25, 150), "en", "s", k) for k in range(60)] + [(None, None, None, None, 0), (None, "", None, None, 0), (9, "two words", "en", "s", 0), (9, "other short text here", "en", "s", 0)]
    docs = extra(spark.createDataFrame(rows, DOCS))
    got = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    prints = [reference_fingerprint(r[1]) for r in rows]
    group = components(range(len(rows)), prints)
    kept = {}
    for r in got:
        assert r["key"] == "key" + (r["text"] or "")
        kept.setdefault(group[prints.index(reference_fingerprint(r["text"]))], []).append(r["doc_id"])
    assert set(kept) == set(group) and all(len(v) == 1 for v in kept.values())
    for g, (doc_id,) in kept.items():
        ids = [r[0] for r, c in zip(rows, group, strict=True) if c == g]
        assert doc_id == min((i for i in ids if i is not None), default=None)


def test_leaking_rows_go_by_their_text(spark):
    rows = [(None, f"{prose(1, 40)} {ITEM}"), (None, prose(2, 60)), (None, None), (7, ITEM), (7, prose(3, 50)), (7, ITEM), (8, "")]
    docs = extra(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS))
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted((str(r["doc_id"]), r["kind"]) for r in decontamination.leaks(docs, items).collect()) == [("7", "verbatim"), ("None", "verbatim")]
    got = decontamination.clean(docs, items)
    assert got.columns == docs.columns and sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(repr(r) for r in rows if ITEM not in (r[1] or ""))


def test_short_items_leak_as_whole_texts_only(spark):
    items = spark.createDataFrame([(1, "yes"), (2, "12 kg!"), (3, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Yes."), (2, "yes we say yes"), (3, "12 KG"), (4, "13 kg"), (5, "one, two three four"), (6, "One two: three")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["kind"]) for r in decontamination.leaks(docs, items).collect()) == [(1, 1, "whole"), (3, 2, "whole"), (6, 3, "whole")]


NAMES, THINGS, UNITS = ("Tom", "Ann", "Raj", "Mia", "Olu", "Zoe", "Ben", "Kim"), ("rice", "sand", "wool", "salt", "corn"), ("kg", "g", "lb", "tons")
FRAMES = (
    "{a} buys {x} {u} of {t}. {a} sells {y} {u} to {b}. {a} keeps the rest. How much {t} does {a} keep?",
    "{a} and {b} share {x} {u} of {t}. {b} takes {y} {u} more than {a}. How many {u} does each of them get?",
    "A train leaves {a} at {x} and reaches {b} after {y} hours. How fast does it go if the road is {z} km long?",
    "{a} has {x} bags. Each bag holds {y} {u} of {t}. {b} takes {z} {u}. What is left for {a}?",
)


def test_reparameterised_items_are_found(spark):
    """Recall on items with other names, numbers and units, in short sentences that begin with names; no false finds."""
    rng = random.Random(12)

    def fill(frame, t):
        a, b = rng.sample(NAMES, 2)
        return frame.format(a=a, b=b, x=rng.randint(20, 900), y=rng.randint(2, 19), z=rng.randint(901, 2000), u=rng.choice(UNITS), t=t)

    things = [rng.choice(THINGS) for _ in range(40)]
    items = [(k, fill(FRAMES[k % 4], things[k])) for k in range(40)]
    planted = [(k, f"{prose(k, 80).capitalize()}. {fill(FRAMES[k % 4], things[k])} {prose(k + 500, 80)}") for k in range(40)]
    clean = [(1000 + k, prose(2000 + k, 200) + f" {rng.choice(NAMES)} buys {k} kg of {rng.choice(THINGS)}.") for k in range(60)]
    docs = spark.createDataFrame(planted + clean, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((k, k) in found for k in range(40)) >= 0.9 * 40
    assert not {d for d, _ in found if d >= 1000}


def test_hub_joins_are_split(spark):
    """The joins of a hub with most edges are dealt out for themselves, so that adaptive execution can split them."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("-1", "16k", "16k", "false"), strict=True):
            spark.conf.set(k, v)
        from emberline.operators.graph import anew
        from emberline.plans.storage import stored

        hub = stored(spark.range(300_000).select(F.lit(0).cast("long").alias("u"), (F.col("id") + 1).alias("v")), "hub")
        least = hub.groupBy("u").agg(F.min("v").alias("m"))
        plans = []
        for side in (least, least.select(anew(F.col("u")).alias("u"), "m")):
            joined = hub.join(side, "u").agg(F.sum("m"))
            joined.collect()
            plans.append(joined._jdf.queryExecution().executedPlan().toString())
        assert "skew=true" not in plans[0] and "skew=true" in plans[1]
        star = spark.range(1, 3000).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
        assert {r["component"] for r in connected_components(star).collect()} == {0}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_large_groups_with_one_segment(spark):
    """Many fingerprints that share a segment, in several components, against all pairs."""
    rng = random.Random(3)
    base = rng.getrandbits(42) << 22
    prints = {base | rng.getrandbits(22) for _ in range(150)} | {base ^ (1 << 60) | rng.getrandbits(22) for _ in range(150)}
    prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in list(prints)[:80]}
    names = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = components(names, [n & (1 << 64) - 1 for n in names])
    got = {r["fp"]: r["component"] for r in simhash.link_components(spark.createDataFrame([(n,) for n in names], "fp long")).collect()}
    assert got == dict(zip(names, want, strict=True))
