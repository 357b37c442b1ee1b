"""The rollup of token counts against plain dictionaries: interleaved writers, dead writers, snapshots, null and repeated ids."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberline.llm import bpe, token_counts
from emberline.llm.token_counts import CHANGE, Rollup
from tests.helpers import oracle_rows, rows_of
from tests.llm.test_operators import DOCS, docs, no_docs, prose  # noqa: F401


@pytest.fixture()
def rows(spark):
    return lambda *r: spark.createDataFrame(r, CHANGE)


def totals(store):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in store.totals().collect()}


def test_rollup(spark, rows):
    store = Rollup(spark)
    assert totals(store) == {}
    first = rows(("insert", "1", "a", "en", "v1", 10, 0), ("insert", "2", "a", "en", "v1", 5, 0), ("insert", "3", None, None, "v1", 7, 0), ("insert", "1", "a", "en", "v1", 10, 0), ("insert", None, "a", "en", "v1", 1, 0)).withColumn("old", F.lit("clash")).withColumn("docs", F.lit("clash"))
    assert store.commit("b1", first) and totals(store) == {("a", "en", "v1"): (3, 16), (None, None, "v1"): (1, 7)}
    assert not store.commit("b1", first) and totals(store) == {("a", "en", "v1"): (3, 16), (None, None, "v1"): (1, 7)}
    assert store.commit("b2", rows(("revise", "1", "b", "en", "v1", 11, 0), ("delete", "3", None, None, "v1", 0, 0), ("delete", "99", None, None, "v1", 0, 0), ("insert", "1", "a", "en", "v2", 4, 0), ("delete", None, None, None, "v1", 0, 0)))
    assert totals(store) == {("a", "en", "v1"): (1, 5), ("b", "en", "v1"): (1, 11), ("a", "en", "v2"): (1, 4)}
    assert store.commit("b3", rows(("revise", "2", "a", "en", "v1", 6, 1), ("delete", "2", None, None, "v1", 0, 2)))
    assert ("a", "en", "v1") not in totals(store)
    assert store.commit("b4", rows().limit(0)) and ("b", "en", "v1") in totals(store)
    # of changes with one seq the largest op, then the most tokens
    assert store.commit("b5", rows(("insert", "7", "a", "en", "v1", 3, 5), ("insert", "7", "a", "en", "v1", 8, 5), ("delete", "7", "a", "en", "v1", 99, 5))) and totals(store)[("a", "en", "v1")] == (1, 8)
    # a second reader of the same folder sees the same; tables of an attempt that has no record don't count
    store.attempt(store.prepare(rows(("insert", "50", "x", "en", "v1", 500, 0))), store.state())
    assert totals(Rollup(spark, store.folder)) == totals(store) and ("x", "en", "v1") not in totals(store)


def test_interleaved_batches_are_applied_one_after_the_other(spark, rows):
    """Two writers read the same version; the second to publish starts again and sees what the first has done."""
    a, b = Rollup(spark), None
    a.commit("first", rows(("insert", "1", "s", "en", "v", 6, 0), ("insert", "2", "s", "en", "v", 4, 0)))
    b = Rollup(spark, a.folder)
    real, done = b.attempt, []

    def attempt(new, state):
        name = real(new, state)
        if not done:  # the other writer comes first, between this one's reading and its record
            done.append(a.commit("delete", rows(("delete", "1", None, None, "v", 0, 0))))
        return name

    b.attempt = attempt
    assert b.commit("revise", rows(("revise", "1", "s", "en", "v", 9, 0))) and done == [True]
    assert totals(a) == totals(b) == {("s", "en", "v"): (2, 13)}
    assert [x for x, _ in a.state().attempts] == ["first", "delete", "revise"]
    # one version can be published once, and a draft that lost leaves nothing
    assert not a.publish(3, {"batch": "other", "attempt": "x"}) and a.state().version == 3


def test_a_batch_that_two_writers_bring_counts_once(spark, rows):
    a = Rollup(spark)
    b = Rollup(spark, a.folder)
    batch = rows(("insert", "1", "s", "en", "v", 6, 0))
    new = a.prepare(batch)
    state = a.state()
    left, right = a.attempt(new, state), b.attempt(new, state)
    assert a.publish(1, {"batch": "x", "attempt": left}) and not b.publish(1, {"batch": "x", "attempt": right})
    assert not b.commit("x", batch) and totals(b) == {("s", "en", "v"): (1, 6)}


def test_snapshots_change_nothing(spark, rows):
    store, plain = Rollup(spark, compact_every=2), {}
    for k in range(5):
        store.commit(f"b{k}", rows(("insert", str(k), "s", "en", "v", k + 1, 0), ("revise", "0", "t", "en", "v", 10 * k, 0)))
        plain |= {str(k): ("s", k + 1)} | {"0": ("t", 10 * k)}
        want = Counter()
        for source, tokens in plain.values():
            want[source] += tokens
        assert {s: t for (s, _, _), (_, t) in totals(store).items()} == {s: t for s, t in want.items()}
    state = store.state()
    assert state.snapshot and len(state.attempts) < 2 and store.committed("b0") and not store.commit("b1", rows(("insert", "9", "s", "en", "v", 100, 0)))
    assert store.ledger().count() <= 5 + 3


def test_one_definition_for_one_version(spark):
    """Every text counts by the later definition, whether it has a digit or not."""
    frame = spark.createDataFrame([(1, "a - b", "en", "s", 0), (2, "a - b 7", "en", "s", 0), (3, "a b", "en", "s", 0)], DOCS)
    got = {r["tokenizer"]: r["tokens"] for r in token_counts.maintained_totals(frame, {}).collect()}
    assert got["words-1"] == 6


def test_rollup_over_documents(spark, docs, no_docs, tmp_path):  # noqa: F811
    own = docs.select(*[c.split()[0] for c in DOCS.split(", ")])
    more = [(None, "no id", None, None, 0), (None, "also none", "en", "s", 0), (5, "another text of five", "en", "s", 0), (77, prose(2, 900), "fr", "t", 0)]
    own = own.unionByName(spark.createDataFrame(more, DOCS))
    own.write.parquet(str(tmp_path / "documents.parquet"))
    expected, _ = oracle_rows(token_counts.oracle(), str(tmp_path))
    assert rows_of(token_counts.maintained_totals(docs.unionByName(spark.createDataFrame(more, DOCS), allowMissingColumns=True), {})) == expected
    assert token_counts.maintained_totals(no_docs).count() == 0
    # with the vocabulary: every different text once, under the smallest doc_id that has it
    model = bpe.ChunkEncoder(bpe.default_tokenizer())
    live = {}
    for r in own.collect():
        rank = (r["doc_id"] is None, r["doc_id"] or 0)
        text = r["text"] or ""
        if text not in live or rank < live[text][0]:
            live[text] = (rank, r["source"], r["lang"])
    want = Counter()
    for text, (_, source, lang) in live.items():
        want[(source, lang)] += len(model.model.encode(text, add_special_tokens=False).ids)
    got = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in token_counts.maintained_totals(own).filter("tokenizer = 'byte_bpe_50k'").collect()}
    assert {k: t for k, (_, t) in got.items()} == dict(want) and sum(d for d, _ in got.values()) == len(live)
