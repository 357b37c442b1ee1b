"""The pipeline against a brute-force version of its stages on small rows."""

import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from emberline.llm import bpe, packing, quality, simhash, toxicity
from emberline.llm.queries import ORACLES, QUERIES
from tests.helpers import oracle_rows, rows_of
from tests.llm.test_operators import DOCS, ITEM, best_fit, components, prose, reference_fingerprint


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(21)
    rows, marks = [], []
    for k in range(200):
        words = prose(k if k % 10 else 1, rng.randrange(20, 200) if k % 10 else 150).split()
        toxic, poor = k % 5 == 1, k % 5 == 2
        if toxic:
            for _ in range(1 + len(words) // 20):
                words.insert(rng.randrange(len(words)), "grunk")
        text = " ".join(w.upper() + "!!" for w in words[:12] * 5) if poor else " ".join(words)
        if k % 33 == 3:
            text += " " + ITEM
        rows.append((k, text, "en", "s", len(text)))
        marks.append((k, 0 if poor else 1, int(toxic)))
    rows += [(300, None, "en", "s", 0), (301, "", "en", "s", 0), (302, prose(77, 9000), None, None, None), (4, rows[4][1], "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_pipeline_matches_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = [tuple(r) for r in docs.collect()]
    frame = lambda kept: spark.createDataFrame(kept, DOCS)
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    rows = [r for r in rows if scorer.margins([r[1]])[0] < 0]
    model = quality.train(frame(rows), labels)
    rows = [r for r in rows if quality.apply(model, np.array([quality.features(r[1])]))[0] >= 0.5]
    assert not {r[0] for r in rows} & {k for k in range(200) if k % 5 in (1, 2)}
    least = components([r[0] for r in rows], [reference_fingerprint(r[1]) for r in rows])
    rows = list({c: r for r, c in reversed(list(zip(rows, least, strict=True))) if r[0] == c}.values())
    rows = [r for r in rows if ITEM not in (r[1] or "")]
    coder = bpe.ChunkEncoder(bpe.default_tokenizer())
    lengths = [(r[0], a, n) for r in rows for a, n in packing.cut(len(coder.encode(r[1])) // 4 + 1, packing.SIZE)]
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in got) == sorted(lengths)
    histogram = defaultdict(int)
    for _, _, n in lengths:
        histogram[n] += 1
    assert len({r["sequence_id"] for r in got}) == best_fit(histogram, packing.SIZE)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, small, name):
    df = QUERIES[name](spark, small)
    expected, columns = oracle_rows(ORACLES[name], small)
    assert sorted(df.columns) == columns and rows_of(df) == expected


def test_simhash_query_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    prints = [reference_fingerprint(r["text"]) for r in docs]
    want = {r["doc_id"]: (f"{p:016x}", c) for r, p, c in zip(docs, prints, components([r["doc_id"] for r in docs], prints), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash_golay"](spark, small).collect()} == want
    assert simhash.MOST_BITS == 4
