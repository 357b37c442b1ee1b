from emberline.llm import simhash
from emberline.operators import graph


def test_no_table_of_fingerprints_goes_through_the_driver(spark, small, monkeypatch):
    """Tables that Spark believes small were broadcast, several at once: more than a driver with a small heap holds."""
    plans = []

    def seen(write):
        def kept(df, *args):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return write(df, *args)

        return kept

    for module, name in ((simhash, "stored"), (graph, "stored"), (graph, "observed")):
        monkeypatch.setattr(module, name, seen(getattr(module, name)))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    again = docs.selectExpr("doc_id + 1000000 as doc_id", "concat(text, ' once more') as text")  # near copies, so that all rounds run
    out = simhash.near_duplicates(docs.unionByName(again))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 2 * docs.count()
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_quality_learns_from_every_labelled_row(spark):
    """Rows beyond the first thousands count: a model of 5,300 rows has the mean of all of them, its cut leaves out the poor share, and it
    loses nothing on fresh pairs against a fit in memory."""
    import numpy as np

    from emberline.llm import quality

    rng = np.random.default_rng(5)
    y = (rng.random(8000) < 0.8).astype(int)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma", "12", "!"] if good else ["!!", "x9", "|", "AA", "alpha"], rng.integers(5, 12))) for good in y]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, quality int")
    used = [r[0] for r in labels.filter(quality.fold("doc_id", 3) != 1).collect()]
    x = np.array([quality.features(texts[k]) for k in used])
    model = quality.train(docs, labels)
    assert len(used) > 5000 and np.allclose(model["mean"], x.mean(0))
    passed = quality.apply(model, x) >= 0.5
    assert abs(passed.mean() - y[used].mean()) < 2e-3
    local = quality.fit(x, y[used], float(y[used].mean()))
    assert (passed == (quality.apply(local, x) >= 0.5)).mean() > 0.98


def test_coded_data_that_look_like_a_header_leave_frames_together():
    """A header inside plain samples, with any number or with the very next one: the frames are still found all at once, and the samples come back."""
    import numpy as np

    from emberline.llm import flac

    rng = np.random.default_rng(8)
    whole = rng.integers(0, 256, (9, 192)).astype(np.uint8)
    stream = flac.encode_many([whole.tobytes()])[0]
    at = flac.Info(stream).first
    buf = np.frombuffer(stream, np.uint8)
    frames = flac.find_frames(buf, np.array([at]), np.array([len(buf)]), np.array([9]))
    heads = {k: buf[a : a + n] ^ 0x80 for k, (a, n) in enumerate(zip(frames, flac.headers(buf, frames)["length"], strict=True))}
    for planted in (6, 1, 0, 3):
        odd = whole.copy()
        odd[2 if planted == 3 else 0, 50 : 50 + len(heads[planted])] = heads[planted]
        streams = flac.encode_many([whole.tobytes(), odd.tobytes(), whole[:2].tobytes()])
        sizes = np.array([len(s) for s in streams])
        last = np.cumsum(sizes)
        first = last - sizes + np.array([flac.Info(s).first for s in streams])
        found = flac.find_frames(np.frombuffer(b"".join(streams), np.uint8), first, last, np.array([9, 9, 2]))
        assert found is not None and len(found) == 20
        assert flac.decode_many(streams) == [whole.tobytes(), odd.tobytes(), whole[:2].tobytes()]


def test_toxicity_learns_from_every_labelled_row(spark):
    """A stem that only rows beyond the first 2,500 of each class would show in its true share has its weight from all rows: the model is that of
    a fit in memory over all of them. Of several texts of a doc_id the smallest trains."""
    import numpy as np

    from emberline.llm import toxicity

    rng = np.random.default_rng(4)
    y = np.arange(8000) % 10 == 0
    texts = [" ".join(rng.choice(["grunk", "mild", "stone"] if bad else ["mild", "stone", "river", "cloud"], 4)) for bad in y]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, toxic int")
    used = [r[0] for r in labels.filter(toxicity.fold("doc_id", 5) != 0).collect()]
    cells, weights, bias = toxicity.train(docs, labels)
    own = [toxicity.present(texts[k]) for k in used]
    n = [int((~y[used]).sum()), int(y[used].sum())]
    count = [np.bincount(np.concatenate([c for c, k in zip(own, used, strict=True) if y[k] == kind]), minlength=1 << toxicity.HASH_BITS) for kind in (0, 1)]
    z = np.abs(r := toxicity.ratios(*count, *n)) / np.sqrt(1 / (count[0] + 1) + 1 / (count[1] + 1))
    chosen = np.flatnonzero((np.round(z, 9) > 0) & (count[0] + count[1] >= toxicity.LEAST_TEXTS))
    assert n[0] > 5000 and len(chosen) <= toxicity.CELLS
    w, b = toxicity.descend([np.flatnonzero(np.isin(chosen, c)).astype(np.uint16) for c in own], y[used].astype(int), r[chosen])
    want = dict(zip(chosen.tolist(), w * r[chosen], strict=True))
    assert set(cells.tolist()) == {c for c, v in want.items() if abs(v) > 1e-3} and abs(bias - b) < 1e-6
    assert all(abs(v - want[c]) < 1e-5 for c, v in zip(cells.tolist(), weights.tolist(), strict=True))
    twice = docs.unionByName(docs.selectExpr("doc_id", "concat(text, ' zzz grunk') as text"))  # longer: the first ones count
    again = toxicity.train(twice, labels)
    assert (again[0] == cells).all() and (again[1] == weights).all() and again[2] == bias


def test_texts_are_encoded_and_decoded_by_one_worker_in_short_batches(spark, small):
    """Two workers a task, each with a model, and batches of 10,000 texts took more memory than a small executor has."""
    from emberline.llm import common, pieces
    from emberline.llm.queries import op13_sentencepiece_spans

    docs = common.table(spark, small, "documents")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert op13_sentencepiece_spans(spark, small)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    both, apart = pieces.encode(docs, decoded="again"), pieces.decode(pieces.encode(docs), out="again")
    assert sorted(map(repr, both.collect())) == sorted(map(repr, apart.collect()))


def test_chunks_that_come_again_outlive_a_full_cache(monkeypatch):
    from emberline.llm import pieces

    monkeypatch.setattr(pieces, "CACHED_CHUNKS", 50)
    model = pieces.PieceModel(pieces.Path(__import__("public_tokenizers").path(pieces.MODEL)).read_bytes())
    first = [model.encode(f"again word{k}")[0].tolist() for k in range(150)]
    work, model._scanned = model._scanned, lambda symbols: seen.append("".join(symbols)) or work(symbols)
    seen = []
    second = [model.encode(f"again word{k}")[0].tolist() for k in range(150)]
    assert first == second and not any("again" in s for s in seen) and len(model) <= 50 and len(model.older) <= 50
