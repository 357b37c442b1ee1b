import inspect
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from emberline import queries
from emberline.plans import boosting, learning


def test_registered_model_has_the_reference_rounds_and_depth():
    given = inspect.signature(learning.fit_boosted).parameters
    assert (given["rounds"].default, given["depth"].default) == (100, 4)
    assert "rounds=" not in inspect.getsource(queries.inference_rows)


def brute_tree(bins, g, h, size, leaves, depth, rate, least_rows):
    """Grow leaf by leaf, trying every threshold of every feature at every step."""

    def best(rows):
        found = None
        G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
        for f in range(len(bins[0])):
            for b in range(size):
                left = [i for i in rows if bins[i][f] <= b]
                right = [i for i in rows if bins[i][f] > b]
                if min(len(left), len(right)) < least_rows:
                    continue
                hl, hr = sum(h[i] for i in left), sum(h[i] for i in right)
                if min(hl, hr) < 1e-3:
                    continue
                gain = sum(g[i] for i in left) ** 2 / hl + sum(g[i] for i in right) ** 2 / hr - G**2 / H
                if gain > 1e-15 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, f, b, left, right)
        return found

    held, out = {1: list(range(len(bins)))}, {}
    while len(held) < leaves:
        options = [(best(rows), n) for n, rows in held.items() if n < 1 << depth]
        options = [(s, n) for s, n in options if s]
        if not options:
            break
        split, n = max(options, key=lambda x: (x[0][0], -x[1]))
        out[n] = split[1:3]
        held[2 * n], held[2 * n + 1] = split[3], split[4]
        del held[n]
    return out, {n: -rate * sum(g[i] for i in rows) / sum(h[i] for i in rows) for n, rows in held.items()}


def table(spark, n=240, seed=6):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)) * 4) / 4
    y = np.array(list("abc"))[np.argmax(np.c_[x[:, 0] + rng.normal(size=n) / 3, x[:, 1] ** 2, 1.2 - x[:, 0] * x[:, 2]], 1)]
    x[rng.random((n, 3)) < 0.05] = np.nan
    w = rng.choice([1.0, 2.5], n)
    rows = [(str(y[k]), float(w[k]), Vectors.dense(x[k])) for k in range(n)]
    return x, y, w, spark.createDataFrame(rows, ["label", "weight", "features"])


def test_gradients_splits_and_trees_are_those_of_brute_force(spark):
    x, y, w, df = table(spark)
    model = boosting.fit(df.repartition(3), "label", "weight", rounds=3, leaves=5, depth=3, least_rows=6)
    classes = ["a", "b", "c"]
    bins = boosting.to_bins(x, model.cuts)
    assert model.classes == classes and all((bins[:, f] == 0).sum() == np.isnan(x[:, f]).sum() for f in range(3))
    totals = [w[y == c].sum() for c in classes]
    scores = np.tile([math.log(t / w.sum()) for t in totals], (len(y), 1))
    size = max(map(len, model.cuts)) + 2
    for trees in model.trees:
        p = [[math.exp(s) / sum(math.exp(v) for v in row) for s in row] for row in scores]
        steps = np.zeros_like(scores)
        for k, c in enumerate(classes):
            g = [(p[i][k] - (y[i] == c)) * w[i] for i in range(len(y))]
            h = [p[i][k] * (1 - p[i][k]) * w[i] * 1.5 for i in range(len(y))]
            splits, values = brute_tree(bins.tolist(), g, h, size, 5, 3, 0.1, 6)
            tree = trees[k]
            assert {n: (tree.feature[n], tree.bin[n]) for n in tree.feature} == splits
            assert tree.value == pytest.approx(values, rel=1e-9)
            steps[:, k] = tree.values(bins)
        scores = scores + steps
    assert len(model.trees) == 3
    assert np.allclose(model.probabilities(x), boosting.softmax(scores))


def test_partitions_and_kept_scores_make_no_difference(spark, monkeypatch):
    x, y, _, df = table(spark, 400, 8)
    whole = boosting.fit(df, "label", "weight", rounds=4)
    monkeypatch.setattr(boosting, "ROWS_A_PART", 40)
    monkeypatch.setattr(boosting, "KEEP_ROUNDS", 2)
    monkeypatch.setattr(boosting, "MERGED", 2)
    parted = boosting.fit(df, "label", "weight", rounds=4)
    assert np.allclose(whole.probabilities(x), parted.probabilities(x), atol=1e-9)
    again = boosting.SoftmaxBoost.from_json(whole.to_json())
    scored = again.transform(df).collect()
    assert all(abs(r["prob_a"] + r["prob_b"] + r["prob_c"] - 1) < 1e-12 for r in scored)
    assert sum(r["label"] == r["predicted_class"] for r in scored) > 0.7 * len(scored)
    assert whole.featureImportances.sum() == sum(len(t.feature) for trees in whole.trees for t in trees)


def test_odd_tables(spark):
    one = spark.createDataFrame([("a", Vectors.dense([1.0])), ("a", Vectors.dense([2.0])), (None, Vectors.dense([3.0]))], ["label", "features"])
    assert {r["predicted_class"] for r in boosting.fit(one, "label").transform(one).collect()} == {"a"}
    with pytest.raises(ValueError):
        boosting.fit(one.filter("label = 'z'"), "label")
    same = spark.createDataFrame([(c, Vectors.dense([float("nan")])) for c in "ab" * 30], ["label", "features"])
    rows = boosting.fit(same, "label", rounds=2).transform(same).collect()
    assert {round(r["prob_a"], 9) for r in rows} == {0.5} and {r["predicted_class"] for r in rows} == {"a"}
