"""Whitening against a dense eigendecomposition, clustering against its SQL and plain loops."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest

from emberline.llm import clustering, whitening
from emberline.llm import queries as Q
from tests.helpers import oracle_rows, rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, x string, cluster string, deviation string"
NAN, INF = float("nan"), float("inf")


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], v, 0, "clash", "clash", "clash") for k, v in enumerate(vectors)], SCHEMA)


def sample(n, d, seed=3):
    random = np.random.default_rng(seed)
    return (random.standard_normal((n, d)) * np.linspace(2, 0.3, d)).astype(np.float32).tolist()


def odd(vectors):
    d = len(vectors[0])
    return [*vectors, None, [NAN] * d, [INF] + [0.0] * (d - 1), [None] + [0.0] * (d - 1), [], [1.0] * (d + 1), vectors[0], vectors[0], vectors[1]]


def brute_whitening(vectors, k):
    """Distinct integer vectors, their covariance in fractions' rounding, and LAPACK's eigenvectors."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    distinct = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(distinct), distinct.sum(0)
    z = np.array([[float(Fraction(int(n * c - s), n)) for c, s in zip(r, sums, strict=True)] for r in distinct])
    values, vectors_ = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:k]
    deviations = [int(sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True))) for r in x]
    every = np.array([[float(Fraction(int(n * c - s), n)) for c, s in zip(r, sums, strict=True)] for r in x])
    return n, deviations, every @ vectors_[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_is_that_of_a_dense_decomposition(spark):
    vectors = sample(300, 24)
    rows = whitening.whiten(frame(spark, odd(vectors)), 6).collect()
    kept = [*vectors, vectors[0], vectors[0], vectors[1]]
    ids = [*range(300), 306, 307, 308]
    n, deviations, want, explained = brute_whitening(kept, 6)
    assert n == 300 and len(rows) == len(kept) * 6
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert {r["n"] for r in rows} == {n}
    assert all(int(got[i, 1]["deviation"]) == deviations[k] for k, i in enumerate(ids))
    for c in range(6):
        line = np.array([got[i, c + 1]["whitened"] for i in ids])
        sign = np.sign(line @ want[:, c])
        assert np.allclose(line * sign, want[:, c], rtol=1e-9, atol=1e-9)
        assert got[0, c + 1]["explained"] == pytest.approx(explained[c], rel=1e-9)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-10


def test_whitening_of_few_directions(spark):
    """Fewer directions than components, one distinct vector, none, and an empty table."""
    flat = [[float(a), float(b), 0.0, float(a)] for a in range(4) for b in range(3)] * 2
    rows = whitening.whiten(frame(spark, flat), 16).collect()
    assert {r["component"] for r in rows} == {1, 2} and {r["n"] for r in rows} == {12} and rows[0]["identity_error"] < 1e-10
    n, deviations, _, explained = brute_whitening(flat, 2)
    assert sorted({round(r["explained"], 12) for r in rows}, reverse=True) == [round(float(e), 12) for e in explained]
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whiten(frame(spark, [None, [], [NAN]])).count() == 0
    assert whitening.whiten(frame(spark, [])).count() == 0


def test_block_lanczos_restarts_and_converges():
    random = np.random.default_rng(5)
    q = np.linalg.qr(random.standard_normal((90, 90)))[0]
    for values in (np.linspace(9, 1, 90), np.r_[[5.0] * 7, [1.0] * 83], np.r_[9.0, 4.0, [0.0] * 88], 2.0 ** -np.arange(90.0)):
        matrix = (q * values) @ q.T
        calls = []

        def multiply(b, matrix=matrix, calls=calls):
            calls.append(b.shape[1])
            return matrix @ b

        got, vectors, passes = whitening.block_lanczos(multiply, 90, 5, 4)
        assert np.allclose(got, np.sort(values)[::-1][:5], atol=1e-12 * 9) and passes == len(calls)
        assert np.allclose(vectors.T @ vectors, np.eye(5), atol=1e-12)
        assert np.abs(matrix @ vectors - vectors * got).max() < 1e-12 * 9
    assert not whitening.block_lanczos(lambda b: 0 * b, 90, 5, 4)[0].any()
    # well separated values are found before the basis is complete
    values = np.r_[[1e3, 9e2, 8e2], np.full(397, 1.0) * np.linspace(1, 0.9, 397)]
    q = np.linalg.qr(random.standard_normal((400, 400)))[0]
    _, _, passes = whitening.block_lanczos(lambda b: (q * values) @ (q.T @ b), 400, 3, 4)
    assert passes < 40


def test_large_entries_keep_exact_deviations():
    centre = whitening.Centre(3_000_000_000, (3_000_000_000 * 7 + 5, -11))
    x = np.array([[10**12, -5], [7, 0]], np.int64)
    want = [sum((centre.n * int(c) - s) ** 2 for c, s in zip(row, centre.sums, strict=True)) for row in x]
    assert centre.deviations(x) == want


def brute_lloyd(rows, clusters, rounds):
    x = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows]
    starts = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in x)[:clusters]
    centroids = [list(v) for _, v in starts]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in x:
            groups.setdefault(assign(v)[1], []).append(v)
        for k, vs in groups.items():
            centroids[k] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    found = [(i, *assign(v)[::-1]) for i, v in x]
    inertia = {}
    for _, k, d in found:
        inertia[k] = inertia.get(k, 0) + d
    return sorted((repr((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest())) for i, k, d in found))


def test_clustering_is_plain_lloyd(spark):
    vectors = sample(120, 5, 8)
    ids = [*range(120), *range(120, 126), 5, 5, None]
    rows = odd(vectors)
    df = frame(spark, rows, ids)
    kept = [(ids[k], v) for k, v in enumerate(rows) if v is not None and len(v) == 5 and all(c is not None and np.isfinite(c) for c in v)]
    for clusters in (1, 7, 200):
        got = clustering.cluster(df.repartition(5), clusters, 3, dimensions=5).collect()
        assert sorted(repr(tuple(r)) for r in got) == brute_lloyd(kept, clusters, 3)
    assert clustering.cluster(frame(spark, [])).count() == 0
    assert clustering.cluster(frame(spark, [None, [1.0]])).count() == 0


def test_distances_do_not_wrap():
    x = np.array([[1 << 31, -(1 << 31)], [0, 0]], np.int64)
    with pytest.raises(OverflowError):
        clustering.nearest(x, np.array([[-(1 << 31), 1 << 31]], np.int64))
    best, least = clustering.nearest(x // 4, np.array([[0, 0], [1 << 29, -(1 << 29)]], np.int64))
    assert best.tolist() == [1, 0] and least.tolist() == [0, 0]


def test_clustering_matches_its_sql(spark, small):
    expected, columns = oracle_rows(Q.ORACLES["op12_lloyd_centroids"], small)
    df = Q.op12_lloyd_centroids(spark, small)
    assert sorted(df.columns) == columns and rows_of(df) == expected


def test_whitening_of_the_test_table(spark, small):
    table = {r["vec_id"]: r["embedding"] for r in Q.table(spark, small, "embeddings").collect()}
    rows = Q.op11_block_lanczos_whitening(spark, small).collect()
    ids = list(table)
    n, deviations, want, explained = brute_whitening([table[i] for i in ids], 16)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(ids) * 16 and [got[i, 1]["deviation"] for i in ids] == deviations
    for c in range(16):
        line = np.array([got[i, c + 1]["whitened"] for i in ids])
        assert np.allclose(line * np.sign(line @ want[:, c]), want[:, c], rtol=1e-8, atol=1e-8)
        assert got[ids[0], c + 1]["explained"] == pytest.approx(explained[c], rel=1e-9)
