"""Embedding whitening: principal components by matrix-free block Lanczos, then every vector projected on them.

Vectors become integers, so that centring is exact: n * x - S, with n distinct vectors and their sums S, is a whole number.
The covariance is never formed. A step of the iteration is one distributed pass that multiplies it with a block of
directions: each task takes its rows y and adds y'(yQ), and the d x b partial sums are merged by an aggregation on the
dimension. The driver holds the basis (d x d at most) and orthogonalises each new block against all of it, twice. A block
that loses rank is filled up with new random directions (a restart), so the basis can grow until it is complete. The
iteration ends when the residual of every wanted pair is at the level of rounding, or with a complete basis.

The trace needs no eigenvalues: it is the sum of the exact deviations over n^3. `identity_error` is measured: one more pass
takes the covariance of the whitened vectors.

Defined results: a null vector, or one with a null, NaN or infinite entry, gives no row; repeated vectors count once in the
fit and each gets its own rows; a null id stays null. Vectors must have one length: rows of another length than the most
frequent one (of equally frequent ones the longest) give no row, as do vectors of length 0. Only components with an
eigenvalue above rounding (1e-12 of the largest) are numbered, so fewer than asked where vectors have fewer directions;
with one distinct vector or an empty table there are none, and no rows. Equal eigenvalues have no order of their own:
any orthonormal basis of theirs is one. A component's largest entry is positive. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import integers, matrices

COMPONENTS = 16
FACTOR, PLUS = 64, 1_000_000
BLOCK = 16
SEED = 7
#: Eigenvalues under this share of the largest count as zero.
RANK = 1e-12
DEVIATION = pa.decimal128(38, 0)
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Centre:
    """Number of distinct vectors and their exact sums by dimension."""

    n: int
    sums: tuple[int, ...]

    def whole(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: long numbers where they fit, else Python's."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        if not len(x) or int(np.abs(x).max()) < 1 << 61 and (int(np.abs(x - base).max()) + 1) * self.n < 1 << 62:
            return (x - base) * self.n - rest
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return self.whole(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of squares of n * x - S of each row, exact."""
        y = self.whole(x)
        if y.dtype == object or not len(y) or int(np.abs(y).max()) ** 2 * y.shape[1] >= 1 << 63:
            return [int(sum(v * v for v in row)) for row in y.tolist()]
        return np.einsum("ij,ij->i", y, y).tolist()


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: centre, components (d x k), eigenvalues, shares of the trace, measured error, passes made."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ (self.components / np.sqrt(self.eigenvalues))


def fit_rows(rows: DataFrame) -> DataFrame:
    """Each distinct vector of the prevailing length once, written to the shared folder."""
    return stored(rows.select("x").distinct(), "fit-list")


def prevailing_length(rows: DataFrame) -> int:
    """The most frequent length, of equally frequent ones the longest; 0 without rows."""
    found = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found["d"] if found else 0


def _added(fit: DataFrame, d: int, width: int, per_batch) -> np.ndarray:
    """The sum of `per_batch(x)`, a d x width matrix for each chunk of rows, over all rows: partial sums of tasks meet in
    an aggregation by dimension, so the driver gets d rows."""
    schema = pa.schema([("dim", pa.int32()), ("part", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, width))
        seen = False
        for batch in batches:
            for _, x in matrices(batch, 0):
                total += per_batch(x)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], schema=schema)

    parts = fit.select("x").mapInArrow(run, "dim int, part array<double>")
    merged = parts.groupBy("dim").agg(*(F.sum(F.col("part")[k]).alias(f"s{k}") for k in range(width)))
    out = np.zeros((d, width))
    for row in merged.collect():
        out[row["dim"]] = row[1:]
    return out


def centre_of(fit: DataFrame, d: int) -> Centre:
    """n and the exact sums, from whole partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            for _, x in matrices(batch, 0):
                n += len(x)
                small = int(np.abs(x).max()) < 1 << 40
                total += x.sum(0).astype(object) if small else x.astype(object).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([int(t) for t in total], DEVIATION)], ["dim", "n", "total"]
            )

    parts = fit.select("x").mapInArrow(run, "dim int, n long, total decimal(38,0)")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()
    return Centre(found[0]["n"] if found else 0, tuple(int(r["total"]) for r in found))


def trace_of(fit: DataFrame, centre: Centre) -> float:
    """The covariance's trace: exact deviations over n^3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(centre.deviations(x)) for batch in batches for _, x in matrices(batch, 0))
        yield pa.RecordBatch.from_arrays([pa.array([total], DEVIATION)], ["total"])

    total = fit.select("x").mapInArrow(run, "total decimal(38,0)").agg(F.sum("total")).first()[0]
    return int(total or 0) / centre.n**3


def _independent(block: np.ndarray, basis: np.ndarray, scale: float) -> np.ndarray:
    """Orthonormal columns spanning what of the block is outside the basis. Directions whose rest is at the level of
    rounding are left out: that is a breakdown of the recurrence."""
    rest = block
    for _ in range(2):
        rest = rest - basis @ (basis.T @ rest)
    u, s, _ = np.linalg.svd(rest, full_matrices=False)
    held = s > scale * np.finfo(float).eps * np.sqrt(len(block)) * 8
    q = u[:, held]
    for _ in range(2):
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
    return q


def _fresh(basis: np.ndarray, width: int, random: np.random.Generator) -> np.ndarray:
    """Random orthonormal columns that are orthogonal to the basis: `width` of them, or as many as there is room for."""
    q = random.standard_normal((len(basis), min(width, basis.shape[0] - basis.shape[1])))
    for _ in range(3):
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
    return q


def block_lanczos(multiply, d: int, wanted: int, block: int = BLOCK, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, eigenvectors, passes) of the symmetric operator `multiply(Q)`, to double precision.

    Full reorthogonalisation: each product is orthogonalised against the whole basis, and the projected matrix is built
    from the products themselves. A block that loses directions is filled up with random ones outside the basis.
    """
    random = np.random.default_rng(seed)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    q = _fresh(basis, min(block, d), random)
    passes = 0
    while True:
        image = multiply(q)
        passes += 1
        basis, images = np.hstack([basis, q]), np.hstack([images, image])
        inside = basis.T @ images
        values, s = np.linalg.eigh((inside + inside.T) / 2)
        top = np.argsort(-values, kind="stable")[:wanted]
        scale = float(np.abs(values).max())
        if basis.shape[1] == d or scale == 0:
            break
        ritz = basis @ s[:, top]
        residual = np.linalg.norm(images @ s[:, top] - ritz * values[top], axis=0)
        found = len(top) == wanted and residual.max() <= scale * np.finfo(float).eps * np.sqrt(d)
        q = _independent(image, basis, scale)
        lost = min(block, d - basis.shape[1]) - q.shape[1]
        # what a Krylov space can't reach (a repeated eigenvalue's other vectors) shows only outside it, so a space that
        # has closed is left through random directions before its pairs count as the leading ones
        if found and lost <= 0:
            break
        q = q[:, : d - basis.shape[1]]
        if lost > 0:
            q = np.hstack([q, _fresh(np.hstack([basis, q]), lost, random)])
    vectors = basis @ s[:, top]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values[top], vectors * np.where(signs == 0, 1, signs), passes


def fit(rows: DataFrame, d: int, components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """Fit on the distinct vectors of length d; None where there is no direction to find."""
    distinct = fit_rows(rows)
    centre = centre_of(distinct, d)
    if centre.n < 2:
        return None

    def multiply(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            z = centre.centred(x)
            return z.T @ (z @ q)

        return _added(distinct, d, q.shape[1], part) / centre.n

    values, vectors, passes = block_lanczos(multiply, d, min(components, d), min(block, d))
    held = values > max(RANK * float(values.max(initial=0.0)), 0.0)
    values, vectors = values[held], vectors[:, held]
    if not len(values):
        return None
    k, across = len(values), vectors / np.sqrt(values)

    def part(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ across
        return np.hstack([w.T @ w, w.sum(0)[:, None]])

    moments = _added(distinct, k, k + 1, part) / centre.n
    covariance = moments[:, :k] - np.outer(moments[:, k], moments[:, k])
    return Whitening(centre, vectors, values, values / trace_of(distinct, centre), float(np.abs(covariance - np.eye(k)).max()), passes + 3)


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    k = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch, 1):
                m = len(x)
                every = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[at : at + m].take(every),
                        pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, model.centre.n), pa.int64()),
                        pa.array(model.centre.deviations(x), DEVIATION).take(every),
                        pa.array(model.project(x).ravel()),
                        pa.array(np.tile(model.explained, m)),
                        pa.array(np.full(m * k, model.identity_error)),
                    ],
                    [f.split()[0] for f in OUT.replace("decimal(38,0)", "decimal").split(", ")],
                )

    return rows.mapInArrow(run, OUT)


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding", factor: int = FACTOR, plus: int = PLUS) -> DataFrame:
    """Fit on a table's vectors and project all of them."""
    rows = integers(embeddings, id_column, vector_column, factor, plus)
    d = prevailing_length(rows)
    rows = rows.filter(F.size("x") == d)
    model = fit(rows, d, components) if d else None
    return whitened(rows, model) if model else embeddings.sparkSession.createDataFrame([], OUT)
