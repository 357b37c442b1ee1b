"""Boosted trees for several classes at once: softmax gradients, binned features, trees that grow by their best leaf.

A round makes one tree for each class from the same gradients. Features are cut into at most BINS bins at quantiles of the
training rows; a missing value has a bin below all others. A pass over the rows fills histograms: for each class, open node,
feature and bin the sums of gradients, second derivatives and rows. A task returns its sums as one row, tasks' sums meet in groups,
and the driver gets at most MERGED of them; their size hangs on bins and nodes, not on rows. A round takes a pass for each level, as
all nodes of a level share one; what a split of a node gains doesn't depend on when it is made, so choosing the best leaves
afterwards, up to `leaves`, gives the tree that growing leaf by leaf gives. Scores of rows are written every KEEP_ROUNDS rounds.

Defined results: rows without a label are not trained on; with one class everything is that class; an empty table raises;
equal gains take the first feature and the lowest bin; equal probabilities the first class by name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

BINS, LEAVES, DEPTH, ROUNDS, RATE = 255, 15, 4, 100, 0.1
LEAST_ROWS, LEAST_HESSIAN = 20, 1e-3
KEEP_ROUNDS = 10
#: Sums of tasks that the driver adds up; more are added in as many groups first.
MERGED = 32
ROWS_A_PART = 50_000


@dataclass
class Tree:
    """Node 1 is the root, node k has children 2k and 2k + 1; bins up to the node's go left."""

    feature: dict[int, int] = field(default_factory=dict)
    bin: dict[int, int] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        at = np.ones(len(bins), np.int64)
        for node in sorted(self.feature):
            here = at == node
            at[here] = 2 * node + (bins[here, self.feature[node]] > self.bin[node])
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        table = np.zeros(max(self.value, default=1) + 1)
        for node, v in self.value.items():
            table[node] = v
        return table[self.nodes(bins)]


def to_bins(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """0 for a missing value, else 1 and up: a value equal to a cut belongs below it."""
    out = np.empty(x.shape, np.int32)
    for k, c in enumerate(cuts):
        out[:, k] = np.where(np.isnan(x[:, k]), 0, np.searchsorted(np.array(c), x[:, k], side="left") + 1)
    return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def derivatives(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and second derivatives of the softmax loss by class; the latter with the factor K / (K - 1) of K classes."""
    p, k = softmax(scores), scores.shape[1]
    target = np.zeros_like(p)
    target[np.arange(len(y)), y] = 1.0
    return (p - target) * weight[:, None], p * (1 - p) * weight[:, None] * (k / (k - 1))


def histograms(bins: np.ndarray, gradients: np.ndarray, hessians: np.ndarray, trees: list[Tree], nodes: list[list[int]], size: int) -> np.ndarray:
    """Sums (open node, feature, bin, 3) of the classes' open nodes, one class after the other."""
    parts = []
    features = bins.shape[1]
    cell = np.arange(features) * size + bins
    for k, (tree, open_nodes) in enumerate(zip(trees, nodes, strict=True)):
        at = tree.nodes(bins)
        for node in open_nodes:
            here = at == node
            cells, many = cell[here].ravel(), features * size
            sums = [np.bincount(cells, np.repeat(v[here, k], features), many) for v in (gradients, hessians)]
            parts.append(np.stack([*sums, np.bincount(cells, minlength=many).astype(float)], 1).reshape(features, size, 3))
    return np.stack(parts) if parts else np.zeros((0, features, size, 3))


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    left: tuple[float, float]
    right: tuple[float, float]


def best_split(sums: np.ndarray, least_rows: int = LEAST_ROWS, least_hessian: float = LEAST_HESSIAN) -> Split | None:
    """The split of a node (feature, bin, 3) with the highest gain, if any gains something."""
    below = sums.cumsum(1)
    whole = below[:, -1:, :]
    above = whole - below
    allowed = (below[..., 2] >= least_rows) & (above[..., 2] >= least_rows) & (below[..., 1] >= least_hessian) & (above[..., 1] >= least_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = below[..., 0] ** 2 / below[..., 1] + above[..., 0] ** 2 / above[..., 1] - whole[..., 0] ** 2 / whole[..., 1]
    gain = np.where(allowed, gain, -np.inf)
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    if not gain[f, b] > 1e-15:
        return None
    return Split(float(gain[f, b]), int(f), int(b), tuple(below[f, b, :2].tolist()), tuple(above[f, b, :2].tolist()))


def grown(splits: dict[int, Split], leaves: int, rate: float, root: tuple[float, float]) -> Tree:
    """The tree that splits the leaf with the highest gain again and again; splits: those of all nodes that could be reached."""
    tree, sums = Tree(), {1: root}
    while len(sums) < leaves:
        best = max((n for n in sums if n in splits), key=lambda n: (splits[n].gain, -n), default=None)
        if best is None:
            break
        s = splits[best]
        tree.feature[best], tree.bin[best] = s.feature, s.bin
        del sums[best]
        sums[2 * best], sums[2 * best + 1] = s.left, s.right
    tree.value = {n: -rate * g / h if h > 0 else 0.0 for n, (g, h) in sums.items()}
    return tree


def _levels(splits: dict[int, Split], depth: int) -> Tree:
    """The tree with all splits found so far, to find the rows of the next level's nodes."""
    tree = Tree()
    for n, s in splits.items():
        if n < 1 << depth:
            tree.feature[n], tree.bin[n] = s.feature, s.bin
    return tree


def _merged(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of tasks' sums (part, sums as bytes), in the order of their parts."""
    many = parts.rdd.getNumPartitions()
    if many > MERGED:

        def add(group: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(b) for b in group.sort_values("part")["sums"])
            return pd.DataFrame({"part": [int(group["part"].min())], "sums": [total.tobytes()]})

        parts = parts.groupBy(F.pmod("part", F.lit(MERGED))).applyInPandas(add, "part int, sums binary")
    total = np.zeros(shape)
    for row in sorted(parts.collect(), key=lambda r: r["part"]):
        total += np.frombuffer(row["sums"]).reshape(shape)
    return total


class SoftmaxBoost(Transformer):
    """A fitted model: adds prob_<class> for each class and predicted_class. Input: a vector column."""

    def __init__(self, classes: list[str], cuts: list[list[float]], base: list[float], trees: list[list[Tree]], column: str = "features"):
        super().__init__()
        self.classes, self.cuts, self.base, self.trees, self.column = classes, cuts, base, trees, column

    def scores(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), len(self.classes))) + (np.array(self.base) if not first else 0.0)
        for trees in self.trees[first:]:
            for k, tree in enumerate(trees):
                out[:, k] += tree.values(bins)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.scores(to_bins(x, self.cuts)))

    @property
    def featureImportances(self) -> np.ndarray:
        """How many splits each feature makes."""
        out = np.zeros(len(self.cuts))
        for trees in self.trees:
            for tree in trees:
                np.add.at(out, list(tree.feature.values()), 1.0)
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        whole = SoftmaxBoost.probabilities
        plain = _Plain(self.classes, self.cuts, self.base, self.trees)

        @F.pandas_udf("array<double>")
        def judged(x: pd.Series) -> pd.Series:
            return pd.Series(list(whole(plain, np.stack(x.to_list())))) if len(x) else pd.Series([], dtype=object)

        marked = dataset.withColumn("_p", judged(vector_to_array(self.column)))
        best = F.array_position(F.col("_p"), F.array_max("_p")).cast("int")
        out = marked.withColumns({f"prob_{c}": F.col("_p")[k] for k, c in enumerate(self.classes)})
        return out.withColumn("predicted_class", F.element_at(F.array(*map(F.lit, self.classes)), best)).drop("_p")

    def to_json(self) -> str:
        return json.dumps({"classes": self.classes, "cuts": self.cuts, "base": self.base, "trees": [[asdict(t) for t in trees] for trees in self.trees], "column": self.column})

    @classmethod
    def from_json(cls, text: str) -> SoftmaxBoost:
        held = json.loads(text)
        read = lambda t: Tree(**{name: {int(n): v for n, v in t[name].items()} for name in ("feature", "bin", "value")})
        return cls(held["classes"], held["cuts"], held["base"], [[read(t) for t in trees] for trees in held["trees"]], held["column"])


class _Plain:
    """What tasks need of a model, without the session's parts."""

    scores, probabilities = SoftmaxBoost.scores, SoftmaxBoost.probabilities

    def __init__(self, classes, cuts, base, trees):
        self.classes, self.cuts, self.base, self.trees = classes, cuts, base, trees


def cut_points(rows: DataFrame, features: int, bins: int = BINS) -> list[list[float]]:
    """For each place of the array column `x`, the different quantiles of its known values."""
    shares = [k / bins for k in range(1, bins)]
    known = lambda k: F.when(~F.isnan(F.col("x")[k]), F.col("x")[k])
    found = rows.agg(*(F.percentile_approx(known(k), shares, 10_000).alias(f"q{k}") for k in range(features))).first()
    return [sorted(set(map(float, found[k] or []))) for k in range(features)]


def fit(df: DataFrame, label: str, weight: str | None = None, column: str = "features", rounds: int = ROUNDS, leaves: int = LEAVES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least_rows: int = LEAST_ROWS) -> SoftmaxBoost:
    """Fit on a vector column. weight: a column of row weights, or none."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    plain = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), w.alias("w"), vector_to_array(column).alias("x"))
    found = plain.groupBy("label").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).orderBy("label").collect()  # a row for each class
    if not found:
        raise ValueError("there are no labelled rows")
    classes, features = [r["label"] for r in found], found[0]["d"]
    weights = np.array([r["w"] for r in found])
    base = np.log(weights / weights.sum()).tolist()
    if len(classes) == 1 or not features:
        return SoftmaxBoost(classes, [[] for _ in range(features)], base, [], column)
    kinds = F.array(*map(F.lit, classes))
    parts = max(1, -(-sum(r["n"] for r in found) // ROWS_A_PART))
    rows = stored(plain.select((F.array_position(kinds, F.col("label")) - 1).cast("int").alias("y"), "w", "x").repartition(parts, F.xxhash64("x", "y")), "training")
    cuts = cut_points(rows, features, bins)
    size = max(len(c) for c in cuts) + 2
    binned = _written(rows, cuts, base)
    model = SoftmaxBoost(classes, cuts, base, [], column)
    kept = 0
    for _ in range(rounds):
        if len(model.trees) - kept >= KEEP_ROUNDS:
            binned, kept = _moved(binned, model, kept), len(model.trees)
        since = model.trees[kept:]
        splits: list[dict[int, Split]] = [{} for _ in classes]
        roots: list[tuple[float, float]] = [(0.0, 0.0)] * len(classes)
        for level in range(depth):
            # at level 0 the root, else the children of what was split one level above
            nodes = [[c for n in sorted(s) if n >> level - 1 == 1 for c in (2 * n, 2 * n + 1)] if level else [1] for s in splits]
            if not any(nodes):
                break
            sums = _pass(binned, since, [_levels(s, level) for s in splits], nodes, size, features)
            at = 0
            for k, open_nodes in enumerate(nodes):
                for node in open_nodes:
                    if not level:
                        roots[k] = tuple(sums[at][0].sum(0)[:2].tolist())
                    split = best_split(sums[at], least_rows)
                    if split:
                        splits[k][node] = split
                    at += 1
        trees = [grown(s, leaves, rate, root) for s, root in zip(splits, roots, strict=True)]
        if not any(t.feature for t in trees):
            break
        model.trees.append(trees)
    return model


BINNED = "y int, w double, bins array<int>, scores array<double>"


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _written(rows: DataFrame, cuts: list[list[float]], base: list[float]) -> DataFrame:
    """The rows as bins, with the scores of no trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = to_bins(_matrix(batch.column(2), float), cuts)
                yield _batch(batch.column(0), batch.column(1), bins, np.tile(base, (len(bins), 1)))

    return stored(rows.mapInArrow(run, BINNED), "binned")


def _batch(y, w, bins: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    lists = lambda m, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))
    return pa.RecordBatch.from_arrays([y, w, lists(bins, pa.int32()), lists(scores, pa.float64())], ["y", "w", "bins", "scores"])


def _moved(binned: DataFrame, model: SoftmaxBoost, kept: int) -> DataFrame:
    """The rows with the scores of all trees so far."""
    since = model.trees[kept:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = _matrix(batch.column(2), np.int32)
                yield _batch(batch.column(0), batch.column(1), bins, _scores(bins, _matrix(batch.column(3), float), since))

    return stored(binned.mapInArrow(run, BINNED), "binned")


def _scores(bins: np.ndarray, scores: np.ndarray, since: list[list[Tree]]) -> np.ndarray:
    out = scores.copy()
    for trees in since:
        for k, tree in enumerate(trees):
            out[:, k] += tree.values(bins)
    return out


def _pass(binned: DataFrame, since: list[list[Tree]], trees: list[Tree], nodes: list[list[int]], size: int, features: int) -> np.ndarray:
    """Histograms of the open nodes over all rows."""
    shape = (sum(map(len, nodes)), features, size, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                bins = _matrix(batch.column(2), np.int32)
                scores = _scores(bins, _matrix(batch.column(3), float), since)
                gradients, hessians = derivatives(scores, batch.column(0).to_numpy(), batch.column(1).to_numpy())
                total += histograms(bins, gradients, hessians, trees, nodes, size)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    return _merged(binned.mapInArrow(run, "part int, sums binary"), shape)
