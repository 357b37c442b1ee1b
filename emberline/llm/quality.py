"""Quality: Bradley-Terry pairwise ranking over features of whole texts, cut at a score quantile.

A text has strength exp(s), s = w . x over standardised features; a good text is preferred over a poor one with
probability sigmoid(s_good - s_poor). w minimises the logistic loss over preference pairs, which is a logistic regression
on feature differences. Every labelled training row takes part: each meets PAIRS_EACH texts of the other class, drawn by a hash of its
doc_id from their numbers. Pairs are written once; each of Newton's steps is a pass over them that leaves one sum for each entry.

The threshold is a quantile of the scores of all training rows, found by counting within ever smaller ranges, weighted so that classes have their shares among all labelled
training rows: the quantile is the share of poor rows. A score is sigmoid((s - threshold) / spread), so 0.5 is the cut.
Between the highest poor and the lowest good score next to the quantile the cut is put midway.

Features are computed per text, on its own, without a shuffle: shares of symbols, digits, capitals, marks, lengths of words
and lines, shares of repeated words, word pairs and lines.

Defined results: null and empty texts have the features of no words; repeated rows score alike and train once, a doc_id
with several texts trains on the smallest of them; a doc_id that is labelled twice counts as good if one label says so;
labels of documents that are missing or null are no training rows; a score of exactly 0.5 predicts 1; without rows of both
classes every text scores 1; an empty table gives an empty result; other columns of `documents`, whatever their names, are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold, gapless_rank, labelled_rows, rank_buckets, stored

PAIRS_EACH = 8
L2 = 1e-3
STEPS = 40
FOLDS, HELD_OUT = 3, 1
SEED = 7
#: Ranges that scores are counted in at once, and different scores that the driver gets at most.
RANGES = 1000
FEATURES = (
    "symbols", "digits", "capitals", "exclamations", "bars", "commas", "stops", "spaces", "word_length", "long_words",
    "repeated_words", "repeated_pairs", "repeated_lines", "top_word", "log_words", "short_sentences", "mixed_words", "log_line",
)
_LETTERS = re.compile(r"[^\W\d_]", re.UNICODE)


def features(text: str | None) -> list[float]:
    t = text or ""
    n = max(1, len(t))
    words = t.split()
    m = max(1, len(words))
    count = t.count
    codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes[codes < 128]
    kinds = np.bincount(low, minlength=128)
    letters = int(kinds[65:91].sum() + kinds[97:123].sum() + (codes >= 0xC0).sum())
    capitals = sum(map(str.isupper, t)) if letters != kinds[65:91].sum() + kinds[97:123].sum() else int(kinds[65:91].sum())
    digits = int(kinds[48:58].sum())
    plain = letters + digits + int(kinds[[9, 10, 13, 32, 33, 39, 44, 45, 46, 63, 58, 59, 34, 40, 41]].sum())
    often = Counter(words)
    different = len(often)
    pairs = set(zip(words, words[1:], strict=False))
    lines = [x for x in t.split("\n") if x]
    top = max(often.values(), default=0)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    stops = int(kinds[[33, 46, 63]].sum())
    return [
        (n - plain) / n if t else 0.0,
        digits / n,
        capitals / max(1, letters),
        count("!") / m,
        count("|") / m,
        count(",") / m,
        stops / m,
        float(kinds[32]) / n,
        float(lengths.mean()),
        float((lengths > 12).mean()),
        1 - different / m if words else 0.0,
        1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        top / m,
        float(np.log1p(len(words))),
        stops / max(1, len(lines)) if lines else 0.0,
        sum(not w.isalpha() for w in words) / m,
        float(np.log1p(len(t) / max(1, len(lines)))),
    ]


def fit(x: np.ndarray, y: np.ndarray, good_share: float) -> dict | None:
    """What `train` finds, for few rows in memory and with other drawn pairs: the model from features, labels (1 good) and the share of good rows among all labelled training rows."""
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        return None
    mean, spread = x.mean(0), x.std(0)
    spread[spread == 0] = 1.0
    z = np.clip((x - mean) / spread, -8, 8)
    draw = np.random.default_rng(SEED)
    a = np.concatenate([np.repeat(good, PAIRS_EACH), draw.choice(good, len(poor) * PAIRS_EACH)])
    b = np.concatenate([draw.choice(poor, len(good) * PAIRS_EACH), np.repeat(poor, PAIRS_EACH)])
    difference = z[a] - z[b]
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):  # Newton's method
        p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
        gradient = -(difference * p[:, None]).mean(0) + L2 * w
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / len(a) + L2 * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    weight = np.where(y == 1, good_share / len(good), (1 - good_share) / len(poor))
    order = np.argsort(s, kind="stable")
    below = np.cumsum(weight[order])
    at = min(int(np.searchsorted(below, 1 - good_share + 1e-12)), len(s) - 1)
    threshold = float((s[order][max(at - 1, 0)] + s[order][at]) / 2)
    return {"mean": mean, "spread": spread, "w": w, "threshold": threshold, "scale": max(1e-9, float(s.std()) / 4)}


def apply(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.ones(len(x))
    # summed row by row: a matrix product may differ in the last bits with the number of rows
    s = (np.clip((x - model["mean"]) / model["spread"], -8, 8) * model["w"]).sum(1)
    return 1 / (1 + np.exp(-np.clip((s - model["threshold"]) / model["scale"], -30, 30)))


SIZE = len(FEATURES)


def standardised(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / spread, -8, 8)


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _paired(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(d): the differences, good less poor, of every row to PAIRS_EACH rows of the other class.

    rows: (doc_id, y, z) as `stored` gives it. Rows are numbered within their class; a row asks for PAIRS_EACH numbers of the other.
    """
    numbered = stored(gapless_rank(rows, "y", F.xxhash64("doc_id"), ["doc_id"], rank_buckets(sum(sizes.values()))), "quality-rows")
    many = F.when(F.col("y") == 1, F.lit(sizes[0])).otherwise(F.lit(sizes[1]))
    each = F.explode(F.sequence(F.lit(1), F.lit(PAIRS_EACH)))
    asked = numbered.select((1 - F.col("y")).alias("y"), "z", "doc_id", each.alias("_k"), many.alias("_many"))
    asked = asked.select("y", "z", F.pmod(F.xxhash64("doc_id", "_k", F.lit(SEED)), F.col("_many")).alias("slot"))
    other = numbered.select(F.col("y").alias("_y"), F.col("slot").alias("_slot"), F.col("z").alias("_z"))
    met = asked.join(other.hint("merge"), (F.col("y") == F.col("_y")) & (F.col("slot") == F.col("_slot")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # y is the class of the row that was met
                sign = np.where(batch.column(0).to_numpy() == 0, 1.0, -1.0)[:, None]
                d = sign * (_lists(batch.column(1)) - _lists(batch.column(2)))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * SIZE, pa.int32()), pa.array(d.ravel()))], ["d"])

    return stored(met.select("y", "z", "_z").mapInArrow(run, "d array<double>"), "quality-pairs")


def _sums(rows: DataFrame, entries, width: int) -> np.ndarray:
    """The sum over all rows of what `entries` makes of a batch: `width` numbers, summed by task and then by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += entries(_lists(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["k", "v"])

    found = rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # width rows
    out = np.zeros(width)
    for r in found:
        out[r["k"]] = r["v"]
    return out


def newton(pairs: DataFrame) -> np.ndarray:
    """The weights with the least logistic loss over the pairs."""
    w = np.zeros(SIZE)
    for _ in range(STEPS):
        now = w

        def entries(d: np.ndarray) -> np.ndarray:
            p = 1 / (1 + np.exp(np.clip(d @ now, -30, 30)))  # noqa: B023
            return np.concatenate([[len(d)], -(d * p[:, None]).sum(0), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])

        found = _sums(pairs, entries, 1 + SIZE + SIZE * SIZE)
        gradient, curve = found[1 : SIZE + 1] / found[0] + L2 * w, found[SIZE + 1 :].reshape(SIZE, SIZE) / found[0] + L2 * np.eye(SIZE)
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def cut(scored: DataFrame, weight: dict[int, float], share: float) -> float:
    """Midway between the score (s, y) at which the rows' weights first come to `share`, and the one before it."""
    low, high = scored.agg(F.min("s"), F.max("s")).first()
    top, before, base = high, None, 0.0
    weights = lambda c: sum(F.count_if(F.col("y") == y) * F.lit(v) for y, v in weight.items()).alias(c)
    while True:
        inside = scored.filter(F.col("s").between(low, high))
        few = inside.select("s").distinct().limit(RANGES + 1).count() <= RANGES
        key = F.col("s") if few else F.least(F.floor((F.col("s") - low) / F.lit((high - low) / RANGES)), F.lit(RANGES - 1))
        parts = sorted(inside.groupBy(key.alias("_at")).agg(weights("w"), F.min("s").alias("low"), F.max("s").alias("high"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["low"])  # RANGES rows
        for r in parts:
            if base + r["w"] >= share + 1e-12 or r["high"] == top:
                break
            base, before = base + r["w"], r["high"]
        if few:
            # the row before it may have the same score
            again = r["n"] > 1 and base + min(weight.values()) < share + 1e-12
            return r["low"] if before is None or again else (before + r["low"]) / 2
        low, high = r["low"], r["high"]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT) -> dict | None:
    """The model, from every labelled training row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, batch.column(0), batch.column(2)], ["x", "doc_id", "y"])

    rows = stored(labelled_rows(docs, labels, label, folds, held_out).mapInArrow(run, "x array<double>, doc_id long, y int"), "quality-features")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if not sizes.get(0) or not sizes.get(1):
        return None
    training = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    share = training.agg(F.avg(F.col(label).cast("double"))).first()[0]
    n = sum(sizes.values())
    mean = _sums(rows.select("x"), lambda x: x.sum(0), SIZE) / n
    spread = np.sqrt(_sums(rows.select("x"), lambda x: ((x - mean) ** 2).sum(0), SIZE) / n)
    spread[spread < 1e-12] = 1.0

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = standardised(_lists(batch.column(0)), mean, spread)
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * SIZE, pa.int32()), pa.array(z.ravel()))], ["doc_id", "y", "z"])

    z = stored(rows.mapInArrow(scaled, "doc_id long, y int, z array<double>"), "quality-scaled")
    w = newton(_paired(z, sizes))

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((_lists(batch.column(1)) * w).sum(1))], ["y", "s"])

    scored = stored(z.select("y", "z").mapInArrow(strengths, "y int, s double"), "quality-scores")
    threshold = cut(scored, {1: share / sizes[1], 0: (1 - share) / sizes[0]}, 1 - share)
    scale = scored.agg(F.stddev_pop("s")).first()[0] / 4
    return {"mean": mean, "spread": spread, "w": w, "threshold": threshold, "scale": max(1e-9, scale)}


def score(docs: DataFrame, model: dict | None, carry: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """Every row with its score in the column `out`, and the columns in `carry`."""
    names = list(dict.fromkeys([*carry, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            x = np.array([features(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))
            value = pa.array(apply(model, x))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in carry), value], [*carry, out])

    rows = docs.select(*names)
    schema = StructType([*(rows.schema[c] for c in carry), StructField(out, DoubleType())])
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Every row with its fold, score and prediction."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(rows, train(docs, labels, "quality", folds, held_out))
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
