"""Toxicity: a linear classifier over hashed character n-grams, scaled by naive Bayes log-count ratios.

A text is lower-cased; every run of letters is cut out with a boundary on either side, and all its n-grams of ORDERS
characters are hashed into 2^HASH_BITS cells. A cell is present or absent in a text. Training, on every labelled training row:

1. r = log of the ratio of (smoothed) shares of toxic and of clean texts that have a cell;
2. logistic regression on presence * r, by Adam with L2, over the CELLS cells whose ratio stands out most from chance;
3. weight = coefficient * r.

A text's score is the logistic function of the sum of its cells' weights plus an intercept. Whole texts are scored, each on its
own, without a shuffle. Texts are dealt out once, to count cells by class; then each is cut down to which of the chosen cells it has. A
step of the regression is a pass over those that leaves one sum for each cell, in whole numbers, so that the order of rows
makes no difference. The model is a few thousand numbers and is sent with the task.

Defined results: null and empty texts score the intercept; repeated rows score alike and train once, a doc_id with several
texts trains on the smallest of them; a doc_id that is labelled twice counts as toxic if one label says so; labels of
documents that are missing or null are no training rows; a score of exactly 0.5 predicts 1; without rows of both classes
every text scores 0; an empty table gives an empty result; other columns of `documents`, whatever their names, are not
read. A null doc_id counts as text "" for the fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold, labelled_rows, marked, stored

#: Chosen, with CELLS and L2, by recall and false alarms over four folds of the training rows. Grams of 6 and 8 hold stems with
#: the boundary before them, which is what marks toxic words in languages with few labelled texts.
ORDERS = (3, 4, 5, 6, 8)
HASH_BITS = 20
LEAST_TEXTS = 3
CELLS = 1024
SMOOTHING = 1.0
L2 = 1e-4
STEPS = 150
RATE = 0.05
FOLDS, HELD_OUT = 5, 0
_MULTIPLIERS = np.array([pow(0x9E3779B1, k, 1 << 32) for k in range(1, max(ORDERS) + 1)], np.uint32)
CHUNK = 400_000  # characters hashed at once
BLOCK_CELLS = 250_000  # cells of texts in a block of the regression
STEP_ROWS = 50_000  # rows of a task of a step: a few MB
UNIT = 2.0**50  # the errors of all rows come to 1 at most; in these units their sums are exact


def characters(text: str | None) -> np.ndarray:
    """Code points, with everything but letters as 1 and a boundary on either side."""
    kept = (text or "").lower()
    codes = np.frombuffer(("\n" + kept + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((codes >= 97) & (codes <= 122)) | ((codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7))
    return np.where(letter, codes, np.uint32(1))


def cells(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the cell of the n-gram that starts at each character; a gram with an inner boundary has cell 0."""
    edge = codes == 1
    clear = np.ones(len(codes), bool)
    hashed = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        if n > 2:
            clear = clear[:m] & ~edge[n - 2 : n - 2 + m]
        hashed = hashed[:m] + codes[n - 1 :] * _MULTIPLIERS[n - 1]
        if n in ORDERS:
            mixed = hashed ^ hashed >> np.uint32(15)
            cell = mixed * np.uint32(0x2C1B3C6D + 2 * n) >> np.uint32(32 - HASH_BITS)
            cell *= clear[:m] & ~(edge[:m] & edge[n - 1 :])
            yield cell


def _different(values: list[np.ndarray]) -> np.ndarray:
    """The different values above 0, rising."""
    out = np.concatenate(values) if values else np.zeros(0, np.uint32)
    out.sort()
    return out[(out > 0) & np.append(True, out[1:] != out[:-1])[: len(out)]]


def _parts(text: str | None) -> Iterator[np.ndarray]:
    codes = characters(text)
    return (c for at in range(0, len(codes), CHUNK) for c in cells(codes[max(0, at - max(ORDERS)) : at + CHUNK]))


def present(text: str | None) -> np.ndarray:
    """The different cells of a text, without cell 0."""
    return _different(list(_parts(text))).astype(np.int32)


def places(text: str | None, place: np.ndarray) -> np.ndarray:
    """Which of the chosen cells a text has; place: a number from 1 for each chosen cell, 0 for the others."""
    found = (place[c] for c in _parts(text))
    return _different([p[p > 0] for p in found]).astype(np.int16) - 1


def ratios(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """The naive Bayes log-count ratio of each cell, from how many texts of each class have it."""
    return np.log((toxic + SMOOTHING) / (n_toxic + 2 * SMOOTHING)) - np.log((clean + SMOOTHING) / (n_clean + 2 * SMOOTHING))


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """What `descent` finds, for few rows in memory: coefficients and intercept of a logistic regression on presence * r; rows: the places in r of each text's cells.

    Rows are taken in blocks of BLOCK_CELLS cells, so that what a step needs besides the rows is bounded.
    """
    width, positive = len(r), int(y.sum())
    blocks, at = [], 0
    while at < len(rows):
        end, held = at + 1, len(rows[at])
        while end < len(rows) and held + len(rows[end]) <= BLOCK_CELLS:
            held, end = held + len(rows[end]), end + 1
        blocks.append((at, end, np.concatenate(rows[at:end]).astype(np.uint16), np.repeat(np.arange(end - at, dtype=np.int32), [len(c) for c in rows[at:end]])))
        at = end
    balance = np.where(y == 1, len(y) / (2 * positive), len(y) / (2 * (len(y) - positive)))
    weight, bias = np.zeros(width), 0.0
    moments, squares = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        gradient, scaled = np.append(L2 * weight, 0.0), weight * r
        for a, b, flat, row in blocks:
            margin = np.bincount(row, scaled[flat], b - a) + bias
            error = balance[a:b] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[a:b]) / len(y)
            gradient[:-1] += r * np.bincount(flat, error[row], width)
            gradient[-1] += error.sum()
        moments, squares = 0.9 * moments + 0.1 * gradient, 0.999 * squares + 0.001 * gradient**2
        move = RATE * (moments / (1 - 0.9**step)) / (np.sqrt(squares / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def descent(rows: DataFrame, sizes: tuple[int, int], r: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of the logistic regression over a stored table (places, y) of any size.

    Each step is a job in which a task sums its rows' errors by cell; the driver gets len(r) + 1 numbers of each task.
    """
    width = len(r)
    share = np.array([1 / (2 * k) for k in sizes])  # what an error in a row of each class weighs
    weight, bias = np.zeros(width), 0.0
    moments, squares = np.zeros(width + 1), np.zeros(width + 1)

    def summed(scaled: np.ndarray, bias: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width + 1, np.int64)
            for batch in batches:
                many = batch.num_rows
                if not many:
                    continue
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(many), np.diff(batch.column(0).offsets.to_numpy()))
                y = batch.column(1).to_numpy(zero_copy_only=False)
                margin = np.bincount(row, scaled[flat], many) + bias
                error = np.rint(UNIT * share[y] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y))
                total[:-1] += np.bincount(flat, error[row], width).astype(np.int64)
                total[-1] += int(error.sum())
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["sums"])

        return run

    for step in range(1, STEPS + 1):
        sums = rows.mapInArrow(summed(weight * r, bias), "sums array<long>").collect()  # one row a task
        error = sum((np.array(s[0], np.int64) for s in sums), np.zeros(width + 1, np.int64)) / UNIT
        gradient = np.append(L2 * weight + r * error[:-1], error[-1])
        moments, squares = 0.9 * moments + 0.1 * gradient, 0.999 * squares + 0.001 * gradient**2
        move = RATE * (moments / (1 - 0.9**step)) / (np.sqrt(squares / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT) -> tuple[np.ndarray, np.ndarray, float]:
    """The model (cells, weights, intercept), from every labelled training row.

    Executors hash whole texts, count cells, choose CELLS of them and sum the errors of each step; the driver gets the chosen
    cells and those sums.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, 1 << HASH_BITS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                both[y, present(text.as_py())] += 1
                both[y, 0] += 1  # no text has cell 0: it counts the texts
        used = np.flatnonzero(both.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(both[0, used]), pa.array(both[1, used])], ["cell", "clean", "toxic"])

    texts = labelled_rows(docs, labels, label, folds, held_out).select("text", "y")
    counts = stored(texts.mapInArrow(counted, "cell int, clean long, toxic long").groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-counts")
    sizes = next((tuple(r) for r in counts.filter("cell = 0").select("clean", "toxic").collect()), (0, 0))  # one row
    if not sizes[0] or not sizes[1]:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), -30.0
    smooth = lambda c: F.col(c) + F.lit(SMOOTHING)
    ratio = F.log(smooth("toxic") / (sizes[1] + 2 * SMOOTHING)) - F.log(smooth("clean") / (sizes[0] + 2 * SMOOTHING))
    # cells whose ratio stands out from chance; a third of the texts' cells would otherwise carry a weight near 0
    stands = F.round(F.abs(ratio) / F.sqrt(1 / smooth("clean") + 1 / smooth("toxic")), 9)
    ranked = counts.filter((F.col("cell") > 0) & (F.col("clean") + F.col("toxic") >= LEAST_TEXTS)).withColumn("_z", stands).filter("_z > 0")
    chosen = sorted(tuple(r) for r in ranked.orderBy(F.desc("_z"), "cell").limit(CELLS).select("cell", "clean", "toxic").collect())  # CELLS rows at most
    if not chosen:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    used, clean, toxic = (np.array(c) for c in zip(*chosen, strict=True))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.zeros(1 << HASH_BITS, np.int16)
        place[used] = np.arange(1, len(used) + 1)
        for batch in batches:
            own = pa.array([places(t.as_py(), place) for t in batch.column(1)], pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([own, batch.column(0)], ["places", "doc_id"])

    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(fold("doc_id", folds) != held_out)
    kinds = found.groupBy("doc_id").agg(F.min(h := F.xxhash64("text")).alias("least"), F.max(h).alias("most"))
    if kinds.filter("doc_id is not null and least <> most").limit(1).count():  # the smallest text of a doc_id counts, so texts meet again
        found = labelled_rows(docs, labels, label, folds, held_out).select("doc_id", "text")
    own = found.mapInArrow(placed, "places array<short>, doc_id long")
    rows = own.join(marked(labels, label, folds, held_out).hint("merge"), F.col("doc_id") == F.col("_doc"))
    rows = rows.groupBy("doc_id").agg(F.max("places").alias("places"), F.max("y").alias("y")).select("places", "y")
    rows = stored(rows.repartition(-(-sum(sizes) // STEP_ROWS)), "toxicity-places")
    r = ratios(clean, toxic, *sizes)
    weight, bias = descent(rows, sizes, r)
    final = weight * r
    keep = np.abs(final) > 1e-3
    return used[keep].astype(np.int32), final[keep].astype(np.float32), bias


class Scorer:
    """A model as a table of weights over all cells."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray, float]):
        self.table, self.bias = np.zeros(1 << HASH_BITS, np.float32), model[2]
        self.table[model[0]] = model[1]
        self.table[0] = 0

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The sum of weights of the different cells of each text, many texts at once."""
        out = np.full(len(texts), self.bias)
        parts = [characters(t) for t in texts]
        lengths = np.array([len(p) for p in parts])
        codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        owner_at = np.cumsum(lengths)
        pairs = []
        for start in range(0, len(codes), CHUNK):
            for cell in cells(codes[start : start + CHUNK + max(ORDERS) - 1]):
                weighs = np.flatnonzero(self.table[cell])
                owner = np.searchsorted(owner_at, weighs + start, "right")
                pairs.append(np.unique(owner.astype(np.int64) << 32 | cell[weighs]))
        if pairs:
            pair = np.unique(np.concatenate(pairs))
            out += np.bincount(pair >> 32, self.table[pair & 0xFFFFFFFF], len(texts))
        return out


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], carry: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """Every row with its score in the column `out`, and the columns in `carry`."""
    names = list(dict.fromkeys([*carry, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            margins = np.concatenate([scorer.margins(texts[k : k + 200].to_pylist()) for k in range(0, batch.num_rows, 200)] or [np.zeros(0)])
            value = pa.array(1 / (1 + np.exp(-np.clip(margins, -30, 30))))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in carry), value], [*carry, out])

    rows = docs.select(*names)
    schema = StructType([*(rows.schema[c] for c in carry), StructField(out, DoubleType())])
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Every row with its fold, score and prediction."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(rows, train(docs, labels, "toxic", folds, held_out))
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
