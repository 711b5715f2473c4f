"""Quality classifier: support vectors on n-grams scaled by naive Bayes log-count ratios.

A text's features are indicators of its word and word-shape n-grams, hashed to 2**DIM_BITS places. An
indicator is scaled by the log ratio of its smoothed counts in the two classes, rows are brought to
length 1, and a linear model with hinge loss is fitted by dual coordinate descent. Weights are pulled
towards their mean size (BETA), and a logistic curve fitted on rows left out of a first fit turns
margins into scores.

The fit takes at most FIT_ROWS labelled rows (those with the smallest hashes) and none that is held
out; the scores cover all rows. Only text goes into a score.

Defined cases: null and empty texts have no features and get the score of margin 0; a label table
without both kinds in the rows to learn from gives score 0.5 throughout; labels that are null or for no
document are ignored, of several for a document the lowest counts; null doc_ids are not held out and
not learned from; repeated rows are scored alike; a very long text has the features of all its words, at
most 2**DIM_BITS; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoq.llm.common import LOWER, bounded, small, written
from convoq.shipping import ship

FIT_ROWS = 10_000
DIM_BITS = 18
ALPHA, BETA, COST, EPOCHS = 1.0, 0.25, 1.0, 12
FOLDS, HELD = 3, 1
CACHE = 200_000
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_RUNS = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0")]


class _Words(dict):
    """word -> (hash of it in lower case, hash of its shape); emptied when it has CACHE words."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = word
        for run, to in _RUNS:
            shape = run.sub(to, shape)
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = (xxhash.xxh3_64_intdigest(word.translate(LOWER)), xxhash.xxh3_64_intdigest(shape, 1))
        return got


_words = _Words()


def features(text: bytes | None) -> np.ndarray:
    """Sorted places of the text's n-gram indicators."""
    words = (text or b"").split()
    if not words:
        return np.empty(0, np.int32)
    got = np.array([*map(_words.__getitem__, words)], np.uint64)
    w, s = got[:, 0], got[:, 1]
    parts = [w, s * _B]
    if len(words) > 1:
        same = (w[1:] == w[:-1]).astype(np.uint64)
        parts += [w[1:] * _A ^ w[:-1], (s[1:] * _A ^ s[:-1] * _C) + same * _D, same * _D]
    if len(words) > 2:
        parts.append(s[2:] * _A ^ s[1:-1] * _C ^ s[:-2] * _D)
    h = np.concatenate(parts)
    h ^= h >> np.uint64(29)
    h *= _C
    return np.unique((h >> np.uint64(64 - DIM_BITS)).astype(np.int32))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = [np.full(1 << DIM_BITS, ALPHA) for _ in (0, 1)]
    for x, label in zip(rows, y, strict=True):
        counts[int(label > 0)][x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of min 1/2 |w|^2 + sum(cost * max(0, 1 - y w.x)); rows have length 1 or are empty."""
    w = np.zeros(1 << DIM_BITS)
    a = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            if len(x):
                old = a[i]
                a[i] = min(max(old - (y[i] * (w[x] @ v) - 1.0), 0.0), cost[i])
                if a[i] != old:
                    w[x] += (a[i] - old) * y[i] * v
    return w


class Model:
    def __init__(self, ratios: np.ndarray, weights: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.ratios, self.weights, self.slope, self.shift = ratios.astype(np.float32), weights.astype(np.float32), slope, shift

    def margin(self, x: np.ndarray) -> float:
        r = self.ratios[x]
        size = float(np.sqrt(r @ r))
        return float(self.weights[x] @ r) / size if size else 0.0

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30))))


def _fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    r = log_count_ratios(rows, y)
    values = [r[x] / max(np.linalg.norm(r[x]), 1e-12) for x in rows]
    share = np.where(y > 0, (y > 0).mean(), (y <= 0).mean())
    w = dual_coordinate_descent(rows, values, y, COST / (2 * share))
    return Model(r, (1 - BETA) * np.abs(w[w != 0]).mean() * np.sign(w) + BETA * w if w.any() else w)


def _calibrate(model: Model, margins: np.ndarray, y: np.ndarray) -> None:
    """Newton steps for the logistic curve through (margin, label)."""
    size = max(float(np.std(margins)), 1e-9)
    m = np.stack([margins / size, np.ones(len(margins))], 1)
    t, c = (y > 0).astype(float), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(m @ c, -30, 30)))
        g = m.T @ (p - t) + 1e-2 * c
        h = (m * (p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2)
        c = c - np.linalg.solve(h, g)
    model.slope, model.shift = float(c[0] / size), float(c[1])


def train(rows: list[np.ndarray], labels: np.ndarray) -> Model | None:
    """None without rows of both labels."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return None
    left = np.arange(len(y)) % 4 == 0
    model = _fit(rows, y)
    first = model
    if len(set(y[~left].tolist())) == 2 and left.any():
        first = _fit([x for x, out in zip(rows, left, strict=True) if not out], y[~left])
    else:
        left[:] = True
    _calibrate(model, np.array([first.margin(x) for x, out in zip(rows, left, strict=True) if out]), y[left])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        x = pa.array([features(t).tobytes() for t in b.column(2).cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], ["h", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """The model of at most `rows` labelled rows that are not held out."""
    ship(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labels")
    some = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(bounded(known), "doc_id")
    some = some.select(F.xxhash64("doc_id").alias("h"), F.col("label").cast("int"), "text").mapInArrow(_featurise, "h long, label int, x binary")
    got = sorted(some.orderBy("h", "x").limit(rows).collect())
    return train([np.frombuffer(r.x, np.int32) for r in got], np.array([r.label for r in got]))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    ship(docs.sparkSession)

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for b in small(batches):
            scores = [now.score(features(t)) if now else 0.5 for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
