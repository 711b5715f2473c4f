"""Hard negatives against scoring everything; bounds against exact scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoq.llm import vector_file

SCHEMA = "vec_id long, label int, embedding array<double>, rank int, v string, block int"


def plain(rows, every=10):
    """The rows of the result by scoring every row with every anchor."""
    held = [(i, l, [max(-(1 << 20), min(1 << 20, math.floor(256 * x))) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for n, (i, label, v) in enumerate(held):
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, lab) for m, (j, lab, w) in enumerate(held) if m != n]
        for s, j, _ in sorted((t for t in scored if t[2] == label), key=order)[:5]:
            window = sorted((t for t in scored if t[2] != label and 80 * s <= 100 * t[0] <= 100 * s), key=order)[:5]
            out += [(i, j, r + 1, k, s, t) for r, (t, k, _) in enumerate(window)]
    return sorted(out, key=str)


def mined(spark, rows, every=10, parts=3):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(parts)
    got = vector_file.hard_negatives(df, F.col("vec_id") % every == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=str)


def vectors(n, dims, labels, seed, spread=0.2):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.gauss(0.1, spread) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize(("dims", "labels", "block"), [(6, 3, 1 << 20), (6, 40, 400), (1, 2, 200)])
def test_equal_to_scoring_everything(spark, dims, labels, block, monkeypatch):
    monkeypatch.setattr(vector_file, "BLOCK_BYTES", block)
    monkeypatch.setattr(vector_file, "ANCHORS", 17)  # several passes
    monkeypatch.setattr(vector_file, "LOOKUP", 5)
    rows = vectors(240, dims, labels, dims)
    want = plain(rows)
    assert want and mined(spark, rows) == want


def test_odd_rows(spark):
    rng = random.Random(4)
    some = [0.5, 0.25, -0.125]
    rows = [(i, i % 2, some) for i in range(0, 60)]  # one vector, many ties
    rows += [(10, 1, some), (10, 1, some), (10, 0, some), (None, 0, some), (None, 1, some), (None, 1, some)]  # repeated ids and rows, no ids
    rows += [(100, None, some), (110, 1, None), (120, 1, [0.5, None, 1.0]), (130, 0, [float("nan"), 1.0, 1.0]), (140, 0, [float("inf"), 1.0, 1.0])]
    rows += [(150, 0, [0.5, 0.25]), (160, 1, []), (170, 1, [0.5, 0.25, -0.1, 7.0]), (180, 0, [1e300, -1e300, 4000.0]), (190, -3, [-0.5, -0.5, -0.5])]
    rows += [(200 + i, i % 3, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(50)]
    assert mined(spark, rows) == plain(rows)


def test_nothing_to_mine(spark):
    assert mined(spark, [(3, 1, [0.5]), (4, 0, [0.5])]) == []
    assert vector_file.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
    assert mined(spark, [(0, 1, []), (10, 1, []), (20, 0, [])]) == plain([(0, 1, []), (10, 1, []), (20, 0, [])])
    assert mined(spark, [(0, 1, [0.5]), (10, 1, None)]) == []


@pytest.mark.parametrize("largest", [128, 1 << 20])
def test_bounds_hold_every_score(largest):
    rng = np.random.default_rng(7)
    v, a = rng.integers(-largest, largest, (300, 9)).astype(np.int32), rng.integers(-largest, largest, (20, 9)).astype(np.int64)
    inner = np.quantile(v[:50], np.arange(1, vector_file.CELLS) / vector_file.CELLS, axis=0, method="lower").T.astype(np.int32)
    cells = np.array([[np.searchsorted(inner[d], x, "right") for d, x in enumerate(r)] for r in v], np.uint8)
    low, high = vector_file._ends(inner, v)
    below, above = vector_file.bounds(cells, low, high, a)
    score = v.astype(np.int64) @ a.T
    assert (below <= score).all() and (score <= above).all()
    assert np.mean(above - below) < 0.2 * np.mean(np.ptp(score, axis=0))  # and are worth something
