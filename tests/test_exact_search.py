"""The exact search as matrices: no pair becomes a row, ties and odd vectors as in the plain form."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoq.functions.vectors import cosine
from convoq.operators import index as I
from convoq.operators import vectors as V


@pytest.mark.parametrize("shape", ["copies", "odd"])
def test_exact_search_equals_all_pairs(spark, shape):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(60)]
    if shape == "odd":
        rows += [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [0.0] * 4), (63, [1.0, 2.0]), (64, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 5 = 0")
    s = V.ranked(v.select("vec_id", F.col("embedding").alias("v")).crossJoin(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))).select("query_id", "vec_id", cosine(F.col("q"), F.col("v")).alias("score")), 7)
    found = V.knn(q, v, 7)
    assert "CartesianProduct" not in (p := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in p
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, s.collect()), key=str)


def test_the_index_meets_cells_as_matrices(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(200)] + [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [0.0] * 4), (203, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    cells = I.fit_cells(v.where("vec_id < 200"), 6)
    index, q = I.build(v, cells), v.where("vec_id % 5 = 0 or vec_id > 199")
    assert index.count() == 204
    found = I.search(q, index, cells, 250, probes=6)
    assert "cosine" not in found.columns and "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, V.knn(q, v, 250).collect()), key=str)
    some = {(r.query_id, r.vec_id) for r in I.search(q.where("vec_id < 200"), index, cells, 250, probes=2).collect()}
    cell, unit = {r.vec_id: r.cell for r in index.collect()}, {i: x for i, x in rows if i < 200}
    near = I._nearest(np.array([unit[i] for i in range(0, 200, 5)]), cells.centres, 2)
    assert some == {(i, j) for i, c in zip(range(0, 200, 5), near.tolist(), strict=True) for j in cell if cell[j] in c}
