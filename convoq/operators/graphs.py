"""Neighbour graphs of vectors, and what is made of them: a layout in few dimensions, labels by their spectrum.

A neighbour graph is found by sorting and refined by descent. Each vector has a code of the signs of random projections;
rows sorted by code lie near vectors that share its first signs, and each window of LEAF rows of that order compares its own. Several
codes give several orders. Then, in each round, the neighbours of a vector (its own, and the best of those that name it)
are compared with each other. A window and a neighbourhood are bounded, however many vectors are alike, and no vector
meets all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoq.functions.vectors import dot, normalized
from convoq.scratch import removed, stored

#: Orders, signs of a code, rows of a window, rounds of descent.
ORDERS, SIGNS, LEAF, ROUNDS = 6, 31, 128, 1
#: Curve of closeness in the layout for a least distance of 0.1 and a spread of 1 (fixed values of the reference's library).
CURVE_A, CURVE_B = 1.577, 0.895
#: Nodes that one task lays out; passes over a group's edges; rounds in which groups exchange positions; repulsions for each attraction.
GROUP, EPOCHS, EXCHANGES, REPEL = 20_000, 120, 4, 5


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _best(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each row's k best others among the rows, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    s = np.round(x @ x.T, 7)
    s[ids[:, None] == ids] = -np.inf
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    back = np.empty(len(ids), int)
    back[order] = np.arange(len(ids))
    return np.take_along_axis(s, top, 1)[back], ids[top][back]


_FOUND = "id long, near array<struct<score: double, id: long>>"


def _found_batch(ids: np.ndarray, scores: np.ndarray, others: np.ndarray) -> pa.RecordBatch:
    keep = np.isfinite(scores)
    n = keep.sum(1)
    near = pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), pa.StructArray.from_arrays([pa.array(scores[keep]), pa.array(others[keep])], ["score", "id"]))
    return pa.RecordBatch.from_arrays([pa.array(ids), near], ["id", "near"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(id, near): the k best of what several searches found, best first."""
    rows = found.select("id", F.explode("near").alias("n")).groupBy("id", F.col("n.id").alias("other")).agg(F.max("n.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    near = F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank"), "score", "other"))), lambda n: F.struct(n["score"].alias("score"), n["other"].alias("id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("id").agg(near.alias("near"))


def sign_codes(orders: int, seed: int = 7):
    """Rows (id, vector) to (id, codes): for each order a code of signs of random projections; near codes have near vectors."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            signs = x @ np.random.default_rng(seed).standard_normal((x.shape[1], orders * SIGNS)) > 0
            code = signs.reshape(len(x), orders, SIGNS) @ (1 << np.arange(SIGNS)[::-1])
            for shift in (1, 2, 4, 8, 16):  # the place of a code in an order where neighbours differ in one sign
                code ^= code >> shift
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code.tolist(), pa.list_(pa.int64()))], ["id", "codes"])

    return codes


def neighbours(vectors: DataFrame, k: int = 15, key: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """(id, near): each vector's k nearest others by cosine, near = array of (score, id), best first; approximate.

    Rows with a null key or vector take no part; keys are distinct. The table is stored.
    """
    spark = vectors.sparkSession
    base = stored(vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), normalized(F.col(vector)).alias("v")), "units")

    rows = base.mapInArrow(sign_codes(ORDERS, seed), "id long, codes array<long>").select("id", F.posexplode("codes").alias("tree", "code"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(tasks, "tree", "code", "id").sortWithinPartitions("tree", "code", "id")
    dealt = stored(dealt.select("id", F.monotonically_increasing_id().alias("m")), "orders")
    part = F.shiftrightunsigned("m", 33).alias("part")
    sizes = sorted(dealt.groupBy(part).count().collect())  # a row a task
    before = spark.createDataFrame([(p, sum(n for _, n in sizes[:i])) for i, (p, n) in enumerate(sizes)], "part long, before long")
    place = (F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))) / (LEAF // 2)
    windows = dealt.withColumn("part", part).join(F.broadcast(before), "part").select("id", F.floor(place).alias("w"))
    windows = windows.select(F.explode(F.array(F.col("w"), F.col("w") - 1)).alias("centre"), F.col("id").alias("member"))
    graph = stored(_merged(_compared(windows, base, k), k), "graph")
    removed(dealt)
    for _ in range(rounds):
        better = stored(_merged(_compared(_pools(graph, k), base, k).unionByName(graph), k), "graph")
        removed(graph)
        graph = better
    removed(base)
    return graph


def _pools(graph: DataFrame, k: int) -> DataFrame:
    """(centre, member): a vector, its neighbours, and the best k of those that have it as a neighbour."""
    named = graph.select("id", F.explode("near").alias("n")).select("id", F.col("n.id").alias("other"), F.col("n.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("other").orderBy(F.desc("score"), "id"))
    by = named.withColumn("r", rank).where(F.col("r") <= k).select(F.col("other").alias("centre"), F.col("id").alias("member"))
    return by.union(named.select("id", "other")).union(graph.select("id", "id")).distinct()


def _compared(pools: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """What the members of each (bounded) pool find among each other."""
    rows = pools.join(base, pools["member"] == base["id"]).select("centre", "member", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [np.zeros(0, np.int64), np.zeros(0, np.int64), None]
        for b in batches:
            centre, member, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
            centre, member, x = np.concatenate([held[0], centre]), np.concatenate([held[1], member]), x if held[2] is None else np.vstack([held[2], x])
            starts = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1]]) if len(centre) else np.zeros(0, int)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                yield _found_batch(member[s:e], *_best(member[s:e], x[s:e], k))
            last = starts[-1] if len(starts) else 0
            held = [centre[last:], member[last:], x[last:]]
        if held[2] is not None and len(held[0]):
            yield _found_batch(held[1], *_best(held[1], held[2], k))

    return rows.repartition("centre").sortWithinPartitions("centre", "member").mapInArrow(compare, _FOUND)


# A layout in few dimensions -----------------------------------------------------------------------------------------


def memberships(graph: DataFrame) -> DataFrame:
    """(u, v, weight), u < v: how much two vectors belong together.

    A vector's nearest neighbour has 1, others fall off exponentially with their distance beyond it, at a rate that makes
    their sum log2 of their number; the two directions a and b of a pair give a + b - ab.
    """

    def weights(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = {"u": [], "v": [], "w": []}
            for u, near in zip(pdf["id"], pdf["near"], strict=True):
                d = np.maximum(0, 1 - np.array([n["score"] for n in near]))
                over = np.maximum(0, d - (d[d > 1e-9].min() if (d > 1e-9).any() else 0))
                low, high = 1e-6, 1e3
                for _ in range(50):
                    mid = np.sqrt(low * high)
                    low, high = (mid, high) if np.exp(-over / mid).sum() < np.log2(len(d) + 1) else (low, mid)
                out["u"] += [u] * len(d)
                out["v"] += [n["id"] for n in near]
                out["w"] += np.exp(-over / high).tolist()
            yield pd.DataFrame(out)

    one = graph.mapInPandas(weights, "u long, v long, w double")
    pairs = one.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("w").alias("a"), F.min("w").alias("b"), F.count("*").alias("n"))
    return pairs.select("u", "v", F.when(F.col("n") > 1, F.col("a") + F.col("b") - F.col("a") * F.col("b")).otherwise(F.col("a")).alias("weight"))


def principal(vectors: DataFrame, dims: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, at): the first principal components, largest coordinate 10, of one sign whatever the solver gives."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = vectors.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    axes = PCA(k=dims, inputCol="x", outputCol="y").fit(v.select(array_to_vector("v").alias("x"))).pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(dims)])
    at = stored(v.select("id", F.array(*[dot(F.col("v"), F.array(*[F.lit(float(c)) for c in axes[:, j]])) for j in range(dims)]).alias("at")), "axes")
    most = at.agg(F.max(F.array_max(F.transform("at", F.abs)))).first()[0] or 1.0
    return at.select("id", F.transform("at", lambda c: F.round(c * (10.0 / most), 4)).alias("at"))


def _move(t: pa.Table, dims: int, epochs: int, begin: float, end: float, seed: int) -> pa.Table:
    """New positions of one group's nodes: attraction along sampled edges, repulsion from random nodes; others stay.

    A position is read once for each node, not for each edge.
    """
    order = np.lexsort((t["v"].to_numpy(), t["u"].to_numpy()))
    at = lambda c, rows: _matrix(t[c].take(pa.array(order[rows])).combine_chunks()).reshape(-1, dims)
    own, named, i = np.unique(t["u"].to_numpy()[order], return_index=True, return_inverse=True)
    all_, first, j = np.unique(t["v"].to_numpy()[order], return_index=True, return_inverse=True)
    outside = ~np.isin(all_, own)
    place = np.empty(len(all_), int)
    place[~outside] = np.searchsorted(own, all_[~outside])
    place[outside] = len(own) + np.arange(outside.sum())
    y = np.concatenate([at("at_u", named), at("at_v", first[outside])])
    j, weight, rng = place[j], t["weight"].to_numpy()[order], np.random.default_rng(seed)
    weight = weight / weight.max()
    y += rng.normal(0, 1e-4, y.shape) * (np.arange(len(y)) < len(own))[:, None]
    for epoch in range(epochs):
        rate = begin + (end - begin) * epoch / epochs
        drawn = rng.permutation(np.flatnonzero(rng.random(len(weight)) < weight))
        for part in np.array_split(drawn, 8):
            a, b = i[part], j[part]
            d = y[a] - y[b]
            q = (d * d).sum(1)
            pull = -2 * CURVE_A * CURVE_B * np.maximum(q, 1e-12) ** (CURVE_B - 1) / (1 + CURVE_A * q**CURVE_B) * (q > 0)
            step = np.clip(pull[:, None] * d, -4, 4)
            c = rng.integers(0, len(y), (len(a), REPEL))
            d = y[a][:, None] - y[c]
            q = (d * d).sum(2)
            push = 2 * CURVE_B / ((0.001 + q) * (1 + CURVE_A * q**CURVE_B)) * (c != a[:, None])
            step += np.clip(push[..., None] * d, -4, 4).sum(1)
            for k in range(dims):
                y[: len(own), k] += rate * np.bincount(a, step[:, k], len(own))
    found = np.round(y[: len(own)], 6)
    return pa.table([pa.array(own), pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * dims, pa.array(found.ravel()))], ["id", "at"])


def _turn(dims: int, turn: int, turns: int, seed: int):
    def move(t: pa.Table) -> pa.Table:
        return _move(t, dims, EPOCHS // turns, 1 - turn / turns, 1 - (turn + 1) / turns, seed + turn)

    return move


def layout(vectors: DataFrame, dims: int = 10, k: int = 15, key: str = "vec_id", vector: str = "embedding", seed: int = 42, group: int | None = None) -> DataFrame:
    """(id, at): positions in few dimensions that keep neighbours together.

    The graph is laid out from principal components in groups of at most about `group` nodes, slabs along the first one
    (equal coordinates are dealt out by a hash). Several groups take turns of EPOCHS / EXCHANGES passes and see where their
    neighbours in other groups were after the turn before. Same vectors and seed, same positions. The table is stored.
    """
    from convoq.shipping import ship

    spark, group = vectors.sparkSession, group or GROUP
    ship(spark)
    graph = neighbours(vectors, k, key, vector)
    edges = memberships(graph)
    both = stored(edges.union(edges.select("v", "u", "weight")), "edges")
    removed(graph)
    width = vectors.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    if width is None:
        return spark.createDataFrame([], "id long, at array<double>")
    dims = min(dims, width[0])
    at = stored(principal(vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()), dims, key, vector), "at")
    groups = -(-at.count() // group)
    x = F.col("at")[0] + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 40))
    cuts = at.select(x.alias("x")).approxQuantile("x", [g / groups for g in range(1, groups)], 0.25 / groups) if groups > 1 else []
    slab = sum([F.when(x > c, 1).otherwise(0) for c in cuts], F.lit(0))
    of = stored(at.select("id", slab.alias("g")), "groups")
    turns = EXCHANGES if groups > 1 else 1
    for turn in range(turns):
        ends = at.select(F.col("id").alias("u"), F.col("at").alias("at_u")).join(of.withColumnRenamed("id", "u"), "u")
        rows = both.join(ends, "u").join(at.select(F.col("id").alias("v"), F.col("at").alias("at_v")), "v")
        moved = rows.groupBy("g").applyInArrow(_turn(dims, turn, turns, seed), "id long, at array<double>")
        new = stored(moved.unionByName(at.join(both.select(F.col("u").alias("id")).distinct(), "id", "left_anti")), "at")
        removed(at)
        at = new
    removed(both, of)
    return at


def layout_kmeans(vectors: DataFrame, k: int, dims: int = 10, key: str = "vec_id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """(key, cluster, label): k-means on the layout; clusters are numbered, and called SPEAKER_00 and so on, by first appearance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = layout(vectors, dims, key=key, vector=vector, seed=seed).repartition(tasks, "id").sortWithinPartitions("id").select("id", array_to_vector("at").alias("x"))
    found = KMeans(k=k, seed=seed, featuresCol="x", predictionCol="c").fit(at).transform(at).select("id", "c")
    first = found.groupBy("c").agg(F.min("id").alias("first"))  # k rows
    number = (F.row_number().over(Window.orderBy("first")) - 1).alias("cluster")
    return found.join(F.broadcast(first.select("c", number)), "c").select(F.col("id").alias(key), "cluster", F.format_string("SPEAKER_%02d", "cluster").alias("label"))
