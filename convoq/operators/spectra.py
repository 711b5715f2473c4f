"""Spectral labels of one large group: its neighbour graph as a table of edges, its eigenvectors by joins and sums.

The number of clusters comes from the eigen-gap of the cosine graph of SAMPLE vectors, those with the smallest hashes of
their ids (the spectrum of a graph of n vectors hardly changes with n). The labels come from the leading eigenvectors of the neighbour graph, found by subspace iteration with a Chebyshev filter:
a step multiplies a few columns by the graph, and each round ends with
orthogonal columns (sums of products, a small matrix on the driver). Nodes are dealt into parts of bounded size that keep near
vectors together; a step brings each part its edges and the columns of their ends, once a part and not once an edge.
Nothing of the size n x n is made, and only matrices of columns by columns reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoq.functions.vectors import dot, normalized
from convoq.operators.graphs import neighbours, sign_codes
from convoq.scratch import removed, stored
from convoq.shipping import ship

SAMPLE = 2_000
#: Columns beyond the clusters, degree of the filter, most rounds, and the change of eigenvalues that ends them.
MORE, DEGREE, MOST_ROUNDS, SETTLED = 4, 6, 6, 1e-5
#: Nodes whose rows of the graph one task multiplies.
PART = 100_000
_STATE = "id long, part int, wanted array<int>, y array<double>"


def edges(unit: DataFrame, near: int = 10) -> DataFrame:
    """(u, v, w): the normalised neighbour graph, both directions and each node with itself; stored."""
    graph = neighbours(unit, near, key="id", vector="v")
    one = graph.select(F.col("id").alias("u"), F.explode("near").alias("n")).select("u", F.col("n.id").alias("v"))
    half = one.union(one.select("v", "u")).groupBy("u", "v").agg((F.count("*") / 2).alias("w")).union(unit.select("id", F.col("id").alias("v"), F.lit(1.0)))
    half = stored(half, "edges")
    removed(graph)
    degree = half.groupBy("u").agg(F.sum("w").alias("d"))
    both = half.join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("e")), "v")
    out = stored(both.select("u", "v", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w")), "edges")
    removed(half)
    return out


def _columns(m: int) -> list[str]:
    return [f"y{i}" for i in range(m)]


def _parts(nodes: DataFrame) -> DataFrame:
    """(id, part) of the nodes: parts of at most about PART nodes whose vectors lie near each other; stored.

    Parts are ranges of a code of signs of random projections; nodes of one code are dealt out by a hash.
    """
    count = -(-nodes.count() // PART)
    if count < 2:
        return stored(nodes.select("id", F.lit(0).alias("part")), "parts")
    coded = stored(nodes.select("id", "v").mapInArrow(sign_codes(1), "id long, codes array<long>").select("id", (F.col("codes")[0] + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("x")), "codes")
    cuts = coded.approxQuantile("x", [i / count for i in range(1, count)], 0.25 / count)
    out = stored(coded.select("id", sum([F.when(F.col("x") > c, 1).otherwise(0) for c in cuts], F.lit(0)).alias("part")), "parts")
    removed(coded)
    return out


def _step(factor: float, shift: float, m: int):
    """For one part: factor * (the graph times the columns - shift * the columns) - the columns before, of its own nodes."""

    def step(e: pa.Table, t: pa.Table) -> pa.Table:
        matrix = lambda rows: rows["y"].combine_chunks().flatten().to_numpy().reshape(len(rows), m)
        part = e["part"][0].as_py()
        earlier = t["earlier"].to_numpy()
        now, before = t.filter(pa.array(~earlier)).sort_by("id"), t.filter(pa.array(earlier)).sort_by("id")
        own = now.filter(pc.equal(now["part"], part))
        edges = e.sort_by([("u", "ascending"), ("v", "ascending")])
        i, j = (np.searchsorted(rows["id"].to_numpy(), edges[c].to_numpy()) for rows, c in ((own, "u"), (now, "v")))
        y, w, new = matrix(now), edges["w"].to_numpy(), np.empty((len(own), m))
        for c in range(m):
            new[:, c] = np.bincount(i, w * y[j, c], len(own))
        new = factor * (new - shift * matrix(own)) - (matrix(before) if len(before) else 0)
        ends = np.arange(len(own) + 1, dtype=np.int32) * m
        return pa.table([own["id"], own["part"], own["wanted"], pa.ListArray.from_arrays(ends, pa.array(new.ravel()))], ["id", "part", "wanted", "y"])

    return step


def _times(graph: DataFrame, y: DataFrame, m: int, before: DataFrame | None = None, factor: float = 1.0, shift: float = 0.0) -> DataFrame:
    """The columns after a step (see _step); stored. A node's columns are sent once to each part that has a neighbour of it."""
    sent = y.select(F.explode("wanted").alias("p"), "id", "part", "wanted", "y", F.lit(False).alias("earlier"))
    sent = sent.withColumn("wanted", F.when(F.col("p") == F.col("part"), F.col("wanted")))
    if before is not None:
        sent = sent.unionByName(before.select(F.col("part").alias("p"), "id", "part", F.lit(None).cast("array<int>").alias("wanted"), "y", F.lit(True).alias("earlier")))
    return stored(graph.groupBy("part").cogroup(sent.groupBy("p")).applyInArrow(_step(factor, shift, m), _STATE), "columns")


def _gram(y: DataFrame, m: int, z: str = "y") -> np.ndarray:
    """The m x m matrix of products of the columns y with those of z."""
    got = y.agg(*[F.sum(F.col("y")[a] * F.col(z)[b]) for a in range(m) for b in range(m)]).first()
    return np.array(got, float).reshape(m, m)


def _mixed(y: DataFrame, by: np.ndarray) -> DataFrame:
    """The columns of y times a small matrix; stored."""
    columns = F.array(*[sum(F.col("y")[i] * F.lit(float(by[i, j])) for i in range(by.shape[0])) for j in range(by.shape[1])])
    return stored(y.select("id", "part", "wanted", columns.alias("y")), "columns")


def leading(graph: DataFrame, nodes: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """((id, y0, ...), eigenvalues): the eigenvectors of the k largest eigenvalues of a normalised graph of nodes (id, v); stored."""
    ship(nodes.sparkSession)
    m = k + MORE
    of = _parts(nodes)
    placed = stored(graph.join(of.withColumnRenamed("id", "u"), "u").select("u", "v", "w", "part"), "edges")
    wanted = placed.groupBy(F.col("v").alias("id")).agg(F.collect_set("part").alias("others"))
    start = F.array(*[F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1 for j in range(m)])
    y = stored(of.join(wanted, "id").select("id", "part", F.array_union("others", F.array("part")).alias("wanted"), start.alias("y")), "columns")
    removed(of)
    values, cut = np.zeros(m), 0.5
    for _ in range(MOST_ROUNDS):
        # eigenvalues from -1 to cut are mapped to [-1, 1], where the Chebyshev polynomial stays small; those above grow
        scale, shift = 2 / (cut + 1), (cut - 1) / 2
        before, now = None, y
        for step in range(DEGREE):
            new = _times(placed, now, m, before, scale if step == 0 else 2 * scale, shift)
            if before is not None:
                removed(before)
            before, now = now, new
        removed(before)
        # orthogonal columns, then the eigenvectors of the graph within their span
        size, turn = np.linalg.eigh(_gram(now, m))
        good = size > size[-1] * 1e-14
        y = _mixed(now, np.pad(turn[:, good] / np.sqrt(size[good]), ((0, 0), (0, m - int(good.sum())))))
        removed(now)
        z = _times(placed, y, m)
        found, turn = np.linalg.eigh((lambda g: (g + g.T) / 2)(_gram(y.join(z.select("id", F.col("y").alias("z")), "id"), m, "z")))
        order = np.argsort(-found)
        rotated = _mixed(y, turn[:, order])
        removed(y, z)
        y, new = rotated, found[order]
        done = np.abs(new[:k] - values[:k]).max() < SETTLED
        values, cut = new, float(np.clip(new[-1], 0.0, 0.98))
        if done:
            break
    removed(placed)
    return y.select("id", *[F.col("y")[i].alias(c) for i, c in enumerate(_columns(k))]), values[:k]


def spectral_labels(vectors: DataFrame, least: int = 3, most: int = 10, near: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster): labels from 0 in order of the smallest key. Keys are distinct longs; rows without a vector take no part."""
    from convoq.operators.vectors import centroids, nearest_centroid, number_of_clusters

    unit = stored(vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), normalized(F.col(vector)).alias("v")), "units")
    some = unit.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).orderBy("id").select("v").collect()
    k = number_of_clusters(np.array([r.v for r in some]), least, most)
    graph = edges(unit, near)
    y, _ = leading(graph, unit, k)
    rows = stored(y.select("id", normalized(F.array(*_columns(k))).alias("embedding")), "rows")
    # k-means on the rows: the first centre is the first row, each next one the row farthest from all before it
    centres = [rows.orderBy("id").select("embedding").first()[0]]
    for _ in range(1, k):
        apart = F.least(*[F.round(1 - dot(F.col("embedding"), F.array(*[F.lit(float(c)) for c in x])), 9) for x in centres]) if len(centres) > 1 else F.round(1 - dot(F.col("embedding"), F.array(*[F.lit(float(c)) for c in centres[0]])), 9)
        centres.append(rows.orderBy(F.desc(apart), "id").select("embedding").first()[0])
    spark = vectors.sparkSession
    means = spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "label int, centroid array<double>")
    for _ in range(10):
        found = nearest_centroid(rows, means, "id", metric="euclidean").select("id", F.col("cluster").alias("label"))
        new = centroids(rows.join(found, "id"), ["label"]).select("label", "centroid").collect()  # k rows
        was = {r.label: r.centroid for r in means.collect()}
        moved = max(float(np.abs(np.array(r.centroid) - np.array(was[r.label])).max()) for r in new)
        means = spark.createDataFrame([(r.label, list(r.centroid)) for r in new], "label int, centroid array<double>")
        if moved < 1e-9:
            break
    found = stored(nearest_centroid(rows, means, "id", metric="euclidean").select("id", "cluster"), "labels")
    removed(unit, graph, rows)
    order = found.groupBy("cluster").agg(F.min("id").alias("first")).orderBy("first").collect()  # k rows
    names = F.create_map(*[F.lit(x) for i, r in enumerate(order) for x in (r.cluster, i)])
    return found.select(F.col("id").alias(key), names[F.col("cluster")].cast("int").alias("cluster"))
