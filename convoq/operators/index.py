"""An index for vector search: cells around centroids, of which a query looks into the nearest few.

The centroids are fitted on a bounded sample (SAMPLE vectors, those with the smallest hashes of their ids), and so is the
number of cells to probe: the least that finds TARGET of the exact neighbours of QUERIES vectors of the sample. Vectors in
clusters need few cells, vectors without any structure most of them. Every vector is in the index. A query meets only the vectors of the cells that it probes, so the work grows with queries times cells
plus what the probed cells hold, not with queries times vectors. A cell with more than SHARE_ROWS vectors is kept in
shares, so that no task holds all of a crowded one.

The result is approximate: tests and the query `index_recall` measure its recall against the exact form.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StructField, StructType

from convoq.functions.vectors import cosine
from convoq.operators import vectors as V

SAMPLE, MOST_CELLS, SHARE_ROWS = 50_000, 4_096, 20_000
#: Recall that the number of probed cells is chosen for, with as many neighbours of so many sampled queries.
TARGET, NEIGHBOURS, QUERIES = 0.96, 30, 200
ROUNDS = 12
#: Rows that meet the centroids, and queries that meet a shard, at once.
BLOCK = 1_024


@dataclass
class Cells:
    """Unit centroids and how many of their cells a query probes."""

    centres: np.ndarray
    probes: int


def fit_cells(vectors: DataFrame, cells: int | None = None, key: str = "vec_id", vector: str = "embedding", seed: int = 1) -> Cells:
    """Spherical k-means on the sample; by default as many cells as the root of the number of vectors."""
    n = cells or min(MOST_CELLS, max(1, math.isqrt(vectors.count())))
    got = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).select(vector).limit(SAMPLE).collect()
    x = np.array([r[0] for r in got], float).reshape(len(got), -1)
    if not len(x):
        return Cells(np.zeros((1, 1)), 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    c = x[np.random.default_rng(seed).permutation(len(x))[:n]]
    for _ in range(ROUNDS):
        label = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, label, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return Cells(c, _probes(x, c))


def _probes(x: np.ndarray, c: np.ndarray) -> int:
    """The least number of nearest cells that hold TARGET of the NEIGHBOURS of sampled queries, on average."""
    label = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
    queries = x[:QUERIES]
    near = np.argsort(-(queries @ x.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    place = np.argsort(np.argsort(-(queries @ c.T), axis=1, kind="stable"), axis=1)  # of each cell in a query's order
    need = np.take_along_axis(place, label[near], axis=1)
    return int(next(p for p in range(1, len(c) + 1) if (need < p).mean() >= TARGET))


def _clean(vector: str, cells: Cells) -> Column:
    """Whether a vector has finite numbers only, as many as the centroids; the others look into the first cells."""
    return F.coalesce(V.numbers(vector) & (F.size(vector) == cells.centres.shape[1]), F.lit(False))


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each row, ties to the smaller number."""
    return np.argsort(-(V.units(x) @ centres.T), axis=1, kind="stable")[:, :n]


def _mapped(df: DataFrame, vector: str, cells: Cells, of: Callable[[np.ndarray], pa.Array], name: str, kind: DataType, odd: object) -> DataFrame:
    """df with what `of` makes of its vectors, a batch of rows as a matrix; odd for vectors that are not clean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                clean = b.column("__clean")
                t = pa.Table.from_batches([b]).filter(clean)
                made = of(V.matrix(t, vector)).to_pylist() if t.num_rows else []
                it = iter(made)
                new = pa.array([next(it) if c else odd for c in clean.to_pylist()], pa.list_(pa.int32()) if isinstance(kind, ArrayType) else pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns, new], [*b.schema.names, name])

    d = df.withColumn("__clean", _clean(vector, cells))
    return d.mapInArrow(run, StructType([*d.schema.fields, StructField(name, kind)]))


def build(vectors: DataFrame, cells: Cells, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, vector, cell, share): every vector with the cell of its nearest centroid."""
    centres = cells.centres
    v = _mapped(vectors.select(key, vector), vector, cells, lambda x: pa.array(_nearest(x, centres, 1)[:, 0]), "cell", IntegerType(), 0).drop("__clean")
    shares = v.groupBy("cell").agg(F.ceil(F.count("*") / SHARE_ROWS).cast("int").alias("shares"))
    return v.join(F.broadcast(shares), "cell").select(key, vector, "cell", F.pmod(F.xxhash64(key), F.col("shares")).cast("int").alias("share"), "shares")


def write(index: DataFrame, path: str) -> None:
    """The index as files, one folder a cell: a search reads the folders of the cells that it probes."""
    index.repartition("cell", "share").write.mode("overwrite").partitionBy("cell").parquet(path)


def _probed(k: int, centres: np.ndarray, probes: int):
    """Of some cells and a part of the queries: (query_id, vec_id, score) of each query's best k in the cells that it probes, and all that may tie."""

    def best(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else near.min(1)
        return np.nonzero(near >= least[:, None] - 1e-8)

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(queries["query_id"].combine_chunks()[:0], vectors["vec_id"].combine_chunks()[:0], np.zeros(0))]
        if vectors.num_rows and queries.num_rows:
            vectors = vectors.sort_by("cell")
            v, q, asked, ids = V.matrix(vectors, "__v"), V.matrix(queries, "__q"), queries["query_id"].combine_chunks(), vectors["vec_id"].combine_chunks()
            unit, (cell, start) = V.units(v), np.unique(vectors["cell"].to_numpy(), return_index=True)
            for at in range(0, len(q), BLOCK):
                part, looks = q[at : at + BLOCK], np.zeros((min(BLOCK, len(q) - at), len(centres)), bool)
                np.put_along_axis(looks, _nearest(part, centres, probes), True, 1)
                own, one, two, near = V.units(part), [], [], []
                for c, i, j in zip(cell.tolist(), start.tolist(), [*start[1:].tolist(), len(v)], strict=True):
                    which = np.flatnonzero(looks[:, c])
                    if len(which):
                        s = own[which] @ unit[i:j].T
                        a, b = best(s)
                        one.append(which[a])
                        two.append(b + i)
                        near.append(s[a, b])
                if one:
                    a, b, s = np.concatenate(one), np.concatenate(two), np.concatenate(near)
                    order = np.lexsort((-s, a))
                    a, b, s = a[order], b[order], s[order]
                    first = np.searchsorted(a, a)
                    last = np.minimum(first + k, np.searchsorted(a, a, "right")) - 1
                    kept = s >= s[last] - 1e-8
                    a, b = a[kept], b[kept]
                    found.append((asked.take(pa.array(a + at)), ids.take(pa.array(b)), V.scores(part[a], v[b])))
        asked, ids, values = zip(*found, strict=True)
        return pa.table([pa.chunked_array(asked), pa.chunked_array(ids), pa.array(np.concatenate(values))], ["query_id", "vec_id", "score"])

    return run


def search(queries: DataFrame, index: DataFrame, cells: Cells, k: int = 30, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of the probed cells, ties to the smaller id.

    Cells are dealt to shards of about V.SHARE vectors. A query goes once to each shard that has a cell of its own, meets the
    probed cells there as matrices, and only its best of the shard leave it.
    """
    n, centres = min(probes or cells.probes, len(cells.centres)), cells.centres
    held = {r.cell: (r.shares, r.n) for r in index.groupBy("cell").agg(F.max("shares").alias("shares"), F.count("*").alias("n")).collect()}  # at most MOST_CELLS rows
    shards = max(8, -(-sum(n for _, n in held.values()) // V.SHARE))
    parts = max(1, -(-queries.count() // V.PART))
    of_cell = [sorted({(c + i) % shards for i in range(held.get(c, (0, 0))[0])}) for c in range(len(centres))]
    asked = lambda x: pa.array([sorted({s for c in row for s in of_cell[c]}) for row in _nearest(x, centres, n).tolist()], pa.list_(pa.int32()))
    q = _mapped(queries.select(F.col(key).alias("query_id"), F.col(vector).alias("__q")), "__q", cells, asked, "shards", ArrayType(IntegerType()), None)
    v = index.select(F.col(key).alias("vec_id"), F.col(vector).alias("__v"), "cell", "share", _clean(vector, cells).alias("__clean"))
    shard = F.pmod(F.col("cell") + F.col("share"), F.lit(shards)).cast("int")
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    dealt = v.where("__clean").select("vec_id", "__v", "cell", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    met = q.where("__clean").select("query_id", "__q", F.explode("shards").alias("shard"), part.alias("part"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    near = dealt.groupBy("shard", "part").cogroup(met.groupBy("shard", "part")).applyInArrow(_probed(k, centres, n), f"query_id {kind(q, 'query_id')}, vec_id {kind(v, 'vec_id')}, score double")
    # Odd vectors lie in the first cell, odd queries look into the first ones.
    first = _mapped(queries.select(F.col(key).alias("query_id"), F.col(vector).alias("__q")), "__q", cells, lambda x: pa.array((_nearest(x, centres, n) == 0).any(1).astype(np.int32)), "first", IntegerType(), 1).where("first = 1")
    spread = lambda df, to: df.select("query_id", "__q", F.explode(F.sequence(F.lit(0), F.lit(to))).alias("cell"))
    plain = lambda a, b: a.join(b, "cell").select("query_id", "vec_id", cosine(F.col("__q"), F.col("__v")).alias("score"))
    odd = plain(v.where("not __clean"), spread(first, 0)).unionByName(plain(v.where("__clean"), spread(q.where("not __clean"), n - 1)))
    return V.ranked(near.unionByName(odd), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_queries, n_exact, n_found, recall): how much of the exact result the index found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_exact"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))
