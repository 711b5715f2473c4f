"""Hard negatives by a vector-approximation file.

Every component of a vector becomes floor(256 x), a whole number, and then one of CELLS cells of its
dimension. The file has a row for a block of vectors: cell numbers, whole numbers, ids and labels. For
an anchor, a table gives the least and largest product that a cell of a dimension can have with the
anchor's component; adding up looked-up entries bounds a vector's score from below and above, and only
vectors whose bounds reach a window (and its fifth best score so far) are scored exactly. Bounds never
exclude a vector that belongs to the result, so the result is that of scoring everything.

Cells are cut at quantiles of at most SAMPLE vectors; the outermost cells of a block end at the block's
own extremes. The sample decides how tight bounds are, never the result.

Anchors go to the tasks in blocks of about ANCHORS (numbered by a hash), two passes over the file each:
the first finds an anchor's positives, the second the negatives in the windows below them. A task keeps
the best few of each anchor, whatever it reads, so hot labels or vectors fill nothing; only those few
are shuffled.

Defined cases: rows with a null label or vector, or a component that is null or not finite, take no
part. A null vec_id is no anchor and comes last among ties. Rows that repeat an id or a whole row are
rows of their own: an anchor's positives may be its copies, never itself. A shorter vector counts as
filled up with zeros. Whole numbers beyond +-2**20 count as that. Rows with equal scores and ids are
interchangeable. No anchors or an empty table give an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoq.llm.common import dropped, written
from convoq.shipping import ship

CELLS = 32
SAMPLE = 20_000
#: Bytes of a block in the file, and anchors of a pass.
BLOCK_BYTES, ANCHORS = 1 << 20, 4096
#: Anchors whose tables and bounds are held at once.
LOOKUP = 64
LARGEST = 1 << 20
_NONE, _NO_ID = -(1 << 62), (1 << 63) - 1
_BLOCK = "n int, ids binary, labels binary, anchor binary, cells binary, numbers binary"


def whole_numbers(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """(id, label, anchor, v): the rows that take part, v as whole numbers."""
    x = vectors.select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("v"),
    )
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    number = lambda c: F.least(F.greatest(F.floor(c * 256.0), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    return x.where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd).withColumn("v", F.transform("v", number))


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """The rows of a list column, filled up with zeros to one length."""
    flat, n = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if (n == dims).all():
        return flat.reshape(len(n), dims).astype(np.int32)
    out = np.zeros((len(n), dims), np.int32)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def marks(rows: DataFrame, dims: int, total: int) -> np.ndarray:
    """(dims, CELLS - 1) inner boundaries: quantiles of a bounded sample, chosen by a hash."""
    share = F.lit(int(min(1.0, SAMPLE / max(1, total)) * (1 << 31)))
    some = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 31)) < share).select("v").limit(SAMPLE).toArrow()
    v = _matrix(some.column("v").combine_chunks(), dims) if some.num_rows else np.zeros((1, dims), np.int32)
    return np.ascontiguousarray(np.quantile(v, np.arange(1, CELLS) / CELLS, axis=0, method="lower").T.astype(np.int32))


def vector_file(rows: DataFrame, dims: int, inner: np.ndarray) -> DataFrame:
    """The written file: blocks of vectors, by label within a block, and a number for each block."""
    at_once = max(16, BLOCK_BYTES // max(1, 5 * dims))

    def block(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, labels, anchor, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, labels))
        ids, labels, anchor, v = ids[order], labels[order], anchor[order], v[order]
        cells = np.empty(v.shape, np.uint8)
        for d in range(dims):
            cells[:, d] = np.searchsorted(inner[d], v[:, d], "right")
        return pa.RecordBatch.from_arrays(
            [pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, anchor, cells, v))],
            ["n", "ids", "labels", "anchor", "cells", "numbers"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, at_once):
                part = b.slice(at, at_once)
                ids = part.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                lists = pa.concat_arrays([part.column(3)])  # a slice of its own, so that offsets begin at 0
                held.append((ids, part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False).astype(np.uint8), _matrix(lists, dims)))
                n += part.num_rows
                if n >= at_once:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    packed = rows.select("id", "label", "anchor", "v").mapInArrow(pack, _BLOCK)
    return written(packed.withColumn("block", F.monotonically_increasing_id()), "vector_file")


def _unpacked(b: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray, ...]]:
    for r in b.to_pylist():
        ids, labels, anchor = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), np.frombuffer(r["anchor"], np.uint8)
        yield r["block"], ids, labels, anchor, np.frombuffer(r["cells"], np.uint8).reshape(r["n"], dims), np.frombuffer(r["numbers"], np.int32).reshape(r["n"], dims)


def _anchors(file: DataFrame, dims: int) -> DataFrame:
    """(block, pos, id, label, v): the anchors of the file; v is binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids, labels, anchor, _, v in _unpacked(b, dims):
                at = np.flatnonzero(anchor & (ids != _NO_ID))
                arrays = [pa.array(np.full(len(at), block)), pa.array(at), pa.array(ids[at]), pa.array(labels[at]), pa.array([v[i].tobytes() for i in at], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "pos", "id", "label", "v"])

    return file.mapInArrow(run, "block long, pos long, id long, label long, v binary")


def bounds(cells: np.ndarray, low: np.ndarray, high: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, anchors) least and largest scores that rows in these cells can have, by table look-up.

    low, high: (dims, CELLS) ends of the cells. The sums are exact: the type is as wide as the largest sum needs.
    """
    most = int(max(np.abs(low).max(initial=1), np.abs(high).max(initial=1))) * int(np.abs(anchors).max(initial=1)) * max(1, anchors.shape[1])
    kind = np.int32 if most < 1 << 31 else np.int64
    a = anchors.T.astype(kind)
    below, above = np.zeros((2, len(cells), anchors.shape[0]), kind)
    for d in range(anchors.shape[1]):
        x, y = low[d, :, None].astype(kind) * a[d], high[d, :, None].astype(kind) * a[d]
        below += np.minimum(x, y)[cells[:, d]]
        above += np.maximum(x, y)[cells[:, d]]
    return below, above


def _ends(inner: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dims, CELLS) least and largest whole number in a cell of this block."""
    least, most = v.min(0)[:, None], v.max(0)[:, None]
    return np.clip(np.hstack([least, inner]), least, most), np.clip(np.hstack([inner - 1, most]), least, most)


class _Best:
    """The k best (score, id) of each of so many searches: larger scores first, then smaller ids."""

    def __init__(self, searches: int, k: int):
        self.score, self.id = np.full((searches, k), _NONE, np.int64), np.full((searches, k), _NO_ID, np.int64)

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched, k = np.unique(which), self.score.shape[1]
        g = np.concatenate([which, np.repeat(touched, k)])
        s, i = np.concatenate([score, self.score[touched].ravel()]), np.concatenate([ids, self.id[touched].ravel()])
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        first = np.searchsorted(g, touched)
        rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        top = rank < k
        self.score[g[top], rank[top]], self.id[g[top], rank[top]] = s[top], i[top]

    def found(self) -> pa.RecordBatch:
        which, rank = np.nonzero(self.score > _NONE)
        ids = self.id[which, rank]
        return pa.RecordBatch.from_arrays([pa.array(which), pa.array(ids, mask=ids == _NO_ID), pa.array(self.score[which, rank])], ["search", "id", "score"])


def _exact(v: np.ndarray, anchors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parts = [np.einsum("nd,nd->n", v[i[x : x + 8192]].astype(np.int64), anchors[j[x : x + 8192]]) for x in range(0, len(i), 8192)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _best_found(file: DataFrame, search, searches: int, k: int, dims: int) -> DataFrame:
    """(search, id, score, rank) over all blocks; search(best, block) adds a block's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(searches, k)
        for b in batches:
            for block in _unpacked(b, dims):
                search(best, *block)
        yield best.found()

    each = file.mapInArrow(run, "search long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("search").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return each.withColumn("rank", rank).where(F.col("rank") <= k)


def _positives(anchors, inner: np.ndarray, k: int):
    def search(best: _Best, block: int, ids, labels, _, cells, v) -> None:
        a = anchors.value
        low, high = _ends(inner, v)
        starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
        for s, e in zip(starts, [*starts[1:], len(labels)], strict=True):
            same = a["of"].get(int(labels[s]), ())
            for x in range(0, len(same), LOOKUP):
                some = same[x : x + LOOKUP]
                below, above = bounds(cells[s:e], low, high, a["v"][some])
                own = np.flatnonzero((a["block"][some] == block) & (a["pos"][some] >= s) & (a["pos"][some] < e))
                can = np.ones(below.shape, bool)
                can[a["pos"][some[own]] - s, own] = False
                least = best.score[some, k - 1]
                if e - s > k and (least == _NONE).any():  # the block's own k best lower bounds
                    kth = np.partition(np.where(can, below, np.iinfo(below.dtype).min), e - s - k, axis=0)[e - s - k]
                    least = np.where(least == _NONE, kth, least)
                i, j = np.nonzero(can & (above >= least))
                best.add(some[j], _exact(v[s:e], a["v"][some], i, j), ids[s:e][i])

    return search


def _negatives(anchors, windows, inner: np.ndarray, k: int):
    def search(best: _Best, block: int, ids, labels, _, cells, v) -> None:
        a, (lo, hi) = anchors.value, windows.value
        low, high = _ends(inner, v)
        for x in range(0, len(a["label"]), LOOKUP):
            some = np.arange(x, min(x + LOOKUP, len(a["label"])))
            below, above = bounds(cells, low, high, a["v"][some])
            can = np.zeros(below.shape, bool)
            for w in range(lo.shape[1]):
                can |= (above >= np.maximum(lo[some, w], best.score[some * lo.shape[1] + w, k - 1])) & (below <= hi[some, w])
            i, j = np.nonzero(can & (labels[:, None] != a["label"][some]))
            score = _exact(v, a["v"][some], i, j)
            for w in range(lo.shape[1]):
                inside = (score >= lo[some[j], w]) & (score <= hi[some[j], w])
                best.add(some[j[inside]] * lo.shape[1] + w, score[inside], ids[i[inside]])

    return search


def _pass(file: DataFrame, some: pa.Table, inner: np.ndarray, dims: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The negatives of one block of anchors."""
    spark = file.sparkSession
    label = some.column("label").to_numpy()
    a = {c: some.column(c).to_numpy() for c in ("block", "pos", "id", "label")}
    a["v"] = np.array([np.frombuffer(x, np.int32) for x in some.column("v").to_pylist()], np.int64).reshape(len(label), dims)
    a["of"] = {int(x): np.flatnonzero(label == x) for x in np.unique(label)}
    anchors = spark.sparkContext.broadcast(a)
    pos = written(_best_found(file, _positives(anchors, inner, positives), len(label), positives, dims), "positives")
    found = pos.toArrow()  # at most `positives` rows an anchor of this block
    lo, hi = np.full((2, len(label), positives), _NONE, np.int64)
    lo[:] = 1 - _NONE
    s, p, r = (found.column(c).to_numpy() for c in ("search", "score", "rank"))
    lo[s, r - 1], hi[s, r - 1] = -((-low * p) // 100), (high * p) // 100
    windows = spark.sparkContext.broadcast((lo, hi))
    neg = _best_found(file, _negatives(anchors, windows, inner, negatives), len(label) * positives, negatives, dims)
    ids = spark.createDataFrame(pa.table({"search": np.arange(len(label)), "anchor_id": a["id"]}))
    named = pos.join(F.broadcast(ids), "search").select((F.col("search") * positives + F.col("rank") - 1).alias("search"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = neg.join(F.broadcast(named), "search").select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = written(out, "negatives")
    dropped(pos)
    for b in (anchors, windows):
        b.unpersist()
    return out


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: vec_id, label, embedding. An anchor's positives are its best other rows of the same label; for each of them,
    the best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = whole_numbers(vectors, is_anchor)
    size = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = size[1] or 0
    inner = marks(rows, dims, size[0])
    file = vector_file(rows, dims, inner)
    anchors = written(_anchors(file, dims), "anchors")
    passes = -(-anchors.count() // ANCHORS)
    number = F.pmod(F.xxhash64("block", "pos"), F.lit(max(1, passes)))
    parts = [_pass(file, anchors.where(number == n).orderBy("block", "pos").toArrow(), inner, dims, positives, negatives, low, high) for n in range(passes)]
    dropped(file, anchors)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(*[p.written_path for p in parts]) if parts else spark.createDataFrame([], schema)
