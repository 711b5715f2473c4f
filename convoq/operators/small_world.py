"""Vector search by hierarchical small-world graphs, one for each bounded shard.

Vectors are dealt to shards by a hash of their ids. In a shard every vector has a level, drawn from its id; a layer holds
the vectors of at least that level, and links each to up to M others there (2 M in the lowest): of its EF nearest, those
that are nearer to it than to one already taken, and the same in the other direction. A search goes greedily down the
layers and then keeps the best `ef` it has seen in the lowest one, always looking at the links of the best not yet
looked at. All queries of a block go side by side, as arrays.

The index is a table with a row a vector: shard, id, vector, level, links (ids, by layer). A search costs a task for each
shard and block of queries; adding vectors changes the rows of their shards only, by searching there, and nothing is built
anew. A shard that is full gets no more: further vectors make new shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoq.scratch import bounded, stored

#: Links a layer, nearest vectors that links are chosen from, vectors of a shard, queries of a block.
M, EF, SHARD, QUERIES = 16, 100, 10_000, 2_000
_ROW = "shard int, id long, v array<float>, level int, links array<array<long>>"
_BLOCK = 256


def _unit(rows) -> np.ndarray:
    x = np.array(list(rows), np.float32)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def _levels(ids: np.ndarray) -> np.ndarray:
    """Of each id its highest layer: one in M vectors goes up from each. A fixed mixing of the id's bits."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    share = ((h >> np.uint64(11)).astype(float) + 1) / 2.0**53
    return np.minimum(8, np.floor(-np.log(share) / np.log(M))).astype(int)


def _varied(x: np.ndarray, at: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """(rows, most) of the candidates near (best first, -1: none) of each row at: nearer to it than to any taken before."""
    out = np.full((len(at), most), -1)
    for s in range(0, len(at), _BLOCK):
        own, cand = x[at[s : s + _BLOCK]], near[s : s + _BLOCK]
        taken, n, rows = np.zeros((len(own), most, x.shape[1]), np.float32), np.zeros(len(own), int), np.arange(len(own))
        for c in cand.T:
            v = x[c]
            to_own, to_taken = (v * own).sum(1), np.einsum("bmd,bd->bm", taken, v)
            to_taken[np.arange(most)[None] >= n[:, None]] = -np.inf
            ok = (c >= 0) & (n < most) & (to_own > to_taken.max(1))
            taken[rows[ok], n[ok]] = v[ok]
            out[s + rows[ok], n[ok]] = c[ok]
            n += ok
    return out


def _both_ways(x: np.ndarray, nodes: np.ndarray, links: dict[int, list[int]], most: int) -> dict[int, list[int]]:
    """links with their reverses; a node that has more than `most` then chooses anew."""
    back: dict[int, set[int]] = {int(u): set(links.get(int(u), ())) for u in nodes}
    for u in list(back):
        for v in links.get(u, ()):
            back.setdefault(v, set(links.get(v, ()))).add(u)
    full = [u for u, vs in back.items() if len(vs) > most]
    if full:
        near = np.full((len(full), 4 * most), -1)
        for i, u in enumerate(full):
            vs = np.array(sorted(back[u]))
            best = vs[np.argsort(-(x[vs] @ x[u]), kind="stable")][: 4 * most]
            near[i, : len(best)] = best
        for u, chosen in zip(full, _varied(x, np.array(full), near, most), strict=True):
            back[u] = set(chosen[chosen >= 0].tolist())
    return {u: sorted(vs) for u, vs in back.items()}


class Shard:
    """The graph of one shard in memory: positions instead of ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, level: np.ndarray, links: list[dict[int, list[int]]]):
        self.ids, self.x, self.level, self.links = ids, x, level, links

    @staticmethod
    def of_rows(pdf: pd.DataFrame) -> Shard:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy(np.int64)
        place = {int(i): p for p, i in enumerate(ids)}
        level = pdf["level"].to_numpy(int)
        links: list[dict[int, list[int]]] = [{} for _ in range(level.max(initial=0) + 1)]
        for p, own in enumerate(pdf["links"]):
            for layer, others in enumerate(own):
                links[layer][p] = [place[int(o)] for o in others if int(o) in place]  # links to vectors that are gone are left out
        return Shard(ids, _unit(pdf["v"]).reshape(len(pdf), -1), level, links)

    @staticmethod
    def built(ids: np.ndarray, x: np.ndarray) -> Shard:
        """Links from exact neighbours: a shard is bounded, and its vectors meet in blocks."""
        level = _levels(ids)
        links = []
        for layer in range(level.max(initial=0) + 1):
            nodes = np.flatnonzero(level >= layer)
            most, near = M * (2 if layer == 0 else 1), np.full((len(nodes), min(EF, len(nodes) - 1)), -1)
            for s in range(0, len(nodes) if near.shape[1] else 0, _BLOCK):
                sim = x[nodes[s : s + _BLOCK]] @ x[nodes].T
                sim[np.arange(len(sim)), s + np.arange(len(sim))] = -np.inf
                near[s : s + _BLOCK] = nodes[np.argsort(-sim, axis=1, kind="stable")[:, : near.shape[1]]]
            chosen = _varied(x, nodes, near, M)
            links.append(_both_ways(x, nodes, {int(u): c[c >= 0].tolist() for u, c in zip(nodes, chosen, strict=True)}, most))
        return Shard(ids, x, level, links)

    def table(self, layer: int) -> np.ndarray:
        """(vectors, most links) of a layer, filled up with -1."""
        width = max([1, *(len(v) for v in self.links[layer].values())])
        out = np.full((len(self.ids), width), -1)
        for u, vs in self.links[layer].items():
            out[u, : len(vs)] = vs
        return out

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, scores, distances computed): the ef best seen of each query, best first; -1: none."""
        place, score = np.full((len(q), ef), -1), np.full((len(q), ef), -np.inf, np.float32)
        tables, cost = [self.table(layer) for layer in range(len(self.links))], np.zeros(len(q), int)
        for s in range(0, len(q), _BLOCK):
            place[s : s + _BLOCK], score[s : s + _BLOCK], cost[s : s + _BLOCK] = self._side_by_side(q[s : s + _BLOCK], ef, tables)
        return place, score, cost

    def _side_by_side(self, q: np.ndarray, ef: int, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, cost = np.arange(len(q)), np.ones(len(q), int)
        at = np.full(len(q), int(np.argmax(self.level)))
        best = q @ self.x[at[0]]
        for links in tables[:0:-1]:
            going = rows
            while len(going):
                near = links[at[going]]
                sim = np.where(near >= 0, np.einsum("qld,qd->ql", self.x[near], q[going]), -np.inf)
                cost[going] += (near >= 0).sum(1)
                top = sim.argmax(1)
                better = sim[np.arange(len(going)), top] > best[going]
                at[going[better]], best[going[better]] = near[better, top[better]], sim[better, top[better]]
                going = going[better]
        place, score, seen = np.full((len(q), ef), -1), np.full((len(q), ef), -np.inf, np.float32), np.zeros((len(q), len(self.ids)), bool)
        place[:, 0], score[:, 0], open_ = at, best, np.zeros((len(q), ef), bool)
        open_[:, 0], seen[rows, at] = True, True
        going = rows
        while len(going):
            pick = np.where(open_[going], score[going], -np.inf).argmax(1)
            near = tables[0][place[going, pick]]
            open_[going, pick] = False
            new = (near >= 0) & ~seen[going[:, None], near]
            seen[np.broadcast_to(going[:, None], near.shape)[new], near[new]] = True
            sim = np.where(new, np.einsum("qld,qd->ql", self.x[near], q[going]), -np.inf)
            cost[going] += new.sum(1)
            all_place, all_score, all_open = np.hstack([place[going], near]), np.hstack([score[going], sim]), np.hstack([open_[going], new])
            top = np.argsort(-all_score, axis=1, kind="stable")[:, :ef]
            place[going], score[going], open_[going] = (np.take_along_axis(a, top, 1) for a in (all_place, all_score, all_open))
            going = going[(open_[going] & np.isfinite(score[going])).any(1)]
        place[~np.isfinite(score)] = -1
        return place, score, cost

    def extended(self, ids: np.ndarray, x: np.ndarray) -> Shard:
        """With more vectors: their nearest are found by searching, and among each other; only what they touch changes."""
        if not len(self.ids):
            return Shard.built(ids, x)
        n, level = len(self.ids), _levels(ids)
        place, _, _ = self.search(x, EF)
        all_x, all_level = np.vstack([self.x, x]), np.concatenate([self.level, level])
        links: list[dict[int, list[int]]] = [dict(layer) for layer in self.links] + [{} for _ in range(level.max(initial=0) + 1 - len(self.links))]
        for layer, own in enumerate(links):
            nodes = n + np.flatnonzero(level >= layer)
            if not len(nodes):
                continue
            others = x[nodes - n] @ x[nodes - n].T
            np.fill_diagonal(others, -np.inf)
            mates = nodes[np.argsort(-others, axis=1, kind="stable")[:, : min(EF, len(nodes) - 1)]]
            old = place[nodes - n] if layer == 0 else np.tile(np.flatnonzero(self.level >= layer), (len(nodes), 1))  # upper layers are few
            cand = np.hstack([old, mates.reshape(len(nodes), -1)]).astype(int)
            sim = np.where(cand >= 0, np.einsum("qld,qd->ql", all_x[cand], x[nodes - n]), -np.inf) if cand.shape[1] else np.zeros(cand.shape)
            cand = np.take_along_axis(cand, np.argsort(-sim, axis=1, kind="stable")[:, :EF], 1)
            chosen = _varied(all_x, nodes, cand, M)
            for u, c in zip(nodes, chosen, strict=True):
                own[int(u)] = c[c >= 0].tolist()
            own |= _both_ways(all_x, nodes, own, M * (2 if layer == 0 else 1))
        return Shard(np.concatenate([self.ids, ids]), all_x, all_level, links)

    def rows(self, shard: int) -> pd.DataFrame:
        links = [[self.ids[layer[p]].tolist() if layer.get(p) else [] for layer in self.links[: self.level[p] + 1]] for p in range(len(self.ids))]
        return pd.DataFrame({"shard": shard, "id": self.ids, "v": list(self.x), "level": self.level, "links": links})


def _dealt(vectors: DataFrame, first: int, shards: int, key: str, vector: str) -> DataFrame:
    v = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    return v.select((F.pmod(F.xxhash64("id"), F.lit(shards)) + first).cast("int").alias("shard"), "id", "v")


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The index of vectors with distinct keys, stored; rows with a null key or vector are not in it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return Shard.built(pdf["id"].to_numpy(np.int64), _unit(pdf["v"])).rows(int(pdf["shard"].iloc[0]))

    shards = max(1, -(-vectors.count() // shard))
    return stored(_dealt(vectors, 0, shards, key, vector).groupBy("shard").applyInPandas(run, _ROW), "small_world")


def extend(index: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """index with more vectors, or other ones for ids that it has; stored. Shards that get nothing stay as they are."""
    sizes = index.groupBy("shard").count().collect()  # a row a shard
    room = sum(max(0, shard - r["count"]) for r in sizes)
    count, first = vectors.count(), max([-1, *(r.shard for r in sizes)]) + 1
    new = _dealt(vectors, 0, first, key, vector) if first and count <= room else _dealt(vectors, first, max(1, -(-count // shard)), key, vector)
    gone = vectors.select(F.col(key).cast("long").alias("id"))
    kept = index.join(bounded(gone), "id", "left_anti").select("shard", "id", "v", "level", "links")

    def run(pair: tuple, old: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        if not len(more):
            return old
        more = more.sort_values("id")
        ids, x = more["id"].to_numpy(np.int64), _unit(more["v"])
        return (Shard.of_rows(old).extended(ids, x) if len(old) else Shard.built(ids, x)).rows(int(pair[0]))

    return stored(kept.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(run, _ROW), "small_world")


def search(queries: DataFrame, index: DataFrame, k: int = 30, ef: int = EF, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, distances): the k best that were found, ties to the smaller id; distances computed for the query."""
    blocks = max(1, -(-queries.count() // QUERIES))
    shards = index.select((F.col("shard") + 0).alias("shard")).distinct()
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).crossJoin(bounded(shards))  # each shard answers each query
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(pair: tuple, rows: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "distances": pd.Series(dtype="int64")})
        if not len(rows) or not len(q):
            return out
        graph, q = Shard.of_rows(rows), q.sort_values("id")
        place, score, cost = graph.search(_unit(q["v"]), ef)
        at, rank = np.nonzero(place[:, :k] >= 0)
        return pd.DataFrame({"query_id": q["id"].to_numpy()[at], "vec_id": graph.ids[place[at, rank]], "score": np.round(score[at, rank].astype(float), 6), "distances": np.where(rank == 0, cost[at], 0)})

    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(run, "query_id long, vec_id long, score double, distances long")
    total = F.sum("distances").over(Window.partitionBy("query_id"))  # at most k rows of a shard for a query
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("distances", total).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "distances")
