"""Neighbour graphs, layouts, sparse spectra, linear agglomeration, small-world search, scans in two levels."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from convoq.operators import graphs as G
from convoq.operators import scan as scans
from convoq.operators import sequence as S
from convoq.operators import small_world as W
from convoq.operators import spectra
from convoq.operators import vectors as V
from convoq.operators.intervals import asof

SCHEMA = "vec_id long, embedding array<double>, label int"


def blobs(n, centres, dims, spread, seed=1):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, centres, n)
    return rng.normal(size=(centres, dims))[label] + spread * rng.normal(size=(n, dims)), label


def frame(spark, x, label=None):
    return spark.createDataFrame([(i, v.tolist(), 0 if label is None else int(label[i])) for i, v in enumerate(x)], SCHEMA)


def nearest(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    return np.argsort(-s, axis=1)[:, :k]


def trustworthiness(x, y, k=10):
    """1 minus how far those that are near in y and not in x are from it in x, by ranks (0 to 1)."""
    n = len(x)
    rank = np.argsort(np.argsort(-(u := x / np.linalg.norm(x, axis=1, keepdims=True)) @ u.T, axis=1), axis=1)
    d = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * sum(np.maximum(0, rank[i, near[i]] - k).sum() for i in range(n))


def test_neighbour_graph_finds_the_neighbours(spark):
    x, _ = blobs(500, 6, 24, 0.5)
    x[200:360] = x[200]  # one vector, a third of all rows
    found = {r.id: [n.id for n in r.near] for r in G.neighbours(frame(spark, x), 10).collect()}
    assert set(found) == set(range(500)) and all(len(set(v)) == 10 and i not in v for i, v in found.items())
    alone = [i for i in range(500) if not 200 <= i < 360]
    exact = nearest(x, 10)
    assert np.mean([len({j if not 200 <= j < 360 else 200 for j in found[i]} & {j if not 200 <= j < 360 else 200 for j in exact[i].tolist()}) / len({j if not 200 <= j < 360 else 200 for j in exact[i].tolist()}) for i in alone]) > 0.95
    assert all(200 <= j < 360 for j in found[250])
    none = frame(spark, x[:0])
    assert G.neighbours(none, 3).count() == 0


def test_layout_keeps_neighbours_better_than_principal_components(spark):
    x, label = blobs(400, 8, 48, 0.6)
    df = frame(spark, x, label)
    positions = lambda d: np.array([r.at for r in sorted(d.collect())])
    whole = positions(G.layout(df))
    assert whole.shape == (400, 10) and trustworthiness(x, whole) > trustworthiness(x, positions(G.principal(df, 10)))
    groups = positions(G.layout(df, group=90))
    assert trustworthiness(x, groups) > 0.95
    found = G.layout_kmeans(df, 8).collect()
    assert found and sorted(found) == sorted(G.layout_kmeans(df, 8).collect())  # same seed, same labels
    of = {r.vec_id: r.cluster for r in found}
    assert sum(np.bincount([label[i] for i in of if of[i] == c]).max() for c in set(of.values())) > 0.98 * 400
    assert of[0] == 0 and {r.label for r in found} == {f"SPEAKER_{c:02d}" for c in of.values()}


def test_sparse_spectra_give_the_labels_of_the_dense_form(spark, monkeypatch):
    x, _ = blobs(240, 4, 16, 0.4, seed=3)
    df = frame(spark, x).withColumn("meeting_id", F.lit(1)).unionByName(frame(spark, x[:30] + 1).withColumn("meeting_id", F.lit(2)))
    dense = {(r.meeting_id, r.vec_id): r.cluster for r in V.cluster_groups(df, "meeting_id").collect()}
    monkeypatch.setattr(V, "MOST_ROWS", 100)  # the first group is beyond it
    sparse = {(r.meeting_id, r.vec_id): r.cluster for r in V.cluster_groups(df, "meeting_id").collect()}
    assert dense == sparse and len(set(dense.values())) >= 4


def test_leading_vectors_are_eigenvectors(spark):
    x, _ = blobs(120, 3, 8, 0.8, seed=5)
    unit = G.stored(frame(spark, x).select(F.col("vec_id").alias("id"), G.normalized(F.col("embedding")).alias("v")))
    graph = spectra.edges(unit, 6)
    a = np.zeros((120, 120))
    for r in graph.collect():
        a[r.u, r.v] = r.w
    y, values = spectra.leading(graph, unit, 3)
    assert np.allclose(a, a.T) and np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1][:3], atol=1e-3)
    cols = np.array([list(r)[1:] for r in sorted(y.collect())])
    assert np.abs(a @ cols - cols * values).max() < 0.02


def test_products_by_parts_are_those_of_the_whole_graph(spark, monkeypatch):
    x, _ = blobs(120, 3, 8, 0.8, seed=5)
    unit = G.stored(frame(spark, x).select(F.col("vec_id").alias("id"), G.normalized(F.col("embedding")).alias("v")))
    graph = spectra.edges(unit, 6)
    monkeypatch.setattr(spectra, "PART", 30)
    of = {r.id: r.part for r in spectra._parts(unit).collect()}
    rows = graph.collect()
    a, y = np.zeros((120, 120)), np.random.default_rng(1).normal(size=(2, 120, 2))
    for r in rows:
        a[r.u, r.v] = r.w
    wanted = {i: sorted({of[r.u] for r in rows if r.v == i}) for i in of}
    now, before = (spark.createDataFrame([(i, of[i], wanted[i], y[t, i].tolist()) for i in of], spectra._STATE) for t in (0, 1))
    placed = spark.createDataFrame([(r.u, r.v, r.w, of[r.u]) for r in rows], "u long, v long, w double, part int")
    got = sorted(spectra._times(placed, now, 2, before, 2.0, 0.25).collect())
    assert len(set(of.values())) == 4 and [r.wanted for r in got] == [wanted[i] for i in range(120)]
    assert np.allclose([r.y for r in got], 2 * (a @ y[0] - 0.25 * y[0]) - y[1])


def merge_matrix(x, least=2, most=20):
    """Average linkage by scanning the whole matrix of distances before each merge."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    dist = 1 - u @ u.T
    groups, best, found = [[i] for i in range(len(x))], -np.inf, None
    while len(groups) > least:
        _, i, j = min((dist[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
        if len(groups) <= most:
            label = np.zeros(len(x), int)
            for c, g in enumerate(groups):
                label[g] = c
            own = np.array([dist[i][label == label[i]].sum() / max(1, (label == label[i]).sum() - 1) for i in range(len(x))])
            other = np.array([min(dist[i][label == c].mean() for c in range(len(groups)) if c != label[i]) for i in range(len(x))])
            one = np.array([(label == c).sum() == 1 for c in label])
            score = np.where(one, 0, (other - own) / np.maximum(other, own)).mean()
            if score > best + 1e-12:
                best, found = score, label
    return found


@pytest.mark.parametrize("seed", range(6))
def test_agglomeration_is_that_of_the_whole_matrix(seed):
    x, _ = blobs(26 + seed, 5, 6, 0.5 + 0.1 * seed, seed=seed)
    got, want = V.agglomerative(x, most=8), merge_matrix(x, most=8)
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(x)) for j in range(i))


def test_agglomeration_needs_no_matrix():
    x, label = blobs(6000, 5, 8, 0.1)
    found = V.agglomerative(x)
    assert len(set(found.tolist())) == 5 and all(len(set(found[label == c].tolist())) == 1 for c in range(5))


# Search by graphs -----------------------------------------------------------------------------------------------------


def test_search_finds_most_with_few_distances(spark):
    x, _ = blobs(4000, 60, 24, 0.5)
    df = frame(spark, x)
    index = W.build(df, shard=4000)
    asked = df.where("vec_id % 100 = 0")
    got = W.search(asked, index, 30, ef=60).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = {i: set(np.argsort(-(u @ u[i]))[:30].tolist()) for i in range(0, 4000, 100)}
    found = {i: {r.vec_id for r in got if r.query_id == i} for i in exact}
    assert all(len(f) == 30 for f in found.values())
    assert np.mean([len(found[i] & exact[i]) / 30 for i in exact]) >= 0.9
    assert np.mean([r.distances for r in got if r["rank"] == 1]) < 4000 / 5
    assert [r.vec_id for r in got if r["rank"] == 1 and r.query_id == 300] == [300]


def test_index_is_extended_and_updated(spark):
    x, _ = blobs(1200, 20, 12, 0.5, seed=2)
    df = frame(spark, x)
    index = W.build(df.where("vec_id < 800"), shard=500)
    before = {r.id: (r.shard, r.v) for r in index.collect()}
    assert len({s for s, _ in before.values()}) == 2
    more = W.extend(index, df.where("vec_id >= 800"), shard=500)  # no room: a shard of its own, the others as they were
    after = {r.id: (r.shard, r.v, r.links) for r in more.collect()}
    assert set(after) == set(range(1200)) and all(after[i][:2] == before[i] for i in before)
    moved = spark.createDataFrame([(5, (-x[5]).tolist(), 0), (7, x[700].tolist(), 0)], SCHEMA)
    new = W.extend(more, moved, shard=5000)  # room: they go into shards that are there
    assert new.count() == 1200 and len({r.shard for r in new.select("shard").distinct().collect()}) == 3
    y = x.copy()
    y[5], y[7] = -x[5], x[700]
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    got = W.search(df.where("vec_id % 40 = 0"), new, 10, ef=80).collect()
    want = {i: set(np.argsort(-(u @ (x[i] / np.linalg.norm(x[i]))))[:10].tolist()) for i in range(0, 1200, 40)}
    assert np.mean([len({r.vec_id for r in got if r.query_id == i} & want[i]) / 10 for i in want]) >= 0.95
    twin = W.search(df.where("vec_id = 700"), new, 2).collect()
    assert {r.vec_id for r in twin} == {7, 700}
    assert W.search(df.limit(0), new, 3).count() == 0
    assert W.build(df.limit(0)).count() == 0
    assert W.extend(W.build(df.limit(0)), df.limit(40)).count() == 40


# Scans in two levels ---------------------------------------------------------------------------------------------------


def rows_of_meetings(rng, n=300):
    out, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, 5, 40, 400])
        out.append((rng.choice([1, 1, 1, 2, None]), at if rng.random() < 0.97 else None, i, rng.choice(["a", "b", None]), rng.randrange(50)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_two_levels_give_what_a_window_gives(spark, seed):
    df = spark.createDataFrame(rows_of_meetings(random.Random(seed)), "m long, t long, i long, who string, v long")
    w = Window.partitionBy("m").orderBy("t", "i")
    upto, above = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.lag("who").over(w).alias("p"), F.sum("v").over(upto).alias("s"), F.max("v").over(above).alias("x"), F.last("who", ignorenulls=True).over(upto).alias("l"))
    kinds = {"previous": {"p": F.col("who")}, "total": {"s": F.col("v")}, "most": {"x": F.col("v")}, "latest": {"l": F.col("who")}}
    for binned in (True, False):
        got = scans.scan(df, "m", ["t", "i"], **kinds, width=70, binned=binned)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_one_huge_meeting_is_spread(spark, monkeypatch):
    """All rows in one meeting: the same results, and no task that holds more than a bin."""
    rng = random.Random(9)
    rows, at = [], 0
    for i in range(2000):
        at += rng.choice([20, 300, 700, 2500])
        rows.append((1, i, rng.choice("ab"), at, at + rng.choice([100, 900]), rng.choice(["x.", "y", "z?"])))
    df = spark.createDataFrame(rows, "meeting_id long, seq long, speaker string, start_ms long, end_ms long, word string").withColumn("word_idx", F.col("seq"))
    forms = {
        "runs": lambda: S.merge_runs(df, "meeting_id", "seq", "speaker", "word"), "gaps": lambda: S.gap_segments(df, "meeting_id"), "silence": lambda: S.silence_chunks(df, "meeting_id", "seq"),
        "union": lambda: S.interval_union(df, "meeting_id"), "capped": lambda: S.capped_groups(df, "meeting_id", "seq"), "sentences": lambda: S.assemble_sentences(df, "meeting_id"),
        "topics": lambda: S.topic_groups(df, "meeting_id", "seq"), "labels": lambda: S.label_runs(df, "meeting_id", "seq", "speaker"), "asof": lambda: asof(df.select("meeting_id", "seq", "start_ms"), "start_ms", df),
    }
    whole = {k: sorted(map(str, f().collect())) for k, f in forms.items()}
    monkeypatch.setattr(scans, "MANY", 100)
    for k, f in forms.items():
        assert sorted(map(str, f().collect())) == whole[k], k
    assert scans.crowded(df, "meeting_id")
    binned = scans.scan(df, "meeting_id", ["start_ms", "seq"], previous={"p": F.col("speaker")}, width=60_000).groupBy(F.spark_partition_id()).count()
    plan = scans.scan(df, "meeting_id", ["start_ms", "seq"], previous={"p": F.col("speaker")}, width=60_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "__bin" in plan and binned.agg(F.sum("count")).first()[0] == 2000


def test_a_group_is_laid_out_from_arrays():
    import numpy as np
    import pyarrow as pa

    from convoq.operators.graphs import _matrix, _move

    rng = np.random.default_rng(0)
    ends = np.array([(u, (u + d) % 60) for u in range(50) for d in (1, 2, 7)])[rng.permutation(150)]
    at = rng.normal(0, 3, (60, 4))
    lists = lambda c: pa.array(at[ends[:, c]].tolist(), pa.list_(pa.float64()))
    t = pa.table([ends[:, 0], ends[:, 1], np.ones(150), lists(0), lists(1)], ["u", "v", "weight", "at_u", "at_v"])
    still = _move(t, 4, 0, 1.0, 0.5, 3)  # no pass: nodes stay, but for the jitter
    assert still["id"].to_pylist() == list(range(50)) and np.abs(_matrix(still["at"].combine_chunks()) - at[:50]).max() < 1e-3
    split = pa.concat_tables([t.slice(0, 70), t.slice(70)])  # batches do not matter
    assert _move(split, 4, 5, 1.0, 0.5, 3).equals(_move(t, 4, 5, 1.0, 0.5, 3))
