"""Vectors: nearest neighbours, centroids, cluster agreement, reassignment, clustering within groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoq.functions.vectors import EPS, cosine, dot, euclidean
from convoq.operators.scan import crowded, numbered, scan
from convoq.scratch import bounded

#: Fixed values of the reassignment.
FIRM = 0.35
OUTLIER_STD = 1.5
#: Rows of a group whose matrix (of doubles, 200 MB) one task holds; rows of a group that one task agglomerates.
MOST_ROWS, MOST_MERGED = 5_000, 50_000
#: Vectors of a share and queries of a part of the exact search, and queries whose scores of a share are held at once.
SHARE, PART, BLOCK = 50_000, 20_000, 64


def matrix(t: pa.Table, column: str) -> np.ndarray:
    """A column of arrays of one length as rows of doubles."""
    return np.asarray(t[column].combine_chunks().flatten()).reshape(t.num_rows, -1).astype(float)


def units(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + EPS)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each two rows, summed in the order of `functions.vectors.cosine`."""
    summed = lambda x: np.cumsum(x, axis=1)[:, -1]
    return summed(a * b) / ((np.sqrt(summed(a * a)) + EPS) * (np.sqrt(summed(b * b)) + EPS))


def _candidates(k: int):
    """Of a share of vectors and a part of the queries: (query_id, vec_id, score) of each query's best k and all that may tie with them.

    A product of matrices chooses, then `scores` are computed.
    """

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(vectors["vec_id"].combine_chunks()[:0], queries["query_id"].combine_chunks()[:0], np.zeros(0))]
        if vectors.num_rows and queries.num_rows:
            v, q = matrix(vectors, "__v"), matrix(queries, "__q")
            columns = units(v).T
            for at in range(0, len(q), BLOCK):
                part = q[at : at + BLOCK]
                near = units(part) @ columns
                least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else near.min(1)
                a, b = np.nonzero(near >= least[:, None] - 1e-8)
                found.append((vectors["vec_id"].combine_chunks().take(pa.array(b)), queries["query_id"].combine_chunks().take(pa.array(a + at)), scores(part[a], v[b])))
        ids, asked, values = zip(*found, strict=True)
        return pa.table([pa.chunked_array(asked), pa.chunked_array(ids), pa.array(np.concatenate(values))], ["query_id", "vec_id", "score"])

    return run


def numbers(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < 1e100))


def best_of(vectors: DataFrame, queries: DataFrame, by: list[str], k: int) -> DataFrame:
    """(query_id, vec_id, score), unrounded: at least the best k of each query in each group of vectors (by, vec_id, __v).

    queries (by, query_id, __q). Vectors of finite numbers meet as matrices, by length; the others by the expression.
    """
    clean = lambda df, c: df.where(numbers(c)).withColumn("__n", F.size(c))
    v, q = clean(vectors, "__v"), clean(queries, "__q")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    near = v.where("__n > 0").groupBy(*by, "__n").cogroup(q.where("__n > 0").groupBy(*by, "__n")).applyInArrow(_candidates(k), f"query_id {kind(queries, 'query_id')}, vec_id {kind(vectors, 'vec_id')}, score double")
    plain = lambda a, b: a.join(b, by).select("query_id", "vec_id", cosine(F.col("__q"), F.col("__v")).alias("score"))
    odd_v, odd_q = (df.where(~(numbers(c) & (F.size(c) > 0)) | F.col(c).isNull()) for df, c in ((vectors, "__v"), (queries, "__q")))
    return near.unionByName(plain(odd_v, queries)).unionByName(plain(vectors.where(numbers("__v") & (F.size("__v") > 0)), odd_q))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k of each query by scores of nine decimals, ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("score", F.round("score", 9)).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def knn(queries: DataFrame, vectors: DataFrame, k: int = 30, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest cosine for each query, ties to the smaller id.

    The exact form: every query meets every vector. Shares of the vectors meet parts of the queries as matrices, so a
    task holds one share and one part, and only the best of a share leave it. `operators.index` has the form whose work
    does not grow with queries times vectors.
    """
    shares, parts = max(1, -(-vectors.count() // SHARE)), max(1, -(-queries.count() // PART))
    shares = max(shares, 8)
    dealt = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("__v"), dealt(shares).alias("share")).select("*", every(parts).alias("part"))
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("__q"), dealt(parts).alias("part")).select("*", every(shares).alias("share"))
    return ranked(best_of(v, q, ["share", "part"], k), k)


def rerank(hits: DataFrame, score: Column, k: int = 5) -> DataFrame:
    """hits with a new score and rank, the best k of each query; ties keep their old order."""
    h = hits.withColumn("rerank_score", score)
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank"))
    return h.withColumn("new_rank", r).where(F.col("new_rank") <= k)


def centroids(vectors: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by, n, centroid): the mean vector of each group, one partial mean a group and task before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = vectors.select(*by, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    return v.groupBy(*by).agg(F.count("*").alias("n"), Summarizer.mean(F.col("v")).alias("m")).select(*by, "n", vector_to_array("m").alias("centroid"))


def nearest_centroid(vectors: DataFrame, cents: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """(key, cluster, score): the closest centroid, ties to the smaller label; null without centroids.

    metric: cosine, dot, or euclidean with score 1 / (1 + distance). Centroids are few, one for each cluster, so all of them come to
    each row as one array, and nothing is shuffled.
    """
    of = {"cosine": cosine, "dot": dot, "euclidean": lambda v, w: 1 / (1 + euclidean(v, w))}[metric]
    all_ = cents.agg(F.collect_list(F.struct(F.col(label).alias("cluster"), F.col("centroid").alias("c"))).alias("__all"))
    scored = F.transform("__all", lambda c: F.struct(F.round(of(F.col(vector), c["c"]), 9).alias("score"), (-c["cluster"]).alias("neg")))
    best = vectors.crossJoin(F.broadcast(all_)).select(key, F.array_max(scored).alias("b"))
    return best.select(key, (-F.col("b.neg")).alias("cluster"), F.col("b.score").alias("score"))


def outliers(vectors: DataFrame, by: list[str], key: str = "vec_id", vector: str = "embedding", k: float = OUTLIER_STD) -> DataFrame:
    """(key, by, distance, is_outlier): farther from the group's centroid than mean + k population deviations."""
    d = vectors.join(bounded(centroids(vectors, by, vector).drop("n")), by).select(key, *by, euclidean(F.col(vector), F.col("centroid")).alias("distance"))
    limit = d.groupBy(*by).agg((F.avg("distance") + k * F.stddev_pop("distance")).alias("__limit"))  # partial sums before the shuffle: a large group fills no task
    return d.join(bounded(limit), by).select(key, *by, "distance", (F.col("distance") > F.col("__limit")).alias("is_outlier"))


def reassign(outlying: DataFrame, skipped: DataFrame, cents: DataFrame, key: str = "vec_id", firm: float = FIRM, metric: str = "dot") -> DataFrame:
    """(key, origin, cluster, score, tentative) of outliers, then skipped ones; a score under `firm` is tentative.

    Without centroids each candidate is a cluster of its own, numbered from 0 in that order, with score 0.
    """
    both = outlying.select(key, "embedding", F.lit("outlier").alias("origin")).unionByName(skipped.select(key, "embedding", F.lit("skipped").alias("origin")))
    if not cents.limit(1).count():
        number = F.row_number().over(Window.orderBy("origin", key)) - 1  # candidates of one meeting
        return both.select(key, "origin", number.cast(cents.schema["label"].dataType).alias("cluster"), F.lit(0.0).alias("score"), F.lit(True).alias("tentative"))
    got = nearest_centroid(both.select("*", F.struct("origin", key).alias("__k")), cents, "__k", metric=metric)
    return got.select(F.col(f"__k.{key}").alias(key), "__k.origin", "cluster", "score", (F.col("score") < firm).alias("tentative"))


def contingency(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("gt"), F.col(pred).alias("sys")).agg(F.count("*").alias("n"))


def agreement(table: DataFrame) -> DataFrame:
    """(n, ari, nmi) from a contingency table (gt, sys, n); NMI with the arithmetic mean of entropies."""
    pairs = lambda c: c * (c - 1) / 2
    rows, cols = table.groupBy("gt").agg(F.sum("n").alias("a")), table.groupBy("sys").agg(F.sum("n").alias("b"))
    total = table.agg(F.sum("n").alias("t"), F.sum(pairs(F.col("n"))).alias("p"))
    a = rows.crossJoin(F.broadcast(total)).agg(F.sum(pairs(F.col("a"))).alias("pa"), -F.sum(F.col("a") / F.col("t") * F.log(F.col("a") / F.col("t"))).alias("ha"))
    b = cols.crossJoin(F.broadcast(total)).agg(F.sum(pairs(F.col("b"))).alias("pb"), -F.sum(F.col("b") / F.col("t") * F.log(F.col("b") / F.col("t"))).alias("hb"))
    mi = table.join(rows, "gt").join(cols, "sys").crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    one = total.crossJoin(a.toDF("pa", "ha")).crossJoin(b.toDF("pb", "hb")).crossJoin(mi)
    expected = F.col("pa") * F.col("pb") / pairs(F.col("t"))
    top, mean = (F.col("pa") + F.col("pb")) / 2 - expected, (F.col("ha") + F.col("hb")) / 2
    return one.select(
        F.col("t").alias("n"), F.round(F.when(top != 0, (F.col("p") - expected) / top).otherwise(1.0), 6).alias("ari"), F.round(F.when(mean > 0, F.col("mi") / mean).otherwise(1.0), 6).alias("nmi")
    )


def silhouette(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, n, silhouette): mean silhouette with cosine distance, by the exact pairwise definition.

    A vector's summed distance to a cluster is its size minus the dot product with the sum of the cluster's unit
    vectors, so no pairs are made: each vector meets the array of clusters in its own row.
    """
    unit = vectors.select(key, label, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    unit = unit.select(key, label, F.transform("v", lambda x: x / F.sqrt(dot(F.col("v"), F.col("v")))).alias("v"))
    c = centroids(unit, [label], "v").agg(F.collect_list(F.struct(F.col(label).alias("other"), F.col("n").alias("size"), F.col("centroid").alias("mean"))).alias("__all"))
    d = F.transform("__all", lambda x: F.struct(x["other"].alias("other"), x["size"].alias("size"), (x["size"] - x["size"] * dot(F.col("v"), x["mean"])).alias("d")))
    each = unit.crossJoin(F.broadcast(c)).select(label, d.alias("d"))
    own = F.element_at(F.filter("d", lambda x: x["other"] == F.col(label)), 1)
    near = F.array_min(F.transform(F.filter("d", lambda x: x["other"] != F.col(label)), lambda x: x["d"] / x["size"]))
    each = each.select(label, own.alias("o"), near.alias("b"))
    a = F.when(F.col("o.size") > 1, F.col("o.d") / (F.col("o.size") - 1))
    value = F.when(a.isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - a) / F.greatest("b", a))
    return each.groupBy(label).agg(F.count("*").alias("n"), F.avg(value).alias("silhouette"))


def davies_bouldin(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, n, spread, worst): mean distance to the centroid, and the largest (spread + other spread) / distance of centroids.

    The index is the mean of `worst`; a single cluster has 0. Clusters meet as one array, vectors only their own centroid.
    """
    c = centroids(vectors, [label], vector)
    d = vectors.join(F.broadcast(c), label).select(label, "n", "centroid", euclidean(F.col(vector), F.col("centroid")).alias("d"))
    spread = d.groupBy(label).agg(F.first("n").alias("n"), F.first("centroid").alias("centroid"), F.avg("d").alias("spread"))
    all_ = spread.agg(F.collect_list(F.struct(F.col(label).alias("other"), F.col("centroid").alias("c"), F.col("spread").alias("s"))).alias("__all"))
    worst = F.array_max(F.transform(F.filter("__all", lambda x: x["other"] != F.col(label)), lambda x: (F.col("spread") + x["s"]) / euclidean(F.col("centroid"), x["c"])))
    return spread.crossJoin(F.broadcast(all_)).select(label, "n", "spread", F.coalesce(worst, F.lit(0.0)).alias("worst"))


def confidence_histogram(scored: DataFrame, score: str = "score", bins: int = 10) -> DataFrame:
    """(bin, n): scores from 0 to 1, the last bin closed on the right."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    return scored.where(F.col(score).between(0, 1)).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def pivots(vectors: DataFrame, by: str, key: str = "vec_id", k: int = 3) -> DataFrame:
    """The k rows of each group that are first by md5 of the key."""
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.col(key).cast("string"))))
    return vectors.withColumn("pivot_rank", r).where(F.col("pivot_rank") <= k)


# Clustering of one group's vectors; a group fits in memory (a meeting's segments). -----------------------------------


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def _kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 50) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d = np.min([((x - c) ** 2).sum(1) for c in centre], axis=0)
        centre.append(x[int(np.argmax(d))])
    c = np.array(centre)
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[new == j].mean(0) if (new == j).any() else c[j] for j in range(k)])
        if (new == label).all():
            break
        label = new
    return label


def _laplacian(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors of the normalised Laplacian of a graph."""
    d = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
    return np.linalg.eigh(np.eye(len(a)) - d[:, None] * a * d[None])


def number_of_clusters(x: np.ndarray, least: int = 3, most: int = 10) -> int:
    """After how many eigenvalues of the cosine graph's Laplacian the largest gap is."""
    sim = np.clip(_unit(x) @ _unit(x).T, 0, None)
    gaps = np.diff(_laplacian(sim)[0])[least - 1 : max(least, min(most, len(x) - 1)) - 1]
    return int(np.argmax(gaps)) + least if len(gaps) else least


def spectral(x: np.ndarray, least: int = 3, most: int = 10, neighbours: int = 10) -> np.ndarray:
    """Labels from the eigen-gap of the cosine graph's Laplacian and k-means on the kNN graph's eigenvectors."""
    n = len(x)
    if n <= least:
        return np.arange(n)
    sim = np.clip(_unit(x) @ _unit(x).T, 0, None)
    k = number_of_clusters(x, least, most)
    near = np.zeros_like(sim)
    top = np.argsort(-sim, axis=1, kind="stable")[:, : min(neighbours + 1, n)]
    np.put_along_axis(near, top, 1.0, 1)
    return _kmeans(_unit(_laplacian((near + near.T) / 2)[1][:, :k]), k)


def agglomerative(x: np.ndarray, least: int = 2, most: int = 20) -> np.ndarray:
    """Average linkage on cosine distance, cut where the silhouette (where it is undefined: minus Davies-Bouldin) is largest.

    The mean distance of two clusters is one minus the product of their sums of unit vectors over both sizes, so sums are
    all that is kept: memory is linear. Chains of nearest neighbours end in pairs that are each other's nearest, which
    average linkage joins at some time anyway; sorted by distance, these are the merges of the dendrogram.
    """
    n = len(x)
    if n <= least:
        return np.arange(n)
    unit = _unit(x)
    parent = np.arange(n)
    best, found = -np.inf, parent
    merges = _merges(unit)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for k, (_, a, b) in zip(range(n - 1, least - 1, -1), merges, strict=False):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
        if k <= most:
            label = np.array([root(i) for i in range(n)])
            if (s := _score(x, unit, label)) > best:
                best, found = s, label
    return np.unique(found, return_inverse=True)[1]


def _merges(unit: np.ndarray) -> list[tuple[float, int, int]]:
    """(distance, member of one cluster, member of the other) of the n - 1 merges of average linkage, nearest first."""
    sums, size, first = unit.copy(), np.ones(len(unit)), np.arange(len(unit))  # of the clusters that are left, as rows
    left, chain, out = np.ones(len(unit), bool), [], []
    while len(out) < len(unit) - 1:
        if left.sum() * 2 < len(left):  # rows of clusters that are gone are given up
            place = np.cumsum(left) - 1
            chain = [int(place[c]) for c in chain]
            sums, size, first, left = sums[left], size[left], first[left], left[left]
        if not chain:
            chain.append(int(np.argmax(left)))
        top = chain[-1]
        d = 1 - (sums @ sums[top]) / (size * size[top])
        d[top], d[~left] = np.inf, np.inf
        near = int(np.argmin(d))
        if len(chain) > 1 and d[chain[-2]] <= d[near]:
            near = chain[-2]
            del chain[-2:]
            out.append((float(d[near]), int(first[near]), int(first[top])))
            i, j = sorted((top, near))
            sums[i], size[i], left[j] = sums[i] + sums[j], size[i] + size[j], False
        else:
            chain.append(near)
    return sorted(out, key=lambda m: m[0])


def _score(x: np.ndarray, unit: np.ndarray, label: np.ndarray) -> float:
    n = len(np.unique(label))
    return _silhouette(unit, label) if 2 <= n < len(label) else -_davies_bouldin(x, label)


def _davies_bouldin(x: np.ndarray, label: np.ndarray) -> float:
    ids, inv = np.unique(label, return_inverse=True)
    if len(ids) < 2:
        return 0.0
    c = np.array([x[inv == i].mean(0) for i in range(len(ids))])
    spread = np.array([np.linalg.norm(x[inv == i] - c[i], axis=1).mean() for i in range(len(ids))])
    apart = np.linalg.norm(c[:, None] - c[None], axis=2)
    np.fill_diagonal(apart, np.inf)
    both = spread[:, None] + spread[None]
    return float(np.where(apart > 0, both / np.where(apart > 0, apart, 1), np.where(both > 0, np.inf, 0)).max(1).mean())


def _silhouette(unit: np.ndarray, label: np.ndarray) -> float:
    """The mean silhouette with cosine distance; distances to a cluster are summed by its sum of unit vectors."""
    ids, inv = np.unique(label, return_inverse=True)
    if len(ids) < 2:
        return -1.0
    n = np.bincount(inv).astype(float)
    total = np.zeros((len(ids), unit.shape[1]))
    np.add.at(total, inv, unit)
    sums, at = n - unit @ total.T, np.arange(len(inv))
    own = (sums[at, inv] - (1 - (unit * unit).sum(1))) / np.maximum(n[inv] - 1, 1)
    mean = sums / n
    mean[at, inv] = np.inf
    near = mean.min(1)
    return float(np.where(n[inv] > 1, (near - own) / np.maximum(np.maximum(near, own), 1e-12), 0).mean())


def cluster_groups(vectors: DataFrame, by: str, key: str = "vec_id", method: str = "spectral") -> DataFrame:
    """(by, key, cluster): labels from 0 in order of the smallest key, found within each group.

    Up to MOST_ROWS vectors of a group are clustered in one task. Spectral labels of a larger group come from its sparse
    neighbour graph, step by step in Spark (`operators.spectra`); agglomeration needs memory in proportion to the group and
    time in proportion to its square, and more than MOST_MERGED rows are an error: split them first.
    """
    most = MOST_ROWS if method == "spectral" else MOST_MERGED
    fit = {"spectral": spectral, "agglomerative": agglomerative}[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError(f"{len(pdf)} rows in group {pdf[by].iloc[0]}: at most {most} can be clustered at once")
        pdf = pdf.sort_values(key)
        label = fit(np.array(pdf["embedding"].tolist(), float))
        order = {c: i for i, c in enumerate(dict.fromkeys(label.tolist()))}
        return pd.DataFrame({by: pdf[by], key: pdf[key], "cluster": [order[c] for c in label.tolist()]})

    kinds = [vectors.schema[c].dataType.simpleString() for c in (by, key)]
    schema = f"{by} {kinds[0]}, {key} {kinds[1]}, cluster int"
    rows, large = vectors.select(by, key, "embedding"), []
    if method == "spectral":
        large = [r[0] for r in rows.groupBy(by).count().where(F.col("count") > most).select(by).collect()]  # each is a run of its own
    small = rows.where(~F.col(by).eqNullSafe(F.lit(large[0]))) if len(large) == 1 else rows.where(F.col(by).isNull() | ~F.col(by).isin(large)) if large else rows
    out = small.groupBy(by).applyInPandas(run, schema)
    for g in large:
        from convoq.operators.spectra import spectral_labels

        own = rows.where(F.col(by).eqNullSafe(F.lit(g)))
        out = out.unionByName(spectral_labels(own, key=key).select(F.lit(g).cast(kinds[0]).alias(by), F.col(key).cast(kinds[1]), "cluster"))
    return out


def pca_kmeans(vectors: DataFrame, k: int = 10, dims: int = 10, key: str = "vec_id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """(key, cluster): k-means with cosine distance on principal components, both distributed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = vectors.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    low = PCA(k=dims, inputCol="v", outputCol="low").fit(v).transform(v)
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="low", predictionCol="cluster").fit(low)
    return model.transform(low).select(key, "cluster")


def scatter(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(key, label, x, y): the data of a scatter plot, the first two principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select(key, label, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    low = PCA(k=2, inputCol="v", outputCol="low").fit(v).transform(v).select(key, label, vector_to_array("low").alias("p"))
    return low.select(key, label, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def refine_clusters(subs: DataFrame, by: str = "meeting_id", speaker: str = "speaker", key: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Sub-segments (by, speaker, key, embedding) of labelled clusters, clustered once more within each.

    Returns (by, speaker, key, sub_cluster, distance, is_outlier): a sub-cluster's members farther from its mean than mean
    + 1.5 population deviations are outliers, the others refined segments; and (by, n_true, n_pred, n, matched,
    accuracy): all of a meeting clustered at once, compared with the speakers by the best one-to-one matching.
    """
    inner = subs.select("*", F.concat_ws("\x1f", F.col(by).cast("string"), speaker).alias("__cluster"))
    found = cluster_groups(inner, "__cluster", key).withColumnRenamed("cluster", "sub_cluster")
    rows = inner.join(found, ["__cluster", key])
    spread = outliers(rows, ["__cluster", "sub_cluster"], key)
    refined = rows.join(spread, ["__cluster", "sub_cluster", key]).select(by, speaker, key, "sub_cluster", "distance", "is_outlier")
    whole = cluster_groups(subs, by, key).select(by, key, F.concat(F.lit("c"), F.col("cluster")).alias("sys"))
    pairs = subs.select(by, key, F.col(speaker).cast("string").alias("gt")).join(whole, [by, key])
    return refined, matched(pairs, by)


def matched(pairs: DataFrame, by: str = "meeting_id") -> DataFrame:
    """(by, n_true, n_pred, n, matched, accuracy) of rows (by, gt, sys): the share that the best one-to-one matching of labels joins."""
    from convoq.operators.diarization import assignment

    counts = pairs.groupBy(by, "gt", "sys").agg(F.count("*").alias("frames"))
    heard = counts.select(by, F.lit("gt").alias("side"), F.col("gt").alias("speaker")).union(counts.select(by, F.lit("sys"), "sys")).distinct()
    m = counts.join(assignment(counts, heard, by), [by, "gt", "sys"]).groupBy(by).agg(F.sum("frames").alias("m"))
    n = counts.groupBy(by).agg(F.countDistinct("gt").alias("n_true"), F.countDistinct("sys").alias("n_pred"), F.sum("frames").alias("n"))
    hit = F.coalesce("m", F.lit(0).cast("long"))
    return n.join(m, by, "left").select(by, "n_true", "n_pred", "n", hit.alias("matched"), F.round(hit / F.col("n"), 6).alias("accuracy"))


def merge_stages(segments: DataFrame, partition: str = "meeting_id", slack: float = 0.05) -> DataFrame:
    """Segments of several stages (start_ms, end_ms, priority) without overlaps, by start and higher priority first.

    Each is left out if an accepted one covers it (within slack). Else it is trimmed: its end to the start of an accepted
    one that begins inside it, its start to the end of one that ends inside it. All comparisons are with the segment as it
    came, and of several that trim the same side the one accepted last counts.

    The order of acceptance is the meaning of the operator, so it is a fold; but segments meet only within a cluster of
    them that overlap (or are at most slack apart), so each cluster is folded by itself.
    """
    many = crowded(segments, partition)
    s = scan(segments, partition, ["start_ms", "end_ms", "seq"], most={"__until": F.col("end_ms")}, binned=many)
    s = numbered(s, F.col("__until").isNull() | (F.col("start_ms") > F.col("__until") + slack), partition, ["start_ms", "end_ms", "seq"], "__cluster", binned=many)
    taken = "array<struct<a bigint, b bigint, seq bigint, speaker string, priority int>>"

    def accept(done: Column, x: Column) -> Column:
        meets = F.filter(done, lambda m: (x["e"] > m["a"]) & (x["s"] < m["b"]))
        end = F.try_element_at(F.transform(F.filter(meets, lambda m: x["s"] < m["a"]), lambda m: m["a"]), F.lit(-1))
        begin = F.try_element_at(F.transform(F.filter(meets, lambda m: (x["s"] >= m["a"]) & (x["e"] > m["b"])), lambda m: m["b"]), F.lit(-1))
        covered = F.exists(done, lambda m: (x["s"] >= m["a"] - slack) & (x["e"] <= m["b"] + slack))
        a, b = F.coalesce(begin, x["s"]), F.coalesce(end, x["e"])
        new = F.struct(a.alias("a"), b.alias("b"), x["seq"].alias("seq"), x["speaker"].alias("speaker"), x["priority"].alias("priority"))
        return F.when(covered | (b <= a), done).otherwise(F.array_append(done, new)).cast(taken)

    row = F.struct(F.col("start_ms").cast("long").alias("s"), (-F.col("priority")).alias("p"), F.col("seq").cast("long").alias("seq"), F.col("end_ms").cast("long").alias("e"), F.col("speaker").cast("string").alias("speaker"), F.col("priority").cast("int").alias("priority"))
    folded = F.aggregate(F.array_sort(F.collect_list(row)), F.array().cast(taken), accept)
    out = s.groupBy(partition, "__cluster").agg(folded.alias("r")).select(partition, F.explode("r").alias("r"))
    return out.select(partition, "r.seq", "r.speaker", "r.priority", F.col("r.a").alias("start_ms"), F.col("r.b").alias("end_ms"))
