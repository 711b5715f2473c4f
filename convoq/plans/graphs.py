"""Queries over neighbour graphs: layout, sparse spectra, search by small-world graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoq import adapters as A
from convoq.operators import graphs as G
from convoq.operators import small_world as W
from convoq.operators import spectra
from convoq.operators import vectors as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _vectors(spark, d):
    return A.table(spark, d, "embeddings")


@query
def umap_kmeans_labels(spark, d):
    """Clusters of the vectors' layout in ten dimensions, as many as there are labels, named by first appearance."""
    return G.layout_kmeans(_vectors(spark, d), 10)


@query
def umap_positions(spark, d):
    """The layout in two dimensions: the data of a scatter plot."""
    at = G.layout(_vectors(spark, d), 2)
    return at.select(F.col("id").alias("vec_id"), F.col("at")[0].alias("x"), F.col("at")[1].alias("y"))


@query
def spectral_sparse_labels(spark, d):
    """All vectors as one group, by the sparse neighbour graph."""
    return spectra.spectral_labels(_vectors(spark, d))


def _asked(v):
    return v.where("vec_id % 50 = 0")


@query
def graph_search(spark, d):
    """The 30 nearest vectors of every fiftieth, by an index that was built from half of the vectors and then extended by the rest."""
    v = _vectors(spark, d)
    index = W.extend(W.build(v.where("vec_id % 2 = 0")), v.where("vec_id % 2 <> 0"))
    return W.search(_asked(v), index, 30, ef=60).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


@query
def graph_recall(spark, d):
    """How much of the exact neighbours the graphs find, and the share of all distances that they compute."""
    v = _vectors(spark, d)
    found = W.search(_asked(v), W.build(v), 30, ef=60)
    exact = V.knn(_asked(v), v, 30).select("query_id", "vec_id")
    hit = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
    cost = found.groupBy("query_id").agg(F.first("distances").alias("distances")).agg(F.count("*").alias("n_queries"), F.sum("distances").alias("distances"))
    n = v.agg(F.count("*").alias("n"))
    return hit.crossJoin(cost).crossJoin(n).select("n_queries", "n_exact", "n_found", F.round(F.col("n_found") / F.col("n_exact"), 6).alias("recall"), F.round(F.col("distances") / (F.col("n_queries") * F.col("n")), 6).alias("share"))
