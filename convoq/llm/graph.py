"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoq.llm.common import dropped, joined_unique, shuffled, written

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the component's smallest node.

    Alternating large-star and small-star rounds: every node hangs its larger neighbours, then
    its smaller ones, on the smallest it knows. The edge count never grows by more than the
    nodes, minima are combined before the shuffle, and each round is a written table. Rows with
    a null end or a = b are ignored; no edges give no rows.
    """
    e = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    for _ in range(MAX_ROUNDS):
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == mark or not now.n:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        mark = now
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # The centre of a star has as many rows as the star has ends.
        large = joined_unique(both.where("v > u"), least, "u", 2 * now.n).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(shuffled(lowest), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lowest.select("a", F.col("m").alias("b")))
            .distinct()
        )
        before, e = e, written(small, "edges")
        dropped(before)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
