"""Joins of tables that grow with the corpus are shuffled, however small their files look."""

from __future__ import annotations

from pyspark.sql import DataFrame

from convoq.llm import graph, simhash


def _plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_do_not_broadcast_probes(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        distinct = spark.createDataFrame([(i * 2654435761,) for i in range(50)], "fp long")
        assert "BroadcastHashJoin" not in _plan(simhash.links(distinct))
        crowded = spark.createDataFrame([(i << 32,) for i in range(50)], "fp long")
        found = simhash.links(crowded, dense=8)
        assert "BroadcastHashJoin" not in _plan(found)
        roots = {r.node: r.root for r in graph.connected_components(found).collect()}
        assert len(set(roots.values())) == 1 and len(roots) == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
