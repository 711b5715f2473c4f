"""Summaries and topics whose work follows texts and spans, not tokens and words."""

from __future__ import annotations

from convoq import plugins
from convoq.operators import coverage as C


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_summaries_make_no_row_a_token(spark, monkeypatch):
    rows = [(1, "a", i, t) for i, t in enumerate(["x y", "x z", "", "w", "x y z", None])] + [(1, None, 0, "!"), (2, "a", 3, "b b"), (2, "a", 3, "b b")]
    df = spark.createDataFrame(rows, "m int, who string, i int, text string")
    got = plugins.summaries(df, ["m", "who"], "i")
    assert "Generate" not in plan(got)
    rows = sorted(map(str, got.collect()))
    assert "n=2, summary='x y x z'" in rows[0] or "n=2, summary='x y x z'" in rows[1]
    monkeypatch.setattr(plugins, "GATHERED", 0)
    assert sorted(map(str, plugins.summaries(df.where("who is not null"), ["m", "who"], "i").collect())) == [r for r in rows if "who=None" not in r]
    monkeypatch.setattr(plugins, "GATHERED", 3)
    assert sorted(map(str, plugins.summaries(df, ["m", "who"], "i").collect())) == rows


def test_topics_share_words_without_a_row_a_word(spark):
    spans = [(1, "t", 0, "a", 0, 10**9), (1, "u", 1, "a", 5, 9), (1, "v", 2, "a", 9, 9), (1, "u", 3, "b", 0, 4), (1, "u", 4, "b", 5, 6), (2, "t", 0, "a", 3, 2)]
    df = spark.createDataFrame(spans, "meeting_id long, topic_id string, span_idx long, speaker string, s_idx long, e_idx long")
    got = sorted(tuple(r) for r in C.topic_distinctness(df).collect())
    assert got == [(1, "t", 10**9 + 1, 10**9 - 4, 5), (1, "u", 12, 7, 5), (1, "v", 1, 0, 1)]


def test_words_files_are_spread_over_a_shuffles_tasks(spark):
    from convoq.plans.texts import words_files

    assert "REPARTITION_BY_NUM" in words_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
