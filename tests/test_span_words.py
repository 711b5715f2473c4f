"""Words of spans are shuffled: a split text has more rows than Spark's estimate."""

from __future__ import annotations

from convoq.operators import coverage as C


def test_span_words_are_not_broadcast(spark):
    words = spark.createDataFrame([(1, "a", i, f"w{i}") for i in range(12)], "meeting_id long, speaker string, pos long, word string")
    spans = spark.createDataFrame([(1, 0, 0, "a", 0, 2), (1, 0, 1, "a", 10, 11), (1, 0, 2, "a", 11, 12), (1, 0, 3, "a", 5, 3)], "meeting_id long, topic_id long, span_idx long, speaker string, s_idx long, e_idx long")
    found = C.span_text(spans, words, ["meeting_id", "topic_id"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, 0, 2, 5, "w0 w1 w2 w10 w11")]
