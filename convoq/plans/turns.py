"""Queries over turns and words: runs, gaps, windows, sentences, folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from convoq import adapters as A
from convoq.functions.text import has_tokens
from convoq.operators import sequence as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("WITH " + A.UTTERANCES + "," + A.RUNS + " SELECT meeting_id, run_idx, speaker, start_ms, end_ms, n_utts, text FROM runs")
def turn_merge_filtered(spark, d):
    u = A.utterances(spark, d)
    return S.merge_runs(u.where(has_tokens(F.col("text"), 3)), "meeting_id", "utt_idx", "speaker")


@query("WITH " + A.UTTERANCES + "," + A.RUNS.replace(" WHERE n_tok >= 3", "") + " SELECT meeting_id, run_idx, speaker, start_ms, end_ms, n_utts, text FROM runs")
def turn_merge(spark, d):
    return S.merge_runs(A.utterances(spark, d), "meeting_id", "utt_idx", "speaker")


@query("WITH " + A.UTTERANCES + "," + A.RUNS + """ SELECT meeting_id, speaker, rank() OVER (PARTITION BY meeting_id ORDER BY min(run_idx)) AS speaker_rank, count(*) AS n_runs,
  string_agg(text, ' ' ORDER BY run_idx) AS text FROM runs GROUP BY meeting_id, speaker""")
def speaker_groups(spark, d):
    u = A.utterances(spark, d).where(has_tokens(F.col("text"), 3))
    runs = S.merge_runs(u, "meeting_id", "utt_idx", "speaker")
    g = runs.groupBy("meeting_id", "speaker").agg(F.min("run_idx").alias("first"), F.count("*").alias("n_runs"), S.joined(F.col("text"), "run_idx").alias("text"))
    return g.select("meeting_id", "speaker", F.rank().over(Window.partitionBy("meeting_id").orderBy("first")).cast("long").alias("speaker_rank"), "n_runs", "text")


@query("WITH " + A.UTTERANCES + """ SELECT meeting_id, speaker, count(*) AS turns, CAST(sum(n_tok) AS BIGINT) AS tokens, CAST(sum(end_ms - start_ms) AS BIGINT) AS talk_ms FROM utterances GROUP BY ALL""")
def speaker_talk_time(spark, d):
    return A.utterances(spark, d).groupBy("meeting_id", "speaker").agg(F.count("*").alias("turns"), F.sum("n_tok").alias("tokens"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms"))


@query("WITH " + A.UTTERANCES + """, t AS (SELECT meeting_id, speaker, sum(n_tok) AS n FROM utterances GROUP BY meeting_id, speaker)
  SELECT meeting_id, speaker, CAST(sum(n) AS BIGINT) AS tokens FROM t GROUP BY ROLLUP (meeting_id, speaker)""")
def talk_rollup(spark, d):
    """Extension: totals by speaker, meeting and corpus in one pass."""
    return A.utterances(spark, d).rollup("meeting_id", "speaker").agg(F.sum("n_tok").alias("tokens"))


@query("WITH " + A.GT_WORDS + """, a AS (SELECT *, lag(speaker) OVER w AS ps, lag(end_ms) OVER w AS pe FROM gt_words WINDOW w AS (PARTITION BY meeting_id ORDER BY start_ms, word_idx)),
  b AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> speaker OR start_ms - pe > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY start_ms, word_idx) - 1 AS seg_idx FROM a)
  SELECT meeting_id, CAST(seg_idx AS BIGINT) AS seg_idx, any_value(speaker) AS speaker, min(start_ms) AS start_ms, arg_max(end_ms, word_idx) AS end_ms, count(*) AS n_words, string_agg(word, ' ' ORDER BY word_idx) AS text
  FROM b GROUP BY meeting_id, seg_idx""")
def gap_segments(spark, d):
    return S.gap_segments(A.gt_words(spark, d), "meeting_id")


_CHUNKS = """, c0 AS (SELECT *, lag(end_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms, utt_idx) AS pe FROM utterances),
  c1 AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_ms - pe >= 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY start_ms, utt_idx) - 1 AS chunk_idx FROM c0),
  chunks AS (SELECT meeting_id, CAST(chunk_idx AS BIGINT) AS chunk_idx, min(start_ms) AS start_ms, arg_max(end_ms, utt_idx) AS end_ms, count(*) AS n_segments FROM c1 GROUP BY meeting_id, chunk_idx)"""
_WINDOWS = "CAST(CASE WHEN end_ms - start_ms > 60000 THEN ceil((end_ms - start_ms - 60000) / 58000.0) ELSE 0 END AS BIGINT) + 1"


@query("WITH " + A.UTTERANCES + _CHUNKS + " SELECT * FROM chunks")
def silence_chunks(spark, d):
    return S.silence_chunks(A.utterances(spark, d), "meeting_id", "utt_idx")


@query("WITH " + A.UTTERANCES + _CHUNKS + f""", v AS (SELECT *, unnest(range(0, {_WINDOWS})) AS win_idx FROM chunks),
  w AS (SELECT meeting_id, chunk_idx, win_idx, start_ms + 58000 * win_idx AS win_start, least(start_ms + 58000 * win_idx + 60000, end_ms) AS win_end FROM v)
  SELECT w.meeting_id, chunk_idx, win_idx, win_start, win_end, count(u.utt_idx) AS n_segments FROM w LEFT JOIN utterances u ON u.meeting_id = w.meeting_id AND u.end_ms > win_start AND u.start_ms < win_end GROUP BY ALL""")
def overlap_subwindows(spark, d):
    from convoq.operators.intervals import overlap_join

    u = A.utterances(spark, d)
    w = S.time_windows(S.silence_chunks(u, "meeting_id", "utt_idx")).select("meeting_id", "chunk_idx", "win_idx", F.col("win_start").alias("start_ms"), F.col("win_end").alias("end_ms"))
    n = overlap_join(w, u.select("meeting_id", "utt_idx", "start_ms", "end_ms")).groupBy("meeting_id", F.col("a_chunk_idx").alias("chunk_idx"), F.col("a_win_idx").alias("win_idx")).agg(F.count("*").alias("n"))
    j = w.join(n, ["meeting_id", "chunk_idx", "win_idx"], "left")
    return j.select("meeting_id", "chunk_idx", "win_idx", F.col("start_ms").alias("win_start"), F.col("end_ms").alias("win_end"), F.coalesce("n", F.lit(0)).cast("long").alias("n_segments"))


@query("WITH " + A.UTTERANCES + f""", m AS (SELECT meeting_id, 0 AS start_ms, max(end_ms) AS end_ms FROM utterances GROUP BY meeting_id), v AS (SELECT *, unnest(range(0, {_WINDOWS})) AS win_idx FROM m)
  SELECT meeting_id, win_idx, 58000 * win_idx AS win_start, least(58000 * win_idx + 60000, end_ms) AS win_end FROM v""")
def fixed_chunks(spark, d):
    m = A.utterances(spark, d).groupBy("meeting_id").agg(F.lit(0).cast("long").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return S.time_windows(m).select("meeting_id", "win_idx", "win_start", "win_end")


_WORD_WINDOWS = r""", x AS (SELECT meeting_id, utt_idx, regexp_extract_all(text, '\S+') AS t FROM utterances),
  y AS (SELECT *, unnest(CASE WHEN len(t) <= 18 THEN [0] ELSE range(0, len(t), 12) END) AS pos FROM x)"""


@query("WITH " + A.UTTERANCES + _WORD_WINDOWS + " SELECT meeting_id, utt_idx, CAST(pos // 12 AS BIGINT) AS win_idx, CAST(len(t[pos + 1:pos + 18]) AS BIGINT) AS n_words, array_to_string(t[pos + 1:pos + 18], ' ') AS text FROM y")
def word_windows(spark, d):
    w = S.word_windows(A.utterances(spark, d), A.tokens("text"))
    return w.select("meeting_id", "utt_idx", "win_idx", F.size("window").cast("long").alias("n_words"), F.array_join("window", " ").alias("text"))


@query("WITH " + A.SEGMENTS_GT + """, p AS (SELECT *, (end_ms - start_ms - 300) // 100 + 1 AS n FROM segments_gt WHERE end_ms - start_ms >= 300),
  q AS (SELECT *, CASE WHEN n > 20 THEN n // 20 ELSE 1 END AS step, unnest(range(0, n)) AS k FROM p)
  SELECT meeting_id, seq, k // step AS sub_idx, start_ms + 100 * k AS sub_start, start_ms + 100 * k + 300 AS sub_end FROM q WHERE k % step = 0""")
def sub_segments(spark, d):
    return S.sub_segments(A.segments_gt(spark, d)).select("meeting_id", "seq", "sub_idx", "sub_start", "sub_end")


_UNION = """, i0 AS (SELECT *, max(end_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM segments_gt WHERE end_ms > start_ms AND end_ms - start_ms >= 200),
  i1 AS (SELECT *, sum(CASE WHEN before IS NULL OR start_ms > before THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) - 1 AS union_idx FROM i0)
  SELECT meeting_id, CAST(union_idx AS BIGINT) AS union_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_parts FROM i1 GROUP BY meeting_id, union_idx"""


@query("WITH " + A.SEGMENTS_GT + _UNION)
def interval_union(spark, d):
    return S.interval_union(A.segments_gt(spark, d), "meeting_id", least=200)


SPAN_MERGE = """, m0 AS (SELECT *, max(e_idx) OVER (PARTITION BY meeting_id, topic_id, speaker ORDER BY s_idx, e_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM topic_spans WHERE e_idx >= s_idx),
  m1 AS (SELECT *, sum(CASE WHEN before IS NULL OR s_idx > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id, topic_id, speaker ORDER BY s_idx, e_idx ROWS UNBOUNDED PRECEDING) - 1 AS union_idx FROM m0),
  merged AS (SELECT meeting_id, topic_id, speaker, CAST(union_idx AS BIGINT) AS union_idx, min(s_idx) AS s_idx, max(e_idx) AS e_idx, count(*) AS n_parts FROM m1 GROUP BY ALL)"""


@query("WITH " + A.GT_WORDS + "," + A.TOPIC_SPANS + SPAN_MERGE + " SELECT * FROM merged")
def word_span_merge(spark, d):
    return S.interval_union(A.topic_spans(spark, d), ["meeting_id", "topic_id", "speaker"], "s_idx", "e_idx", slack=1)


def _topics_sql(most: int) -> str:
    return "WITH " + A.UTTERANCES + f""", g AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms, utt_idx) AS gap FROM utterances),
  t AS (SELECT *, least(sum(CASE WHEN gap * {most} > 90000 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY start_ms, utt_idx), {most - 1}) AS topic_idx FROM g)
  SELECT meeting_id, CAST(topic_idx AS BIGINT) AS topic_idx, count(*) AS n_utts, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM t GROUP BY ALL"""


def _topics(spark, d, most):
    t = S.topic_groups(A.utterances(spark, d), "meeting_id", "utt_idx", most)
    return t.groupBy("meeting_id", "topic_idx").agg(F.count("*").alias("n_utts"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query(_topics_sql(4))
def topic_gap_groups(spark, d):
    return _topics(spark, d, 4)


@query(_topics_sql(2))
def topic_gap_groups_two(spark, d):
    return _topics(spark, d, 2)


SENTENCES = """, z0 AS (SELECT *, lag(regexp_matches(word, '[.!?]$')) OVER (PARTITION BY meeting_id ORDER BY word_idx) AS ended FROM gt_words),
  z1 AS (SELECT *, sum(CASE WHEN coalesce(ended, true) THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY word_idx) - 1 AS sent_idx FROM z0),
  sents AS (SELECT meeting_id, CAST(sent_idx AS BIGINT) AS sent_idx, arg_min(start_ms, word_idx) AS start_ms, arg_max(end_ms, word_idx) AS end_ms, count(*) AS n_words, string_agg(word, ' ' ORDER BY word_idx) AS text FROM z1 GROUP BY meeting_id, sent_idx)"""


@query("WITH " + A.GT_WORDS + SENTENCES + " SELECT * FROM sents")
def sentence_assembly(spark, d):
    return S.assemble_sentences(A.gt_words(spark, d), "meeting_id")


@query("WITH " + A.UTTERANCES + """, n AS (SELECT meeting_id, utt_idx, count(*) OVER (PARTITION BY meeting_id) AS n, row_number() OVER (PARTITION BY meeting_id ORDER BY utt_idx) - 1 AS r FROM utterances)
  SELECT meeting_id, utt_idx, r // greatest(1, n // 4) AS chunk_idx FROM n WHERE r // greatest(1, n // 4) < 4""")
def bounded_chunks(spark, d):
    return S.bounded_chunks(A.utterances(spark, d), "meeting_id", "utt_idx").select("meeting_id", "utt_idx", "chunk_idx")


@query("WITH " + A.SEGMENTS_GT + """, b AS (SELECT *, (row_number() OVER (PARTITION BY meeting_id ORDER BY seq) - 1) // 10 AS batch_idx FROM segments_gt)
  SELECT meeting_id, batch_idx, count(*) AS n, min(start_ms) AS start_ms, CAST(sum(end_ms - start_ms) AS BIGINT) AS dur_ms FROM b GROUP BY ALL""")
def batch10(spark, d):
    b = S.batches(A.segments_gt(spark, d), "meeting_id", "seq")
    return b.groupBy("meeting_id", "batch_idx").agg(F.count("*").alias("n"), F.min("start_ms").alias("start_ms"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("dur_ms"))


@query("""SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, ' | ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations""")
def last3_history(spark, d):
    c = A.table(spark, d, "conversations")
    last = F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t"))).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1))
    return c.select("conv_id", "turn", F.array_join(F.transform(F.array_sort(last), lambda s: s["t"]), " | ").alias("history"))


@query("WITH RECURSIVE " + A.SEGMENTS + """,
  o AS (SELECT meeting_id, speaker, start_ms, end_ms, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, seq) AS k FROM segments_sys),
  f AS (SELECT meeting_id, k, speaker, start_ms AS gs, end_ms AS ge, 0 AS g FROM o WHERE k = 1
    UNION ALL SELECT o.meeting_id, o.k, o.speaker, CASE WHEN o.speaker = f.speaker AND o.start_ms - f.ge <= 800 AND o.end_ms - f.gs <= 30000 THEN f.gs ELSE o.start_ms END, o.end_ms,
      CASE WHEN o.speaker = f.speaker AND o.start_ms - f.ge <= 800 AND o.end_ms - f.gs <= 30000 THEN f.g ELSE f.g + 1 END FROM f JOIN o ON o.meeting_id = f.meeting_id AND o.k = f.k + 1)
  SELECT meeting_id, CAST(g AS BIGINT) AS group_idx, any_value(speaker) AS speaker, min(gs) AS start_ms, arg_max(ge, k) AS end_ms, count(*) AS n_parts FROM f GROUP BY meeting_id, g""")
def capped_group_merge(spark, d):
    return S.capped_groups(A.segments_sys(spark, d), "meeting_id", "seq")


@query("WITH RECURSIVE " + A.UTTERANCES + _WORD_WINDOWS + """,
  s AS (SELECT meeting_id, utt_idx, pos // 12 AS k, t[pos + 1:pos + 18] AS w FROM y),
  f AS (SELECT meeting_id, utt_idx, k, w AS acc FROM s WHERE k = 0
    UNION ALL SELECT s.meeting_id, s.utt_idx, s.k, list_concat(f.acc, s.w[1 + len(list_filter(range(1, 7), lambda n: n <= least(len(f.acc), 6) AND n <= len(s.w) AND (f.acc[greatest(1, len(f.acc) - 5):])[1:n] = s.w[1:n])):])
      FROM f JOIN s ON s.meeting_id = f.meeting_id AND s.utt_idx = f.utt_idx AND s.k = f.k + 1)
  SELECT meeting_id, utt_idx, CAST(len(arg_max(acc, k)) AS BIGINT) AS n_words, array_to_string(arg_max(acc, k), ' ') AS text FROM f GROUP BY meeting_id, utt_idx""")
def merge_overlap_spans(spark, d):
    w = S.word_windows(A.utterances(spark, d), A.tokens("text"))
    g = w.groupBy("meeting_id", "utt_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("win_idx", "window"))), lambda s: s["window"]).alias("spans"))
    m = g.select("meeting_id", "utt_idx", S.merge_overlapping(F.col("spans")).alias("m"))
    return m.select("meeting_id", "utt_idx", F.size("m").cast("long").alias("n_words"), F.array_join("m", " ").alias("text"))


@query("""SELECT conv_id, role, 'SPEAKER_' || lpad(CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS VARCHAR), 2, '0') AS label, count(*) AS n FROM conversations GROUP BY conv_id, role""")
def appearance_labels(spark, d):
    c = S.appearance_labels(A.table(spark, d, "conversations"), "conv_id", "turn", "role")
    return c.groupBy("conv_id", "role", "label").agg(F.count("*").alias("n"))
