"""Queries that bring words, sentences, chunks and segments together in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoq import adapters as A
from convoq.operators import coverage as C
from convoq.operators import intervals as I
from convoq.operators import sequence as S
from convoq.plans.turns import _CHUNKS, SENTENCES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_ASR = A.GT_WORDS + "," + A.ASR_SEGMENTS


@query("WITH " + _ASR + """ SELECT w.meeting_id, w.word_idx, s.seq, CASE WHEN w.start_ms <= s.end_ms THEN s.speaker END AS speaker
  FROM gt_words w ASOF LEFT JOIN asr_segments s ON w.meeting_id = s.meeting_id AND w.start_ms >= s.start_ms""")
def asof_word_segment(spark, d):
    w = A.gt_words(spark, d).select("meeting_id", "word_idx", "start_ms")
    a = I.asof(w, "start_ms", A.asr_segments(spark, d).select("meeting_id", "seq", "speaker", "start_ms", "end_ms"))
    return a.select("meeting_id", "word_idx", F.col("seg_seq").alias("seq"), F.when(F.col("start_ms") <= F.col("seg_end_ms"), F.col("seg_speaker")).alias("speaker"))


#: Sentences of every speaker against segments of the system, moved by a pattern so that overlaps, near misses and gaps occur.
_MOVED = """, moved AS (SELECT meeting_id, seq, speaker, start_ms + 700 * (seq % 5) - 1400 AS start_ms, end_ms + 700 * (seq % 5) - 1400 - CASE WHEN seq % 4 = 1 THEN (end_ms - start_ms) // 2 ELSE 0 END AS end_ms FROM asr_segments)"""
_BEST = """, o AS (SELECT t.meeting_id, t.sent_idx, s.speaker, s.seq, least(t.end_ms, s.end_ms) - greatest(t.start_ms, s.start_ms) AS overlap FROM sents t JOIN moved s ON s.meeting_id = t.meeting_id AND s.start_ms < t.end_ms AND t.start_ms < s.end_ms),
  best AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY meeting_id, sent_idx ORDER BY overlap DESC, seq) = 1)"""


def _moved(spark, d):
    s = A.asr_segments(spark, d)
    shift = 700 * (F.col("seq") % 5) - 1400
    half = F.when(F.col("seq") % 4 == 1, F.expr("(end_ms - start_ms) div 2")).otherwise(0)
    return s.select("meeting_id", "seq", "speaker", (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift - half).alias("end_ms"))


def _sentences(spark, d):
    return S.assemble_sentences(A.gt_words(spark, d), "meeting_id").select("meeting_id", "sent_idx", "start_ms", "end_ms")


@query("WITH " + _ASR + SENTENCES + _MOVED + _BEST + " SELECT meeting_id, sent_idx, speaker, overlap FROM best")
def max_overlap_speaker(spark, d):
    return I.max_overlap(_sentences(spark, d), _moved(spark, d))


@query("WITH " + _ASR + SENTENCES + _MOVED + _BEST + """, l AS (SELECT * FROM sents t WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.meeting_id = t.meeting_id AND b.sent_idx = t.sent_idx)),
  n AS (SELECT l.meeting_id, l.sent_idx, s.speaker, s.seq, least(abs((l.start_ms + l.end_ms) / 2.0 - s.start_ms), abs((l.start_ms + l.end_ms) / 2.0 - s.end_ms)) AS dist FROM l JOIN moved s USING (meeting_id)),
  near AS (SELECT * FROM n WHERE dist <= 1000 QUALIFY row_number() OVER (PARTITION BY meeting_id, sent_idx ORDER BY dist, seq) = 1)
  SELECT t.meeting_id, t.sent_idx, coalesce(b.speaker, n.speaker, 'Unknown') AS speaker, CASE WHEN b.speaker IS NOT NULL THEN 'overlap' WHEN n.speaker IS NOT NULL THEN 'snap' ELSE 'none' END AS how
  FROM sents t LEFT JOIN best b USING (meeting_id, sent_idx) LEFT JOIN near n USING (meeting_id, sent_idx)""")
def nearest_snap_speaker(spark, d):
    return I.attribute_sentences(_sentences(spark, d), _moved(spark, d)).select("meeting_id", "sent_idx", "speaker", "how")


@query("WITH " + _ASR + _MOVED + """, p AS (SELECT meeting_id, word_idx, (start_ms + end_ms) // 2 AS mid FROM gt_words),
  c AS (SELECT p.meeting_id, p.word_idx, p.mid, s.speaker FROM p LEFT JOIN moved s ON s.meeting_id = p.meeting_id AND s.start_ms <= p.mid AND p.mid <= s.end_ms QUALIFY row_number() OVER (PARTITION BY p.meeting_id, p.word_idx ORDER BY s.seq) = 1),
  r AS (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY meeting_id ORDER BY word_idx)),
  q AS (SELECT *, sum(new) OVER (PARTITION BY meeting_id ORDER BY word_idx) - 1 AS run_idx FROM r)
  SELECT meeting_id, CAST(run_idx AS BIGINT) AS run_idx, any_value(speaker) AS speaker, count(*) AS n_words FROM q GROUP BY meeting_id, run_idx""")
def midpoint_speaker(spark, d):
    from pyspark.sql import Window

    w = A.gt_words(spark, d).select("meeting_id", "word_idx", F.expr("(start_ms + end_ms) div 2").alias("mid"))
    c = w.join(I.covering_segment(w, "mid", _moved(spark, d), "word_idx"), ["meeting_id", "word_idx"], "left")
    o = Window.partitionBy("meeting_id").orderBy("word_idx")
    new = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(o)) | (F.row_number().over(o) == 1)
    return S.numbered(c, new, "meeting_id", ["word_idx"], "run_idx", binned=False).groupBy("meeting_id", "run_idx", "speaker").agg(F.count("*").alias("n_words"))


@query("WITH " + A.UTTERANCES + _CHUNKS + """ SELECT c.meeting_id, c.chunk_idx, u.utt_idx, greatest(c.start_ms, u.start_ms) AS start_ms, least(c.end_ms, u.end_ms) AS end_ms
  FROM chunks c JOIN utterances u ON u.meeting_id = c.meeting_id AND u.end_ms > c.start_ms AND u.start_ms < c.end_ms""")
def chunk_segment_intersect(spark, d):
    u = A.utterances(spark, d).select("meeting_id", "utt_idx", "start_ms", "end_ms")
    j = I.overlap_join(S.silence_chunks(u, "meeting_id", "utt_idx"), u)
    return j.select("meeting_id", F.col("a_chunk_idx").alias("chunk_idx"), F.col("b_utt_idx").alias("utt_idx"), F.greatest("a_start_ms", "b_start_ms").alias("start_ms"), F.least("a_end_ms", "b_end_ms").alias("end_ms"))


@query("WITH " + A.SEGMENTS + """, g AS (SELECT DISTINCT meeting_id, speaker FROM segments_gt), s AS (SELECT DISTINCT meeting_id, speaker FROM segments_sys)
  SELECT g.meeting_id, g.speaker AS gt, s.speaker AS sys, CAST(coalesce((SELECT sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) FROM segments_gt a JOIN segments_sys b ON a.meeting_id = b.meeting_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms
    WHERE a.meeting_id = g.meeting_id AND a.speaker = g.speaker AND b.speaker = s.speaker), 0) AS BIGINT) AS overlap_ms FROM g JOIN s USING (meeting_id)""")
def speaker_overlap_matrix(spark, d):
    g, s = A.segments_gt(spark, d), A.segments_sys(spark, d)
    o = I.overlap_join(g, s).groupBy("meeting_id", F.col("a_speaker").alias("gt"), F.col("b_speaker").alias("sys")).agg(F.sum(I.overlap_ms()).alias("o"))
    all_ = g.select("meeting_id", F.col("speaker").alias("gt")).distinct().join(s.select("meeting_id", F.col("speaker").alias("sys")).distinct(), "meeting_id")
    return all_.join(o, ["meeting_id", "gt", "sys"], "left").select("meeting_id", "gt", "sys", F.coalesce("o", F.lit(0)).cast("long").alias("overlap_ms"))


@query("WITH " + A.SEGMENTS + """, g AS (SELECT meeting_id, count(*) AS n_gt, count(*) FILTER (EXISTS (SELECT 1 FROM segments_sys s WHERE s.meeting_id = g.meeting_id AND s.start_ms <= g.end_ms AND g.start_ms <= s.end_ms)) AS gt_hit FROM segments_gt g GROUP BY meeting_id),
  s AS (SELECT meeting_id, count(*) AS n_sys, count(*) FILTER (EXISTS (SELECT 1 FROM segments_gt g WHERE s.meeting_id = g.meeting_id AND s.start_ms <= g.end_ms AND g.start_ms <= s.end_ms)) AS sys_hit FROM segments_sys s GROUP BY meeting_id)
  SELECT g.meeting_id, n_gt, gt_hit, coalesce(n_sys, 0) AS n_sys, coalesce(sys_hit, 0) AS sys_hit FROM g LEFT JOIN s USING (meeting_id)""")
def segment_match(spark, d):
    g, s = A.segments_gt(spark, d), A.segments_sys(spark, d)
    j = I.overlap_join(g, s, strict=False)
    hit = lambda side, name: j.select("meeting_id", f"{side}_seq").distinct().groupBy("meeting_id").agg(F.count("*").alias(name))
    n = g.groupBy("meeting_id").agg(F.count("*").alias("n_gt")).join(s.groupBy("meeting_id").agg(F.count("*").alias("n_sys")), "meeting_id", "left").join(hit("a", "gt_hit"), "meeting_id", "left").join(hit("b", "sys_hit"), "meeting_id", "left")
    return n.select("meeting_id", "n_gt", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gt_hit", "n_sys", "sys_hit")])


_PARENTS = """, outl AS (SELECT meeting_id, start_ms + (end_ms - start_ms) // 4 AS start_ms, end_ms - (end_ms - start_ms) // 4 AS end_ms FROM segments_gt WHERE seq % 3 = 0),
  merged AS (SELECT meeting_id, start_ms - CASE WHEN seq % 2 = 0 THEN 5 ELSE -50 END AS start_ms, end_ms + 5 AS end_ms FROM segments_gt)"""


@query("WITH " + A.SEGMENTS_GT + _PARENTS + """ SELECT meeting_id, seq, start_ms, end_ms FROM segments_gt p WHERE EXISTS (SELECT 1 FROM outl o WHERE o.meeting_id = p.meeting_id AND o.start_ms >= p.start_ms AND o.end_ms <= p.end_ms)
  AND EXISTS (SELECT 1 FROM merged m WHERE m.meeting_id = p.meeting_id AND m.start_ms <= p.start_ms AND m.end_ms >= p.end_ms)""")
def intact_parents(spark, d):
    p = A.segments_gt(spark, d)
    quarter = F.expr("(end_ms - start_ms) div 4")
    out = p.where("seq % 3 = 0").select("meeting_id", (F.col("start_ms") + quarter).alias("start_ms"), (F.col("end_ms") - quarter).alias("end_ms"))
    merged = p.select("meeting_id", (F.col("start_ms") - F.when(F.col("seq") % 2 == 0, 5).otherwise(-50)).alias("start_ms"), (F.col("end_ms") + 5).alias("end_ms"))
    holds = I.overlap_join(p, out, strict=False).where("b_start_ms >= a_start_ms and b_end_ms <= a_end_ms").select("meeting_id", F.col("a_seq").alias("seq")).distinct()
    whole = I.overlap_join(p, merged, strict=False).where("b_start_ms <= a_start_ms and b_end_ms >= a_end_ms").select("meeting_id", F.col("a_seq").alias("seq")).distinct()
    return p.join(holds, ["meeting_id", "seq"], "left_semi").join(whole, ["meeting_id", "seq"], "left_semi").select("meeting_id", "seq", "start_ms", "end_ms")


_POS = """, pw AS (SELECT meeting_id, speaker, word, row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY word_idx) - 1 AS pos FROM gt_words),
  ok AS (SELECT t.* FROM topic_spans t JOIN pw a ON a.meeting_id = t.meeting_id AND a.speaker = t.speaker AND a.pos = t.s_idx JOIN pw b ON b.meeting_id = t.meeting_id AND b.speaker = t.speaker AND b.pos = t.e_idx WHERE s_idx <= e_idx),
  st AS (SELECT ok.meeting_id, topic_id, span_idx, ok.speaker, string_agg(word, ' ' ORDER BY pos) AS t FROM ok JOIN pw ON pw.meeting_id = ok.meeting_id AND pw.speaker = ok.speaker AND pos BETWEEN s_idx AND e_idx GROUP BY ALL)"""


def _span_texts(spark, d, keys, sep):
    from pyspark.sql import Window

    w = A.gt_words(spark, d)
    pos = F.row_number().over(Window.partitionBy("meeting_id", "speaker").orderBy("word_idx")) - 1
    return C.span_text(A.topic_spans(spark, d), w.select("meeting_id", "speaker", "word", pos.cast("long").alias("pos")), keys, sep)


@query("WITH " + A.GT_WORDS + "," + A.TOPIC_SPANS + _POS + " SELECT meeting_id, topic_id, count(*) AS units, CAST(len(string_split(string_agg(t, ' ' ORDER BY span_idx, speaker), ' ')) AS BIGINT) AS length, string_agg(t, ' ' ORDER BY span_idx, speaker) AS text FROM st GROUP BY ALL")
def span_text_lookup(spark, d):
    return _span_texts(spark, d, ["meeting_id", "topic_id"], " ")


@query("WITH " + A.GT_WORDS + "," + A.TOPIC_SPANS + _POS + " SELECT meeting_id, topic_id, count(*) AS units, CAST(len(string_split(string_agg(t, '' ORDER BY span_idx, speaker), ' ')) AS BIGINT) AS length FROM st GROUP BY ALL")
def topic_layer(spark, d):
    """Spans glued without a space, as the reference scores are made."""
    return _span_texts(spark, d, ["meeting_id", "topic_id"], "").select("meeting_id", "topic_id", "units", "length")


# Words against predicted speakers ------------------------------------------------------------------------------------

_MEANT = _ASR + r""", mw AS (SELECT * FROM gt_words WHERE regexp_full_match(lower(trim(word)), '\p{L}+') AND length(trim(word)) > 1 AND lower(trim(word)) NOT IN ('uh', 'um', 'mm', 'hmm', 'uhh', 'umm')),
  att AS (SELECT w.meeting_id, w.word_idx, w.speaker, CASE WHEN w.start_ms <= s.end_ms THEN s.speaker END AS pred, coalesce(w.start_ms <= s.end_ms AND contains(lower(s.text), lower(trim(w.word))), false) AS covered
    FROM mw w ASOF LEFT JOIN asr_segments s ON w.meeting_id = s.meeting_id AND w.start_ms >= s.start_ms),
  smap AS (SELECT meeting_id, speaker, pred, count(*) AS n FROM att WHERE covered GROUP BY meeting_id, speaker, pred QUALIFY row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY count(*) DESC, min(word_idx)) = 1),
  sac AS (SELECT a.meeting_id, count(*) AS n_words, count(*) FILTER (covered) AS n_covered, count(*) FILTER (a.pred = m.pred) AS n_matched FROM att a LEFT JOIN smap m ON m.meeting_id = a.meeting_id AND m.speaker = a.speaker GROUP BY a.meeting_id)"""


def _attributed(spark, d):
    return C.attributed_words(A.gt_words(spark, d), A.asr_segments(spark, d))


@query("WITH " + _MEANT + " SELECT meeting_id, n_words, n_covered, CASE WHEN n_words > 0 THEN round(n_covered / n_words, 6) ELSE 0 END AS coverage FROM sac")
def word_coverage(spark, d):
    s = C.sac(_attributed(spark, d))
    return s.select("meeting_id", "n_words", "n_covered", C.ratio(F.col("n_covered"), F.col("n_words")).alias("coverage"))


@query("WITH " + _MEANT + " SELECT meeting_id, speaker, pred, n FROM smap")
def speaker_mapping(spark, d):
    return C.speaker_map(_attributed(spark, d))


@query("WITH " + _MEANT + " SELECT meeting_id, n_words, n_matched, CASE WHEN n_words > 0 THEN round(n_matched / n_words, 6) ELSE 0 END AS accuracy FROM sac")
def speaker_accuracy(spark, d):
    s = C.sac(_attributed(spark, d))
    return s.select("meeting_id", "n_words", "n_matched", C.ratio(F.col("n_matched"), F.col("n_words")).alias("accuracy"))


@query("WITH " + _MEANT + " SELECT meeting_id, round((n_covered * n_matched) / (n_words * n_words), 6) AS sac FROM sac")
def sac_score(spark, d):
    s = C.sac(_attributed(spark, d))
    return s.select("meeting_id", C.ratio(F.col("n_covered") * F.col("n_matched"), F.col("n_words") * F.col("n_words")).alias("sac"))
