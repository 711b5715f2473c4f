"""Queries that score summaries: overlaps, coverage, compression, support, ROUGE-L, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoq import adapters as A
from convoq.functions import text as T
from convoq.operators import coverage as C
from convoq.plans.turns import SPAN_MERGE

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '\s+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'))"


def _tok(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({_norm(x)}, ' +'), lambda t: t <> ''))"


_BASE = A.UTTERANCES + "," + A.PRED_TEXTS


@query("WITH " + _BASE + f""", p AS (SELECT g.meeting_id, g.layer, g.unit_idx, {_tok('g.text')} AS a, {_tok('p.text')} AS b FROM gt_units g JOIN pred_texts p ON p.meeting_id = g.meeting_id AND p.layer = g.layer AND p.text_idx = g.unit_idx + 1)
  SELECT meeting_id, layer, unit_idx, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a), 6) ELSE 0 END AS overlap, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / sqrt(len(a) * len(b)), 6) ELSE 0 END AS similarity FROM p""")
def token_overlap(spark, d):
    g, p = A.gt_units(spark, d), A.pred_texts(spark, d).select("meeting_id", "layer", (F.col("text_idx") - 1).alias("unit_idx"), F.col("text").alias("other"))
    j = g.join(p, ["meeting_id", "layer", "unit_idx"])
    a, b = T.tokenize(F.col("text")), T.tokenize(F.col("other"))
    return j.select("meeting_id", "layer", "unit_idx", F.round(T.overlap_ratio(a, b), 6).alias("overlap"), F.round(T.bag_cosine(a, b), 6).alias("similarity"))


def _chunks(view: str, idx: str, name: str, least: int = 0) -> str:
    return f""", {name}0 AS (SELECT meeting_id, layer, {idx} AS o, string_split_regex(text, '[.!?]+') AS parts FROM {view}),
  {name}1 AS (SELECT meeting_id, layer, o, unnest(parts) AS raw, generate_subscripts(parts, 1) AS q FROM {name}0),
  {name}2 AS (SELECT meeting_id, layer, o, q, {_norm('raw')} AS chunk FROM {name}1),
  {name} AS (SELECT meeting_id, layer, row_number() OVER (PARTITION BY meeting_id, layer ORDER BY o, q) - 1 AS chunk_idx, chunk FROM {name}2 WHERE length(chunk) >= 6 AND len(list_filter(string_split_regex(chunk, ' +'), lambda t: t <> '')) >= {least})"""


_KEYS = ["meeting_id", "layer"]


@query("WITH " + _BASE + _chunks("gt_units", "unit_idx", "gc") + " SELECT * FROM gc")
def sentence_chunks(spark, d):
    return C.text_chunks(A.gt_units(spark, d), _KEYS, "unit_idx")


@query("WITH " + _BASE + _chunks("gt_units", "unit_idx", "gc", 4) + " SELECT * FROM gc")
def low_info_filter(spark, d):
    return C.text_chunks(A.gt_units(spark, d), _KEYS, "unit_idx", least_tokens=4)


_CR = """, i AS (SELECT meeting_id, layer, CAST(sum(len(list_filter(string_split_regex({g}, ' +'), lambda t: t <> ''))) AS BIGINT) AS n_in FROM gt_units GROUP BY ALL),
  o AS (SELECT meeting_id, layer, CAST(sum(len(list_filter(string_split_regex({g}, ' +'), lambda t: t <> ''))) AS BIGINT) AS n_out FROM pred_texts GROUP BY ALL),
  cr AS (SELECT meeting_id, layer, n_in, coalesce(n_out, 0) AS n_out FROM i LEFT JOIN o USING (meeting_id, layer))""".format(g=_norm("text"))


@query("WITH " + _BASE + _CR + " SELECT meeting_id, layer, n_in, n_out, round(n_out / greatest(n_in, 1), 6) AS cr FROM cr")
def compression_ratio(spark, d):
    c = C.compression(A.gt_units(spark, d), A.pred_texts(spark, d), _KEYS)
    return c.select("*", F.round(F.col("n_out") / F.greatest("n_in", F.lit(1)), 6).alias("cr"))


_ICS = _chunks("gt_units", "unit_idx", "gc", 4) + _chunks("pred_texts", "text_idx", "pc") + f""",
  pr AS (SELECT g.meeting_id, g.layer, g.chunk_idx AS gi, p.chunk_idx AS pi, {_tok('g.chunk')} AS a, {_tok('p.chunk')} AS b FROM gc g JOIN pc p ON p.meeting_id = g.meeting_id AND p.layer = g.layer),
  sc AS (SELECT meeting_id, layer, gi, pi, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END AS ov, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / sqrt(len(a) * len(b)) ELSE 0 END AS sim FROM pr),
  rk AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, layer, gi ORDER BY ov DESC, pi DESC) AS r FROM sc),
  cv AS (SELECT meeting_id, layer, gi, least(1.0, sum(CASE r WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END * (0.7 * ov + 0.3 * sim))) AS coverage FROM rk WHERE r <= 3 GROUP BY ALL),
  ics AS (SELECT g.meeting_id, g.layer, count(*) AS n_chunks, avg(coalesce(coverage, 0)) AS ics FROM gc g LEFT JOIN cv ON cv.meeting_id = g.meeting_id AND cv.layer = g.layer AND cv.gi = g.chunk_idx GROUP BY ALL),
  oi AS (SELECT meeting_id, sum(CASE layer WHEN 'participant' THEN 1.5 WHEN 'topic' THEN 1.0 ELSE 2.0 END * ics) / 4.5 AS ics FROM ics GROUP BY meeting_id)"""


def _scores(spark, d):
    return C.layer_scores(A.gt_units(spark, d), A.pred_texts(spark, d).withColumnRenamed("text_idx", "unit_idx"), _KEYS)


@query("WITH " + _BASE + _ICS + " SELECT meeting_id, layer, gi AS gt_idx, pi AS pred_idx, r AS rank, round(ov, 6) AS overlap, round(sim, 6) AS similarity FROM rk WHERE r <= 3")
def ics_best_chunks(spark, d):
    g = C.text_chunks(A.gt_units(spark, d), _KEYS, "unit_idx", least_tokens=4)
    b = C.best_chunks(g, C.text_chunks(A.pred_texts(spark, d), _KEYS, "text_idx"), _KEYS)
    return b.select("meeting_id", "layer", "gt_idx", "pred_idx", F.col("rank").cast("long").alias("rank"), F.round("overlap", 6).alias("overlap"), F.round("similarity", 6).alias("similarity"))


@query("WITH " + _BASE + _ICS + " SELECT meeting_id, layer, n_chunks, round(ics, 5) AS ics FROM ics")
def ics_layer(spark, d):
    return _scores(spark, d).where("n_chunks > 0").select("meeting_id", "layer", "n_chunks", F.round("ics", 5).alias("ics"))


@query("WITH " + _BASE + _ICS + " SELECT meeting_id, round(ics, 5) AS ics FROM oi")
def ics_overall(spark, d):
    return C.overall_ics(_scores(spark, d).where("n_chunks > 0")).select("meeting_id", F.round("ics", 5).alias("ics"))


#: Claims are predicted sentences of the meeting layer and above, chunks are the reference's.
_HR = """, cl AS (SELECT meeting_id, layer, chunk_idx AS ci, {t1} AS a FROM pc), tx AS (SELECT meeting_id, layer, chunk_idx AS ti, {t1} AS b FROM ga),
  sm AS (SELECT cl.meeting_id, cl.layer, ci, ti, len(list_intersect(a, b)) AS n, len(a) AS na, len(b) AS nb FROM cl JOIN tx ON tx.meeting_id = cl.meeting_id AND tx.layer = cl.layer),
  bs AS (SELECT *, n / sqrt(na * nb) AS s FROM sm WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY meeting_id, layer, ci ORDER BY n / sqrt(na * nb) DESC, ti) = 1),
  cs AS (SELECT cl.meeting_id, cl.layer, cl.ci, bs.ti, coalesce(s, 0) AS s, coalesce(n / na, 0) AS ov, coalesce(s, 0) < 0.5 AND coalesce(n / na, 0) < 0.3 AS un FROM cl LEFT JOIN bs ON bs.meeting_id = cl.meeting_id AND bs.layer = cl.layer AND bs.ci = cl.ci),
  hr AS (SELECT meeting_id, layer, count(*) AS n_claims, count(*) FILTER (un) AS n_unsupported FROM cs GROUP BY ALL)""".format(t1=_tok("chunk"))
_HR = _chunks("gt_units", "unit_idx", "ga") + _chunks("pred_texts", "text_idx", "pc") + _HR


def _support(spark, d):
    return C.claim_support(C.text_chunks(A.pred_texts(spark, d), _KEYS, "text_idx"), C.text_chunks(A.gt_units(spark, d), _KEYS, "unit_idx"), _KEYS)


@query("WITH " + _BASE + _HR + " SELECT meeting_id, layer, ci AS claim_idx, ti AS best_idx, round(s, 6) AS similarity, round(ov, 6) AS overlap, un AS unsupported FROM cs")
def claim_support(spark, d):
    s = _support(spark, d)
    return s.select("meeting_id", "layer", "claim_idx", "best_idx", F.round("similarity", 6).alias("similarity"), F.round("overlap", 6).alias("overlap"), "unsupported")


@query("WITH " + _BASE + _HR + " SELECT meeting_id, layer, n_claims, n_unsupported, round(n_unsupported / n_claims, 6) AS hr FROM hr")
def hallucination_rate(spark, d):
    h = _scores(spark, d).where("n_claims > 0").select("meeting_id", "layer", "n_claims", "n_unsupported")
    return h.select("*", F.round(F.col("n_unsupported") / F.col("n_claims"), 6).alias("hr"))


@query("WITH " + _BASE + _ICS + _HR.replace(_chunks("pred_texts", "text_idx", "pc"), "") + _CR + """, h AS (SELECT meeting_id, sum(n_unsupported) / sum(n_claims) AS hr FROM hr GROUP BY 1), c AS (SELECT meeting_id, sum(n_out) / greatest(sum(n_in), 1) AS cr FROM cr GROUP BY 1)
  SELECT oi.meeting_id, round(oi.ics, 5) AS ics, round(coalesce(h.hr, 0), 5) AS hr, round(c.cr, 5) AS cr, round(oi.ics * (1 - coalesce(h.hr, 0)) * (1 - c.cr), 5) AS score FROM oi LEFT JOIN h USING (meeting_id) JOIN c USING (meeting_id)""")
def summary_score(spark, d):
    s = _scores(spark, d)
    weight = F
    for layer, x in C.LAYER_WEIGHTS.items():
        weight = weight.when(F.col("layer") == layer, x)
    claims, n_in = F.sum("n_claims"), F.sum("n_in")
    m = s.groupBy("meeting_id").agg(
        (F.sum(weight.otherwise(0.0) * F.col("ics")) / sum(C.LAYER_WEIGHTS.values())).alias("ics"), F.when(claims > 0, F.sum("n_unsupported") / claims).otherwise(0.0).alias("hr"), (F.sum("n_out") / F.greatest(n_in, F.lit(1))).alias("cr")
    )
    score = F.col("ics") * (1 - F.col("hr")) * (1 - F.col("cr"))
    return m.where("ics is not null").select("meeting_id", F.round("ics", 5).alias("ics"), F.round("hr", 5).alias("hr"), F.round("cr", 5).alias("cr"), F.round(score, 5).alias("score"))


def _most_common(keys: str, rows: str) -> str:
    """SQL of plugins.summaries with two texts: the rows' tokens, the groups' texts that hold each, the two with the largest mean."""
    return f"""SELECT {keys}, idx, text, round(coalesce(avg(held), 0), 6) AS worth FROM (SELECT {keys}, idx, text, token, CASE WHEN token IS NOT NULL THEN count(*) OVER (PARTITION BY {keys}, token) END AS held
    FROM (SELECT {keys}, idx, text, unnest(CASE WHEN len(k) > 0 THEN k ELSE [NULL] END) AS token FROM (SELECT {keys}, idx, text, {_tok('text')} AS k FROM {rows}))) GROUP BY {keys}, idx, text QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY worth DESC, idx) <= 2"""


@query("WITH " + A.UTTERANCES + f""", tg AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms, utt_idx) AS gap FROM utterances),
  tt AS (SELECT meeting_id, 'topic' AS layer, CAST(least(sum(CASE WHEN gap * 4 > 90000 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY start_ms, utt_idx), 3) AS VARCHAR) AS part, utt_idx AS idx, text FROM tg),
  al AS (SELECT * FROM tt UNION ALL SELECT meeting_id, 'participant', speaker, utt_idx, text FROM utterances UNION ALL SELECT meeting_id, 'meeting', '', utt_idx, text FROM utterances),
  sm AS ({_most_common('meeting_id, layer, part', 'al')})
  SELECT meeting_id, layer, part, count(*) FILTER (worth > 0) AS n, coalesce(string_agg(text, ' ' ORDER BY idx) FILTER (worth > 0), '') AS summary FROM sm GROUP BY ALL""")
def layer_summaries(spark, d):
    """The default generator's summaries of speakers, topics and meetings."""
    from convoq.operators.sequence import topic_groups
    from convoq.plugins import summaries

    u = topic_groups(A.utterances(spark, d), "meeting_id", "utt_idx")
    parts = F.array(*[F.struct(F.lit(k).alias("layer"), c.alias("part")) for k, c in (("topic", F.col("topic_idx").cast("string")), ("participant", F.col("speaker")), ("meeting", F.lit("")))])
    return summaries(u.select("meeting_id", "utt_idx", "text", F.explode(parts).alias("p")).select("meeting_id", "utt_idx", "text", "p.*"), ["meeting_id", "layer", "part"], "utt_idx")


@query()
def rouge_l(spark, d):
    join = lambda df, idx: df.groupBy(*_KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(idx, "text"))), lambda s: s["text"]), " ").alias("text"))
    return C.rouge_l(join(A.gt_units(spark, d), "unit_idx"), join(A.pred_texts(spark, d), "text_idx"), _KEYS)


@query("WITH " + A.GT_WORDS + "," + A.TOPIC_SPANS + SPAN_MERGE + """, u AS (SELECT meeting_id, topic_id, speaker, unnest(range(s_idx, e_idx + 1)) AS w FROM merged),
  n AS (SELECT *, count(*) OVER (PARTITION BY meeting_id, speaker, w) AS k FROM u)
  SELECT meeting_id, topic_id, count(*) AS total_units, count(*) FILTER (k = 1) AS unique_units, count(*) FILTER (k > 1) AS shared_units, round(count(*) FILTER (k = 1) / count(*), 6) AS distinct_ratio FROM n GROUP BY ALL""")
def topic_distinctness(spark, d):
    t = C.topic_distinctness(A.topic_spans(spark, d))
    return t.select("*", F.round(F.col("unique_units") / F.col("total_units"), 6).alias("distinct_ratio"))


@query("WITH " + _BASE + """ SELECT layer, count(*) AS n_rows, count(DISTINCT meeting_id) AS n_meetings, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (SELECT meeting_id, layer, text FROM gt_units WHERE trim(text) <> '' UNION ALL SELECT meeting_id, 'pred_' || layer, text FROM pred_texts WHERE trim(text) <> '') GROUP BY layer""")
def layer_flatten(spark, d):
    g = A.gt_units(spark, d).select("meeting_id", "layer", "text")
    p = A.pred_texts(spark, d).select("meeting_id", F.concat(F.lit("pred_"), "layer").alias("layer"), "text")
    return g.unionByName(p).where(F.trim("text") != "").groupBy("layer").agg(F.count("*").alias("n_rows"), F.countDistinct("meeting_id").alias("n_meetings"), F.sum(F.length("text")).alias("n_chars"))
