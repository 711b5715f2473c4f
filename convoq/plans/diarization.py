"""Queries that measure a system's segments against the reference's."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from convoq import adapters as A
from convoq.operators import diarization as D
from convoq.scratch import stored

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _frames_sql(side: str) -> str:
    return f"{side}f AS (SELECT meeting_id, seq, speaker, start_ms // 10 AS s, (end_ms + 9) // 10 AS e FROM segments_{side} WHERE end_ms - start_ms >= 200)"


#: The sweep by plain SQL: all boundaries of a meeting, and for each stretch the last segment of either side.
_SWEEP = A.SEGMENTS + f""", {_frames_sql('gt')}, {_frames_sql('sys')},
  bd AS (SELECT meeting_id, s AS t FROM gtf UNION SELECT meeting_id, e FROM gtf UNION SELECT meeting_id, s FROM sysf UNION SELECT meeting_id, e FROM sysf),
  st AS (SELECT meeting_id, t, lead(t) OVER (PARTITION BY meeting_id ORDER BY t) AS u FROM bd),
  gs AS (SELECT st.meeting_id, t, u, arg_max(speaker, seq) AS gt FROM st JOIN gtf ON gtf.meeting_id = st.meeting_id AND s <= t AND e >= u GROUP BY ALL),
  ss AS (SELECT st.meeting_id, t, u, arg_max(speaker, seq) AS sys FROM st JOIN sysf ON sysf.meeting_id = st.meeting_id AND s <= t AND e >= u GROUP BY ALL),
  sw AS (SELECT meeting_id, t, u, u - t AS len, gt, sys FROM gs FULL JOIN ss USING (meeting_id, t, u)),
  cm AS (SELECT meeting_id, gt, sys, CAST(sum(len) AS BIGINT) AS frames FROM sw WHERE gt IS NOT NULL AND sys IS NOT NULL GROUP BY ALL)"""

#: Assignment by trying all orders of five places, the first of the best in lexicographic order.
_PERMUTATIONS = ", ".join(str(list(p)) for p in permutations(range(1, 6)))
_ASSIGN = f""",
  gr AS (SELECT meeting_id, gt, row_number() OVER (PARTITION BY meeting_id ORDER BY gt) AS i FROM (SELECT DISTINCT meeting_id, gt FROM sw WHERE gt IS NOT NULL)),
  sr AS (SELECT meeting_id, sys, row_number() OVER (PARTITION BY meeting_id ORDER BY sys) AS j FROM (SELECT DISTINCT meeting_id, sys FROM sw WHERE sys IS NOT NULL)),
  pm AS (SELECT unnest([{_PERMUTATIONS}]) AS p),
  w AS (SELECT gr.meeting_id, i, j, frames FROM cm JOIN gr USING (meeting_id, gt) JOIN sr USING (meeting_id, sys)),
  sc AS (SELECT m.meeting_id, p, coalesce(sum(frames), 0) AS total FROM (SELECT DISTINCT meeting_id FROM gr) m CROSS JOIN pm LEFT JOIN w ON w.meeting_id = m.meeting_id AND p[i] = j GROUP BY ALL),
  bp AS (SELECT meeting_id, p FROM sc QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY total DESC, p) = 1),
  mp AS (SELECT bp.meeting_id, gt, sys FROM bp JOIN gr USING (meeting_id) JOIN sr ON sr.meeting_id = bp.meeting_id AND p[i] = j),
  ms AS (SELECT sw.*, mp.gt AS sys_gt FROM sw LEFT JOIN mp ON mp.meeting_id = sw.meeting_id AND mp.sys = sw.sys)"""
_COUNTS = """,
  ec AS (SELECT meeting_id, CAST(coalesce(sum(len) FILTER (gt IS NOT NULL AND (sys IS NULL OR sys_gt IS NULL)), 0) AS BIGINT) AS missed,
    CAST(coalesce(sum(len) FILTER (sys IS NOT NULL AND (gt IS NULL OR sys_gt IS NULL)), 0) AS BIGINT) AS false_alarm,
    CAST(coalesce(sum(len) FILTER (gt IS NOT NULL AND sys_gt <> gt), 0) AS BIGINT) AS confusion, CAST(coalesce(sum(len) FILTER (gt IS NOT NULL), 0) AS BIGINT) AS total FROM ms GROUP BY meeting_id)"""
_RATES = """SELECT meeting_id, missed, false_alarm, confusion, total, CASE WHEN total > 0 THEN round((missed + false_alarm + confusion) / total, 6) ELSE 0 END AS der,
  CASE WHEN total > 0 THEN round(missed / total, 6) ELSE 0 END AS miss, CASE WHEN total > 0 THEN round(false_alarm / total, 6) ELSE 0 END AS fa, CASE WHEN total > 0 THEN round(confusion / total, 6) ELSE 0 END AS conf FROM ec"""


def _sweep(spark, d):
    return D.aligned(A.segment_sides(spark, d))


def _mapping(sw):
    t = D.totals(sw)
    return D.assignment(D.confusion(t), D.speakers(t))


def _mapped(spark, d):
    sw = stored(_sweep(spark, d), "sweep")  # read for the mapping and for the result
    return D.mapped(sw, _mapping(sw))


def _mapped_totals(spark, d):
    t = D.totals(_sweep(spark, d))
    return D.mapped(t, D.assignment(D.confusion(t), D.speakers(t)))


@query("WITH " + _SWEEP + " SELECT * FROM cm")
def frame_confusion(spark, d):
    return D.confusion(_sweep(spark, d))


@query("WITH " + _SWEEP + _ASSIGN + " SELECT meeting_id, gt, sys FROM mp")
def speaker_assignment(spark, d):
    return _mapping(_sweep(spark, d))


@query("WITH " + _SWEEP + _ASSIGN + _COUNTS + _RATES.replace("SELECT", " SELECT", 1))
def der_report(spark, d):
    return D.der(A.segment_sides(spark, d))


@query("WITH " + _SWEEP + _ASSIGN + _COUNTS + """, r AS (SELECT *, (missed + false_alarm + confusion) / total AS x FROM ec)
  SELECT count(*) AS meetings, round(avg(x), 6) AS der_macro, round(sum(missed + false_alarm + confusion) / sum(total), 6) AS der_pooled, round(avg(missed / total), 6) AS miss_macro, round(avg(false_alarm / total), 6) AS fa_macro, round(avg(confusion / total), 6) AS conf_macro, CAST(sum(total) AS BIGINT) AS total FROM r WHERE total > 0""")
def der_corpus(spark, d):
    c = D.error_counts(_mapped_totals(spark, d)).where("total > 0")
    err = F.col("missed") + F.col("false_alarm") + F.col("confusion")
    avg = lambda x, name: F.round(F.avg(x / F.col("total")), 6).alias(name)
    return c.agg(
        F.count("*").alias("meetings"), avg(err, "der_macro"), F.round(F.sum(err) / F.sum("total"), 6).alias("der_pooled"), avg(F.col("missed"), "miss_macro"),
        avg(F.col("false_alarm"), "fa_macro"), avg(F.col("confusion"), "conf_macro"), F.sum("total").alias("total"),
    )


@query("WITH " + _SWEEP + _ASSIGN + _COUNTS.replace("AND (sys IS NULL OR sys_gt IS NULL)), 0) AS BIGINT) AS missed", "AND sys IS NULL), 0) AS BIGINT) AS missed").replace("AND (gt IS NULL OR sys_gt IS NULL)", "AND gt IS NULL").replace("gt IS NOT NULL AND sys_gt <> gt", "gt IS NOT NULL AND sys IS NOT NULL AND sys_gt IS DISTINCT FROM gt") + " SELECT * FROM ec")
def error_counts_confusion(spark, d):
    """The variant that counts a speaker without a partner as confusion."""
    return D.error_counts(_mapped_totals(spark, d), "confusion")


def _wide(side: str) -> str:
    return f"""{side}w AS (SELECT x.meeting_id, greatest(0, CAST(trunc((start_ms - 10) / 10.0) AS BIGINT)) AS s, least(n, CAST(trunc((end_ms + 10) / 10.0) AS BIGINT)) AS e FROM segments_{side} x JOIN mx USING (meeting_id)),
  {side}b AS (SELECT *, max(e) OVER (PARTITION BY meeting_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {side}w WHERE e > s),
  {side}c AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM {side}b),
  {side}u AS (SELECT meeting_id, min(s) AS s, max(e) AS e FROM {side}c GROUP BY meeting_id, k)"""


@query("WITH " + A.SEGMENTS + f""", mx AS (SELECT meeting_id, max(end_ms) // 10 + 1 AS n, count(DISTINCT side) AS sides FROM (SELECT meeting_id, end_ms, 0 AS side FROM segments_gt UNION ALL SELECT meeting_id, end_ms, 1 FROM segments_sys) GROUP BY meeting_id),
  {_wide('gt')}, {_wide('sys')},
  tp AS (SELECT a.meeting_id, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS tp FROM gtu a JOIN sysu b ON a.meeting_id = b.meeting_id AND a.s < b.e AND b.s < a.e GROUP BY a.meeting_id),
  ng AS (SELECT meeting_id, sum(e - s) AS g FROM gtu GROUP BY meeting_id), ns AS (SELECT meeting_id, sum(e - s) AS s FROM sysu GROUP BY meeting_id),
  ct AS (SELECT meeting_id, CAST(CASE WHEN sides = 2 THEN coalesce(tp, 0) ELSE 0 END AS BIGINT) AS tp, CAST(CASE WHEN sides = 2 THEN coalesce(g, 0) - coalesce(tp, 0) ELSE 0 END AS BIGINT) AS fn, CAST(CASE WHEN sides = 2 THEN coalesce(s, 0) - coalesce(tp, 0) ELSE 0 END AS BIGINT) AS fp
    FROM mx LEFT JOIN tp USING (meeting_id) LEFT JOIN ng USING (meeting_id) LEFT JOIN ns USING (meeting_id))
  SELECT *, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall, CASE WHEN tp + fp > 0 THEN round(fp / (tp + fp), 6) ELSE 0 END AS fa_rate FROM ct""")
def vad_detection(spark, d):
    v = D.detection(A.segments_gt(spark, d), A.segments_sys(spark, d))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    return v.select("*", share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), share(F.col("fp"), F.col("tp") + F.col("fp")).alias("fa_rate"))


@query("WITH " + _SWEEP + _ASSIGN + """ SELECT meeting_id, CAST(coalesce(sum(len) FILTER (sys_gt = gt), 0) AS BIGINT) AS matched, CAST(coalesce(sum(len) FILTER (gt IS NOT NULL), 0) AS BIGINT) AS total,
  CASE WHEN coalesce(sum(len) FILTER (gt IS NOT NULL), 0) > 0 THEN round(coalesce(sum(len) FILTER (sys_gt = gt), 0) / sum(len) FILTER (gt IS NOT NULL), 6) ELSE 0 END AS quality FROM ms GROUP BY meeting_id""")
def label_quality(spark, d):
    q = D.quality(_mapped_totals(spark, d))
    return q.select("*", F.when(F.col("total") > 0, F.round(F.col("matched") / F.col("total"), 6)).otherwise(F.lit(0.0)).alias("quality"))


_RUNS = lambda col, name: f"""{name}0 AS (SELECT *, CASE WHEN {col} = lag({col}) OVER (PARTITION BY meeting_id ORDER BY t) THEN 0 ELSE 1 END AS new FROM ms WHERE {col} IS NOT NULL),
  {name}1 AS (SELECT *, sum(new) OVER (PARTITION BY meeting_id ORDER BY t) - 1 AS run_idx FROM {name}0),
  {name} AS (SELECT meeting_id, CAST(run_idx AS BIGINT) AS run_idx, any_value({col}) AS {col}, CAST(sum(len) AS BIGINT) AS run_length FROM {name}1 GROUP BY meeting_id, run_idx)"""  # noqa: E731


@query("WITH " + _SWEEP + _ASSIGN + ", " + _RUNS("gt", "gq") + ", " + _RUNS("sys_gt", "sq") + """,
  n AS (SELECT g.meeting_id, gn, sn FROM (SELECT meeting_id, count(*) AS sn FROM sq GROUP BY 1) s LEFT JOIN (SELECT meeting_id, count(*) AS gn FROM gq GROUP BY 1) g USING (meeting_id))
  SELECT meeting_id, 'OSCILLATION' AS issue, '' AS label, sn AS n FROM n WHERE sn > coalesce(gn, 0)
  UNION ALL SELECT meeting_id, 'MERGE', sys, count(DISTINCT gt) FROM ms WHERE gt IS NOT NULL AND sys IS NOT NULL GROUP BY meeting_id, sys HAVING count(DISTINCT gt) > 1
  UNION ALL SELECT meeting_id, 'SPLIT', gt, count(DISTINCT sys_gt) FROM ms WHERE gt IS NOT NULL GROUP BY meeting_id, gt HAVING count(DISTINCT sys_gt) > 1
  UNION ALL SELECT meeting_id, 'EMPTY', '', 0 FROM ms GROUP BY meeting_id HAVING count(gt) = 0 OR count(sys) = 0""")
def diar_issues(spark, d):
    return D.issues(_mapped(spark, d))


@query("WITH " + _SWEEP + _ASSIGN + ", " + _RUNS("sys_gt", "sq") + " SELECT meeting_id, run_idx, sys_gt, run_length FROM sq")
def label_runs(spark, d):
    return D.runs(_mapped(spark, d), "sys_gt")


@query("WITH " + _SWEEP + _ASSIGN + """, fr AS (SELECT meeting_id, unnest(range(t, u)) AS f, gt, sys_gt FROM ms WHERE gt IS NOT NULL),
  bad AS (SELECT meeting_id, f FROM fr WHERE sys_gt IS DISTINCT FROM gt), near AS (SELECT DISTINCT meeting_id, f + d AS f FROM bad, (SELECT unnest(range(-5, 6)) AS d)),
  raw AS (SELECT fr.* FROM fr JOIN near USING (meeting_id, f)),
  a AS (SELECT *, lag(f) OVER w AS pf, lag(gt) OVER w AS pg, lag(sys_gt) OVER w AS ps FROM raw WINDOW w AS (PARTITION BY meeting_id ORDER BY f)),
  b AS (SELECT *, sum(CASE WHEN pf IS NOT NULL AND pg = gt AND ps IS NOT DISTINCT FROM sys_gt AND f - pf <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY f) - 1 AS err_idx FROM a)
  SELECT meeting_id, CAST(err_idx AS BIGINT) AS err_idx, any_value(gt) AS gt, any_value(sys_gt) AS sys, min(f) AS start, max(f) AS "end" FROM b GROUP BY meeting_id, err_idx""")
def frame_error_intervals(spark, d):
    return D.error_intervals(_mapped(spark, d))


_STRETCHES = """, ja AS (SELECT *, CASE WHEN lag(gt) OVER w IS NOT DISTINCT FROM gt AND lag(sys_gt) OVER w IS NOT DISTINCT FROM sys_gt AND lag(u) OVER w = t THEN 0 ELSE 1 END AS new FROM ms WINDOW w AS (PARTITION BY meeting_id ORDER BY t)),
  jb AS (SELECT *, sum(new) OVER (PARTITION BY meeting_id ORDER BY t) - 1 AS stretch_idx FROM ja),
  js AS (SELECT meeting_id, CAST(stretch_idx AS BIGINT) AS stretch_idx, any_value(gt) AS gt, any_value(sys_gt) AS sys_gt, min(t) AS start, max(u) AS "end" FROM jb GROUP BY meeting_id, stretch_idx)"""


@query("WITH " + _SWEEP + _ASSIGN + _STRETCHES + " SELECT * FROM js")
def timeline(spark, d):
    """The data of a timeline plot: aligned stretches of both sides."""
    return D.joined_stretches(_mapped(spark, d))


@query("WITH " + _SWEEP + _ASSIGN + _STRETCHES + """ SELECT meeting_id, start, "end", gt, sys_gt FROM js WHERE gt IS DISTINCT FROM sys_gt AND "end" - start >= 50""")
def long_errors(spark, d):
    """Stretches of at least half a second on which the two sides disagree."""
    j = D.joined_stretches(_mapped(spark, d))
    return j.where(~F.col("gt").eqNullSafe(F.col("sys_gt")) & (F.col("end") - F.col("start") >= 50)).select("meeting_id", "start", "end", "gt", "sys_gt")
