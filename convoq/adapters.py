"""Domain tables made from the driver's tables, by integer arithmetic on keys, and the same as DuckDB SQL.

Times are milliseconds, orders are explicit columns, silence is null. Each function takes (spark, sf_dir);
the SQL text of a table is a list of common table expressions to put after WITH.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Six-hour buckets of events are meetings.
BUCKET_US = 21_600_000_000
TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(text):
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def utterances(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """(meeting_id, utt_idx, speaker, text, n_tok, start_ms, end_ms): every fifth turn or so is cut to two words.

    spread: as many tasks as a shuffle has, for what makes many rows of each turn: small partitions stay apart.
    """
    c = table(spark, sf_dir, "conversations")
    short = (F.col("conv_id") * 3 + F.col("turn")) % 5 == 0
    t = tokens("text")
    rows = c.select(
        F.col("conv_id").alias("meeting_id"), F.col("turn").alias("utt_idx"),
        F.concat(F.lit("Speaker "), F.expr("(conv_id + turn div 2) % 3").cast("string")).alias("speaker"),
        F.when(short, F.array_join(F.slice(t, 1, 2), " ")).otherwise(F.col("text")).alias("text"),
        F.when(short, F.least(F.size(t), F.lit(2))).otherwise(F.size(t)).cast("long").alias("n_tok"),
        (100 * ((F.col("conv_id") * 7 + F.col("turn") * 13) % 40) + F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, 30000).otherwise(0)).cast("long").alias("gap"),
    )
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "meeting_id") if spread else rows
    upto = F.sum(F.col("gap") + 400 * F.col("n_tok")).over(Window.partitionBy("meeting_id").orderBy("utt_idx"))
    return rows.select("meeting_id", "utt_idx", "speaker", "text", "n_tok", (upto - 400 * F.col("n_tok")).alias("start_ms"), upto.alias("end_ms"))


UTTERANCES = r"""
u0 AS (SELECT conv_id AS meeting_id, turn AS utt_idx, 'Speaker ' || ((conv_id + turn // 2) % 3) AS speaker, regexp_extract_all(text, '\S+') AS toks, text,
  (conv_id * 3 + turn) % 5 = 0 AS short, 100 * ((conv_id * 7 + turn * 13) % 40) + CASE WHEN (conv_id + turn) % 3 = 0 THEN 30000 ELSE 0 END AS gap FROM conversations),
u1 AS (SELECT meeting_id, utt_idx, speaker, CASE WHEN short THEN array_to_string(toks[1:2], ' ') ELSE text END AS text,
  CAST(CASE WHEN short THEN least(len(toks), 2) ELSE len(toks) END AS BIGINT) AS n_tok, gap FROM u0),
u2 AS (SELECT *, CAST(sum(gap + 400 * n_tok) OVER (PARTITION BY meeting_id ORDER BY utt_idx) AS BIGINT) AS upto FROM u1),
utterances AS (SELECT meeting_id, utt_idx, speaker, text, n_tok, upto - 400 * n_tok AS start_ms, upto AS end_ms FROM u2)"""


def gt_words(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """(meeting_id, word_idx, utt_idx, speaker, start_ms, end_ms, word): 400 ms a word."""
    w = utterances(spark, sf_dir, spread).select("meeting_id", "utt_idx", "speaker", "start_ms", F.posexplode(tokens("text")).alias("pos", "word"))
    at = F.col("start_ms") + 400 * F.col("pos")
    idx = F.row_number().over(Window.partitionBy("meeting_id").orderBy("utt_idx", "pos")) - 1
    return w.select("meeting_id", idx.cast("long").alias("word_idx"), "utt_idx", "speaker", at.alias("start_ms"), (at + 400).alias("end_ms"), "word")


GT_WORDS = UTTERANCES + r""",
w0 AS (SELECT meeting_id, utt_idx, speaker, start_ms, regexp_extract_all(text, '\S+') AS toks FROM utterances),
w1 AS (SELECT meeting_id, utt_idx, speaker, start_ms, unnest(toks) AS word, generate_subscripts(toks, 1) - 1 AS pos FROM w0),
gt_words AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY utt_idx, pos) - 1 AS word_idx, utt_idx, speaker,
  start_ms + 400 * pos AS start_ms, start_ms + 400 * pos + 400 AS end_ms, word FROM w1)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(table(spark, sf_dir, "events"))


def events_of(events: DataFrame) -> DataFrame:
    """(event_id, event_type, us, dur, meeting_id, start_ms, kind) of a table or a stream of events."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    e = events.select("event_id", "event_type", us.alias("us"), F.round(F.col("value") * 1000).cast("long").alias("dur"))
    kind = sum(F.when(F.col("event_type") == t, i).otherwise(0) for i, t in enumerate(TYPES))
    return e.select("event_id", "event_type", "us", "dur", F.expr(f"us div {BUCKET_US}").alias("meeting_id"), F.expr(f"(us % {BUCKET_US}) div 1000").alias("start_ms"), kind.alias("kind"))


_EVENTS = f"""
e0 AS (SELECT event_id, event_type, epoch_us(ts) AS us, CAST(round(value * 1000) AS BIGINT) AS dur FROM events),
e1 AS (SELECT *, us // {BUCKET_US} AS meeting_id, (us % {BUCKET_US}) // 1000 AS start_ms,
  CASE event_type {' '.join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES))} END AS kind FROM e0)"""


def segments_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, seq, speaker, start_ms, end_ms): events as reference segments."""
    seq = F.row_number().over(Window.partitionBy("meeting_id").orderBy("us", "event_id")) - 1
    return _events(spark, sf_dir).select("meeting_id", seq.cast("long").alias("seq"), F.col("event_type").alias("speaker"), "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"))


SEGMENTS_GT = _EVENTS + """,
segments_gt AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY us, event_id) - 1 AS seq, event_type AS speaker, start_ms, start_ms + dur AS end_ms FROM e1)"""


def segments_sys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same segments as a system might find them: some lost, all shifted, some mislabelled, some false."""
    e = _events(spark, sf_dir)
    speaker = F.concat(F.lit("S"), ((F.col("kind") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)) % 5).cast("string"))
    shift = ((F.col("event_id") * 37) % 41 - 20) * 25
    found = e.where("event_id % 11 <> 0").select("meeting_id", "event_id", F.lit(0).alias("extra"), speaker.alias("speaker"), "dur", F.greatest(F.lit(0), F.col("start_ms") + shift).alias("start_ms"))
    false = e.where("event_id % 13 = 0").select("meeting_id", "event_id", F.lit(1).alias("extra"), speaker.alias("speaker"), "dur", (F.col("start_ms") + 120000).alias("start_ms"))
    seq = F.row_number().over(Window.partitionBy("meeting_id").orderBy("start_ms", "event_id", "extra")) - 1
    return found.union(false).select("meeting_id", seq.cast("long").alias("seq"), "speaker", "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"))


SEGMENTS_SYS = """
s0 AS (SELECT meeting_id, event_id, 0 AS extra, kind, dur, greatest(0, start_ms + ((event_id * 37) % 41 - 20) * 25) AS start_ms FROM e1 WHERE event_id % 11 <> 0
  UNION ALL SELECT meeting_id, event_id, 1, kind, dur, start_ms + 120000 FROM e1 WHERE event_id % 13 = 0),
segments_sys AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, event_id, extra) - 1 AS seq,
  'S' || ((kind + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) % 5) AS speaker, start_ms, start_ms + dur AS end_ms FROM s0)"""

SEGMENTS = SEGMENTS_GT + "," + SEGMENTS_SYS


def packed(events: DataFrame) -> DataFrame:
    """(meeting_id, event_id, packed, rest): time within the meeting, duration and type of an event in one number, which
    takes less of a shuffle. Other types, nulls, times before 1970 and durations from 2**25 ms on stay as they are, in rest.
    """
    kind = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1
    fits = (F.col("us") >= 0) & F.col("dur").between(0, (1 << 25) - 1) & (kind >= 0)
    number = F.when(fits, F.expr(f"us % {BUCKET_US}") * (1 << 28) + F.col("dur") * 8 + kind)
    return events.select("meeting_id", "event_id", number.alias("packed"), F.when(number.isNull(), F.struct("event_type", "us", "dur")).alias("rest"))


def unpacked(events: DataFrame) -> DataFrame:
    """(meeting_id, event_id, event_type, us, dur) of packed events."""
    n = F.col("packed")
    us = F.col("meeting_id") * BUCKET_US + F.shiftright(n, 28)
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (n.bitwiseAND(F.lit(7)) + 1).cast("int"))
    own = {"event_type": kind, "us": us, "dur": F.shiftright(n, 3).bitwiseAND(F.lit((1 << 25) - 1))}
    return events.select("meeting_id", "event_id", *[F.when(n.isNotNull(), c).otherwise(F.col(f"rest.{name}")).alias(name) for name, c in own.items()])


def segment_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, side, seq, speaker, start_ms, end_ms): segments_gt as side 0 and segments_sys as side 1.

    Events are dealt by meeting once, packed, and both sides are made of what has come; seq is a struct that orders a
    side's segments as their numbers do.
    """
    e = unpacked(packed(_events(spark, sf_dir)).repartition("meeting_id"))
    start, end, kind = F.expr(f"(us % {BUCKET_US}) div 1000"), F.col("dur"), sum(F.when(F.col("event_type") == t, i).otherwise(0) for i, t in enumerate(TYPES))
    wrong = F.concat(F.lit("S"), ((kind + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)) % 5).cast("string"))
    moved, false = F.greatest(F.lit(0).cast("long"), start + ((F.col("event_id") * 37) % 41 - 20) * 25), start + 120000
    one = lambda side, at, extra, speaker, s: F.struct(
        F.lit(side).alias("side"), F.struct(at.alias("at"), F.coalesce("event_id", F.lit(-1 << 63)).alias("id"), F.lit(extra).alias("extra")).alias("seq"), speaker.alias("speaker"), s.alias("start_ms"), (s + end).alias("end_ms")
    )
    all_ = F.array(
        one(0, F.col("us"), 0, F.col("event_type"), start), F.when(F.col("event_id") % 11 != 0, one(1, moved, 0, wrong, moved)), F.when(F.col("event_id") % 13 == 0, one(1, false, 1, wrong, false))
    )
    return e.select("meeting_id", F.explode(all_).alias("x")).where("x is not null").select("meeting_id", "x.*")


def asr_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, seq, speaker, start_ms, end_ms, text): filtered turns in runs, each third run under another name."""
    from convoq.operators.sequence import merge_runs

    runs = merge_runs(utterances(spark, sf_dir).where("n_tok >= 3"), "meeting_id", "utt_idx", "speaker")
    other = F.concat(F.lit("Speaker "), ((F.substring("speaker", 9, 2).cast("int") + F.when(F.col("run_idx") % 3 == 0, 1).otherwise(0)) % 3).cast("string"))
    return runs.select("meeting_id", F.col("run_idx").alias("seq"), other.alias("speaker"), "start_ms", "end_ms", "text")


RUNS = """
r0 AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY meeting_id ORDER BY utt_idx) THEN 0 ELSE 1 END AS new FROM utterances WHERE n_tok >= 3),
r1 AS (SELECT *, sum(new) OVER (PARTITION BY meeting_id ORDER BY utt_idx) - 1 AS run_idx FROM r0),
runs AS (SELECT meeting_id, CAST(run_idx AS BIGINT) AS run_idx, any_value(speaker) AS speaker, arg_min(start_ms, utt_idx) AS start_ms, arg_max(end_ms, utt_idx) AS end_ms,
  count(*) AS n_utts, string_agg(text, ' ' ORDER BY utt_idx) AS text FROM r1 GROUP BY meeting_id, run_idx)"""
ASR_SEGMENTS = RUNS + """,
asr_segments AS (SELECT meeting_id, run_idx AS seq, 'Speaker ' || ((CAST(speaker[9:] AS INT) + CASE WHEN run_idx % 3 = 0 THEN 1 ELSE 0 END) % 3) AS speaker, start_ms, end_ms, text FROM runs)"""


def _parts(text: str):
    """Sentences of a text: split at their ends, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.col(text), r"[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def gt_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, layer, unit_idx, text): participants' sentences, topics' texts, first sentences of turns."""
    from convoq.operators.sequence import joined, topic_groups

    u = utterances(spark, sf_dir)
    each = u.select("meeting_id", "utt_idx", F.posexplode(_parts("text")).alias("sent_idx", "sentence"))
    number = lambda df, layer: df.select("meeting_id", F.lit(layer).alias("layer"), (F.row_number().over(Window.partitionBy("meeting_id").orderBy("utt_idx", "sent_idx")) - 1).cast("long").alias("unit_idx"), F.col("sentence").alias("text"))
    topic = topic_groups(u, "meeting_id", "utt_idx").groupBy("meeting_id", "topic_idx").agg(joined(F.col("text"), "utt_idx").alias("text"))
    topic = topic.select("meeting_id", F.lit("topic").alias("layer"), F.col("topic_idx").alias("unit_idx"), "text")
    return number(each, "participant").unionByName(topic).unionByName(number(each.where("sent_idx = 0"), "meeting"))


GT_UNITS = r"""
n0 AS (SELECT meeting_id, utt_idx, string_split_regex(text, '[.!?]+') AS parts FROM utterances),
n1 AS (SELECT meeting_id, utt_idx, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM n0),
n2 AS (SELECT meeting_id, utt_idx, pos, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS sentence FROM n1),
n3 AS (SELECT meeting_id, utt_idx, row_number() OVER (PARTITION BY meeting_id, utt_idx ORDER BY pos) - 1 AS sent_idx, sentence FROM n2 WHERE sentence <> ''),
n4 AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms, utt_idx) AS gap FROM utterances),
n5 AS (SELECT meeting_id, utt_idx, text, least(sum(CASE WHEN gap * 4 > 90000 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY start_ms, utt_idx), 3) AS topic_idx FROM n4),
gt_units AS (SELECT meeting_id, 'participant' AS layer, row_number() OVER (PARTITION BY meeting_id ORDER BY utt_idx, sent_idx) - 1 AS unit_idx, sentence AS text FROM n3
  UNION ALL SELECT meeting_id, 'topic', CAST(topic_idx AS BIGINT), string_agg(text, ' ' ORDER BY utt_idx) FROM n5 GROUP BY meeting_id, topic_idx
  UNION ALL SELECT meeting_id, 'meeting', row_number() OVER (PARTITION BY meeting_id ORDER BY utt_idx, sent_idx) - 1, sentence FROM n3 WHERE sent_idx = 0)"""


def pred_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, layer, text_idx, text): every other unit, and the first one of the meeting before."""
    g = gt_units(spark, sf_dir)
    own = g.where("unit_idx % 2 = 1").select("meeting_id", "layer", F.col("unit_idx").alias("text_idx"), "text")
    foreign = g.where("unit_idx = 0").select((F.col("meeting_id") + 1).alias("meeting_id"), "layer", F.lit(1000000).cast("long").alias("text_idx"), "text")
    return own.unionByName(foreign.join(g.where("unit_idx = 0").select("meeting_id", "layer"), ["meeting_id", "layer"], "left_semi"))


PRED_TEXTS = GT_UNITS + """,
pred_texts AS (SELECT meeting_id, layer, unit_idx AS text_idx, text FROM gt_units WHERE unit_idx % 2 = 1
  UNION ALL SELECT meeting_id + 1, layer, 1000000, text FROM gt_units g WHERE unit_idx = 0 AND EXISTS (SELECT 1 FROM gt_units h WHERE h.meeting_id = g.meeting_id + 1 AND h.layer = g.layer))"""


def topic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, topic_id, span_idx, speaker, s_idx, e_idx): overlapping ranges of each speaker's word numbers; some are empty."""
    w = gt_words(spark, sf_dir, spread=True)
    per = w.groupBy("meeting_id", "speaker").agg(F.count("*").alias("n"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 9).cast("long")))
    s = per.select("meeting_id", "speaker", "n", k.alias("k"))
    start = F.col("k") * 8 % F.col("n")
    return s.select("meeting_id", (F.col("k") % 3).alias("topic_id"), F.col("k").alias("span_idx"), "speaker", start.alias("s_idx"), (start + F.when(F.col("k") % 7 == 6, -2).otherwise(5 + F.col("k") % 8)).alias("e_idx"))


TOPIC_SPANS = """
t0 AS (SELECT meeting_id, speaker, count(*) AS n FROM gt_words GROUP BY ALL),
t1 AS (SELECT meeting_id, speaker, n, unnest(range(0, n // 9 + 1)) AS k FROM t0),
topic_spans AS (SELECT meeting_id, k % 3 AS topic_id, k AS span_idx, speaker, k * 8 % n AS s_idx, k * 8 % n + CASE WHEN k % 7 = 6 THEN -2 ELSE 5 + k % 8 END AS e_idx FROM t1)"""


def llm_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting_id, utt_idx, raw): turns as fenced JSON arrays, some without a start, some cut short."""
    u = utterances(spark, sf_dir)
    text = F.regexp_replace(F.col("text"), r"[^A-Za-z0-9 .]", "")
    item = F.concat(F.lit('{"start": '), F.when(F.col("utt_idx") % 4 == 3, "0").otherwise(F.col("start_ms").cast("string")), F.lit(', "end": '), F.col("end_ms").cast("string"), F.lit(', "speaker": "'), F.col("speaker"), F.lit('", "text": "'), text, F.lit('"}'))
    body = F.concat(F.lit("["), item, F.when(F.col("utt_idx") % 5 == 4, "").otherwise("]"))
    return u.select("meeting_id", "utt_idx", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("raw"))


LLM_RAW = r"""
llm_raw AS (SELECT meeting_id, utt_idx, '```json' || chr(10) || '[{"start": ' || CASE WHEN utt_idx % 4 = 3 THEN '0' ELSE CAST(start_ms AS VARCHAR) END || ', "end": ' || end_ms || ', "speaker": "' || speaker
  || '", "text": "' || regexp_replace(text, '[^A-Za-z0-9 .]', '', 'g') || '"}' || CASE WHEN utt_idx % 5 = 4 THEN '' ELSE ']' END || chr(10) || '```' AS raw FROM utterances)"""
