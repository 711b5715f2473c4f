"""Queries over texts and names: salvage of generated JSON, time formats, filters, files as text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from convoq import adapters as A
from convoq.functions import text as T
from convoq.sources import xml as X

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


ITEM = "array<struct<start bigint, end bigint, speaker string, text string>>"


def salvage(df, raw: str = "raw"):
    """(keys, item_idx, start, end, speaker, text): items of all JSON arrays in a text; those that lack a value go."""
    arrays = F.regexp_extract_all(F.col(raw), F.lit(r"\[[\s\S]*?\]"), F.lit(0))
    items = F.flatten(F.transform(arrays, lambda a: F.coalesce(F.from_json(a, ITEM), F.array().cast(ITEM))))
    e = df.select(*[c for c in df.columns if c != raw], F.posexplode(items).alias("item_idx", "i"))
    ok = (F.col("i.start") != 0) & (F.col("i.end") != 0) & (F.col("i.speaker") != "") & (F.col("i.text") != "")
    return e.where(F.coalesce(ok, F.lit(False))).select(*[c for c in df.columns if c != raw], F.col("item_idx").cast("long").alias("item_idx"), "i.*")


@query("WITH " + A.UTTERANCES + "," + A.LLM_RAW + r""", a AS (SELECT meeting_id, utt_idx, regexp_extract_all(raw, '\[[^\]]*\]') AS arrays FROM llm_raw),
  e AS (SELECT meeting_id, utt_idx, unnest(arrays) AS j FROM a), f AS (SELECT meeting_id, utt_idx, json_extract(CAST(j AS JSON), '$[0]') AS i FROM e)
  SELECT meeting_id, utt_idx, 0 AS item_idx, CAST(i->>'start' AS BIGINT) AS start, CAST(i->>'end' AS BIGINT) AS "end", i->>'speaker' AS speaker, i->>'text' AS text FROM f WHERE CAST(i->>'start' AS BIGINT) <> 0 AND CAST(i->>'end' AS BIGINT) <> 0 AND i->>'text' <> ''""".replace("0 AS item_idx", "CAST(0 AS BIGINT) AS item_idx"))
def llm_json_salvage(spark, d):
    return salvage(A.llm_raw(spark, d))


@query("WITH " + A.UTTERANCES + "," + A.LLM_RAW + r" SELECT meeting_id, utt_idx, trim(regexp_replace(regexp_replace(trim(raw, chr(10) || chr(9) || ' '), '^```[a-z]*\s*', ''), '\s*```$', ''), chr(10) || chr(9) || ' ') AS body FROM llm_raw")
def clean_fences(spark, d):
    return A.llm_raw(spark, d).select("meeting_id", "utt_idx", T.clean_fences(F.col("raw")).alias("body"))


_HMS = "printf('%02d:%02d:%02d', {s} // 3600, ({s} // 60) % 60, {s} % 60)"


@query("WITH " + A.UTTERANCES + f" SELECT meeting_id, utt_idx, {_HMS.format(s='(start_ms // 1000 * 97)')} AS start, {_HMS.format(s='(end_ms // 1000)')} AS \"end\" FROM utterances")
def hhmmss_format(spark, d):
    u = A.utterances(spark, d)
    return u.select("meeting_id", "utt_idx", T.seconds_to_hms(F.floor(F.col("start_ms") / 1000) * 97).alias("start"), T.seconds_to_hms(F.col("end_ms") / 1000).alias("end"))


@query("WITH " + A.UTTERANCES + """ SELECT meeting_id, utt_idx, CASE utt_idx % 4 WHEN 3 THEN NULL WHEN 2 THEN CAST(start_ms AS DOUBLE) / 1000 WHEN 1 THEN CAST((start_ms // 1000) % 3600 AS DOUBLE) ELSE CAST(start_ms // 1000 AS DOUBLE) END AS seconds FROM utterances""")
def parse_hhmmss(spark, d):
    u = A.utterances(spark, d)
    s = F.floor(F.col("start_ms") / 1000)
    text = F.when(F.col("utt_idx") % 4 == 3, "x:y").when(F.col("utt_idx") % 4 == 2, (F.col("start_ms") / 1000).cast("string")).when(F.col("utt_idx") % 4 == 1, F.format_string("%d:%02d", F.floor(s / 60) % 60, s % 60)).otherwise(T.seconds_to_hms(s))
    return u.select("meeting_id", "utt_idx", T.parse_hms(text).alias("seconds"))


@query("WITH " + A.GT_WORDS + r""" SELECT meeting_id, word_idx, regexp_replace(lower(word), '[^\p{L}\p{N}_\s]', '', 'g') AS plain, trim(regexp_replace(regexp_replace(lower(word), '\s+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g')) AS ascii,
  regexp_full_match(lower(trim(word)), '\p{L}+') AND length(trim(word)) > 1 AND lower(trim(word)) NOT IN ('uh', 'um', 'mm', 'hmm', 'uhh', 'umm') AS meaningful FROM gt_words""")
def word_normalise(spark, d):
    w = F.col("word")
    return A.gt_words(spark, d).select("meeting_id", "word_idx", T.normalize_text(w).alias("plain"), T.normalize(w).alias("ascii"), T.is_meaningful(w).alias("meaningful"))


@query("""WITH o AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, lower(text) ORDER BY turn) AS r FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM o WHERE r = 1)
  SELECT conv_id, turn, text, place FROM f WHERE place <= 6""")
def dedupe_first(spark, d):
    """The first six different texts of a conversation, whatever their case (six is the operator's own limit)."""
    c = A.table(spark, d, "conversations").select("conv_id", "turn", "text")
    r = F.row_number().over(Window.partitionBy("conv_id", F.lower("text")).orderBy("turn"))
    f = c.withColumn("r", r).where("r = 1").withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))
    return f.where("place <= 6").select("conv_id", "turn", "text", "place")


@query("WITH " + A.SEGMENTS + """, u AS (SELECT meeting_id, speaker, start_ms, end_ms, 0 AS priority FROM segments_gt UNION ALL SELECT meeting_id, speaker, start_ms, end_ms, 1 FROM segments_sys UNION ALL SELECT meeting_id, speaker, start_ms, end_ms, 2 FROM segments_gt WHERE seq % 5 = 0)
  SELECT meeting_id, priority, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS dur_ms FROM u GROUP BY ALL""")
def priority_union(spark, d):
    g, s = A.segments_gt(spark, d), A.segments_sys(spark, d)
    tag = lambda df, p: df.select("meeting_id", "speaker", "start_ms", "end_ms", F.lit(p).alias("priority"))
    u = tag(g, 0).unionByName(tag(s, 1)).unionByName(tag(g.where("seq % 5 = 0"), 2))
    return u.groupBy("meeting_id", "priority").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("dur_ms"))


@query("WITH " + A.SEGMENTS_GT + """ SELECT meeting_id, count(*) FILTER (end_ms - start_ms < 700) AS n_skipped, count(*) FILTER (end_ms - start_ms >= 700) AS n_valid, count(*) FILTER (end_ms - start_ms >= 200) AS n_scored FROM segments_gt GROUP BY meeting_id""")
def length_partition(spark, d):
    n = F.col("end_ms") - F.col("start_ms")
    return A.segments_gt(spark, d).groupBy("meeting_id").agg(F.count_if(n < 700).alias("n_skipped"), F.count_if(n >= 700).alias("n_valid"), F.count_if(n >= 200).alias("n_scored"))


@query("WITH " + A.UTTERANCES + r""" SELECT meeting_id, utt_idx, 'utt_' || utt_idx AS utt_id, coalesce(CASE WHEN utt_idx % 4 = 3 THEN NULL ELSE speaker END, 'Unknown Speaker') AS speaker, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, coalesce(CASE WHEN utt_idx % 5 = 4 THEN NULL ELSE start_ms END, 0) AS start_ms FROM utterances""")
def default_projection(spark, d):
    u = A.utterances(spark, d)
    speaker, start = F.when(F.col("utt_idx") % 4 != 3, F.col("speaker")), F.when(F.col("utt_idx") % 5 != 4, F.col("start_ms"))
    return u.select("meeting_id", "utt_idx", F.concat(F.lit("utt_"), "utt_idx").alias("utt_id"), F.coalesce(speaker, F.lit("Unknown Speaker")).alias("speaker"), T.clean_text(F.col("text")).alias("text"), F.coalesce(start, F.lit(0)).cast("long").alias("start_ms"))


@query(r"""SELECT page_id, 'db_' || regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g') AS collection, regexp_replace(regexp_replace(url, '^.*/', ''), '\.[^.]*$', '') AS base, split_part(regexp_replace(url, '^.*/', ''), '.', 1) AS meeting,
  TRY_CAST(nullif(regexp_extract(url, '(\d+)', 1), '') AS INTEGER) AS number, CASE lower('speaker ' || page_id % 6) WHEN 'speaker 1' THEN 'A' WHEN 'speaker 2' THEN 'B' WHEN 'speaker 3' THEN 'C' WHEN 'speaker 4' THEN 'D' ELSE upper('speaker ' || page_id % 6) END AS letter FROM pages""")
def name_functions(spark, d):
    p, u = A.table(spark, d, "pages"), F.col("url")
    name = F.concat(F.lit("speaker "), (F.col("page_id") % 6).cast("string"))
    return p.select("page_id", T.collection_name(u).alias("collection"), T.base_name(u).alias("base"), T.meeting_of(u).alias("meeting"), T.speaker_number(u).alias("number"), T.speaker_letter(name).alias("letter"))


@query("""SELECT page_id, 'words' || page_id AS first_id, 'm.' || chr(CAST(65 + page_id % 4 AS INTEGER)) || '.words' || (page_id + 3) AS last_id, chr(CAST(65 + page_id % 4 AS INTEGER)) AS speaker, CAST(page_id + 3 AS INTEGER) AS last_number FROM pages""")
def href_parse(spark, d):
    letter = F.char(65 + F.col("page_id") % 4)
    href = F.concat(F.lit("m."), letter, F.lit(".words.xml#id(words"), "page_id", F.lit(")..id(m."), letter, F.lit(".words"), (F.col("page_id") + 3).cast("string"), F.lit(")"))
    p = A.table(spark, d, "pages").select("page_id", T.href_ids(href).alias("ids"), T.href_speaker(href).alias("speaker"))
    return p.select("page_id", F.col("ids")[0].alias("first_id"), F.col("ids")[1].alias("last_id"), "speaker", T.word_number(F.col("ids")[1]).alias("last_number"))


@query("WITH " + A.UTTERANCES + """ SELECT meeting_id, utt_idx, CAST(start_ms * 16 AS BIGINT) AS start_sample, CAST((start_ms * 16 + 7) * 1000 // 16000 AS BIGINT) AS start_back, speaker || ': ' || text AS line FROM utterances""")
def sample_times(spark, d):
    u = A.utterances(spark, d)
    s = T.ms_to_samples(F.col("start_ms"))
    return u.select("meeting_id", "utt_idx", s.alias("start_sample"), T.samples_to_ms(s + 7).alias("start_back"), T.said_line(F.col("speaker"), F.col("text")).alias("line"))


#: Words files of all words of each speaker; points and commas become elements of their own.
def words_files(spark, d):
    w = A.gt_words(spark, d, spread=True)
    n = F.row_number().over(Window.partitionBy("meeting_id", "speaker").orderBy("word_idx"))
    w = w.withColumn("n", n)
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    stem, end = F.regexp_replace("word", r"[.,]$", ""), F.regexp_extract("word", r"[.,]$", 0)
    at = lambda c: F.format_string("%d.%03d", F.floor(F.col(c) / 1000), F.col(c) % 1000)
    tag = lambda text, punc: F.concat(F.lit('<w id="'), "n", F.lit('" starttime="'), at("end_ms" if punc else "start_ms"), F.lit('" endtime="'), at("end_ms"), F.lit('" punc="true">' if punc else '">'), esc(text), F.lit("</w>"))
    item = F.concat(F.when(stem != "", tag(stem, False)).otherwise(""), F.when((end != "") & (stem != ""), tag(end, True)).otherwise(""), F.lit('<sil starttime="0" endtime="1"/>'))
    return w.groupBy("meeting_id", "speaker").agg(F.concat(F.lit("<words>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("x")))), lambda s: s["x"]), ""), F.lit("</words>")).alias("xml"))


SPOKEN = r""", fw AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY word_idx) AS n FROM gt_words), spoken AS (SELECT * FROM fw WHERE regexp_replace(word, '[.,]$', '') <> '')"""


@query("WITH " + A.GT_WORDS + SPOKEN + """ SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, speaker, n) - 1 AS place, speaker, round(start_ms / 1000.0, 3) AS start, round(end_ms / 1000.0, 3) AS "end", word FROM spoken""")
def words_xml_scan(spark, d):
    w = X.meeting_words(words_files(spark, d))
    return w.select("meeting_id", "place", "speaker", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "word")


@query("WITH " + A.GT_WORDS + SPOKEN + " SELECT meeting_id, string_agg(word, ' ' ORDER BY speaker, n) AS text FROM spoken GROUP BY meeting_id")
def words_xml_text(spark, d):
    return X.transcript(words_files(spark, d))


_TOPIC_XML = """, tm AS (SELECT DISTINCT meeting_id FROM topic_spans), tk AS (SELECT meeting_id, unnest(range(0, 3)) AS topic_id FROM tm),
  ts AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, topic_id ORDER BY speaker, span_idx) - 1 AS n FROM topic_spans)
  SELECT CAST(meeting_id AS VARCHAR) AS meeting_id, topic_id, 'topic ' || topic_id AS description, coalesce(n, 0) AS span_idx, chr(CAST(65 + CAST(speaker[9:] AS INT) AS INT)) AS speaker, 'words' || s_idx AS first_id, 'words' || e_idx AS last_id
  FROM tk LEFT JOIN ts USING (meeting_id, topic_id)"""


@query("WITH " + A.GT_WORDS + "," + A.TOPIC_SPANS + _TOPIC_XML)
def topic_xml_scan(spark, d):
    """Topics files of all topic spans, read again: topic 1 stands inside topic 0; parents come first."""
    s = A.topic_spans(spark, d)
    letter = F.char(65 + F.substring("speaker", 9, 2).cast("int"))
    href = F.concat(F.lit('<child href="m.'), letter, F.lit(".words.xml#id(words"), "s_idx", F.lit(")..id(words"), "e_idx", F.lit(')"/>'))
    x = s.select("meeting_id", "topic_id", F.struct("speaker", "span_idx", href.alias("x")).alias("c"))
    spans = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("topic_id") == k, F.col("c")))), lambda c: c["x"]), "")
    g = x.groupBy("meeting_id").agg(*[spans(k).alias(f"t{k}") for k in range(3)])
    topic = lambda k, inner: F.concat(F.lit(f'<topic other_description="topic {k}">'), f"t{k}", inner, F.lit("</topic>"))
    return X.topics(g.select("meeting_id", F.concat(F.lit("<root>"), topic(0, topic(1, F.lit(""))), topic(2, F.lit("")), F.lit("<topic/></root>")).alias("xml")))


@query("WITH " + A.UTTERANCES + """ SELECT meeting_id, utt_idx, '[' || start_ms || '-' || end_ms || '] ' || text AS spanned, '[' || start_ms || '-' || end_ms || '] [' || speaker || '] ' || text AS spanned_by, '- ' || text AS bullet, '- [' || speaker || '] ' || text AS bullet_by,
    speaker || ': ' || text AS said, '[' || start_ms || '] ' || speaker || ': ' || text AS line FROM utterances""")
def context_formats(spark, d):
    """The forms in which turns go to a generator."""
    u, start, end, who, text = A.utterances(spark, d), *[F.col(c) for c in ("start_ms", "end_ms", "speaker", "text")]
    return u.select(
        "meeting_id", "utt_idx", T.span_line(start, end, text).alias("spanned"), T.span_line(start, end, text, who).alias("spanned_by"), T.bullet_line(text).alias("bullet"), T.bullet_line(text, who).alias("bullet_by"),
        T.said_line(who, text).alias("said"), T.utterance_line(start.cast("string"), who, text).alias("line"),
    )


@query(r"""SELECT doc_id, CAST(len(list_distinct(list_filter(string_split_regex(text, '\s+'), lambda t: regexp_full_match(t, '[A-Z][a-z]+')))) AS BIGINT) AS n_titles FROM documents""")
def title_entities(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.size(T.title_tokens(F.col("text"))).cast("long").alias("n_titles"))
