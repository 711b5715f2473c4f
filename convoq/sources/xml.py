"""Annotation XML (words, summaries, topics) to rows. Input is a table of files: keys and the text in column xml."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convoq.functions.text import href_ids, href_speaker, meeting_of

_WORDS = "w array<struct<_id string, _starttime double, _endtime double, _punc string, _VALUE string>>"
_SUMMARY = "sent array<string>, sentence array<string>"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, meeting_id, speaker, xml) of whole files; a name is meeting.speaker.kind.xml."""
    f = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("xml"))
    name = F.regexp_replace("path", r"^.*/", "")
    return f.select(name.alias("file"), meeting_of(F.col("path")).alias("meeting_id"), F.split_part(name, F.lit("."), F.lit(2)).alias("speaker"), "xml")


def _plain_ids(xml: Column) -> Column:
    """The first attribute of a word whose name ends in id (`nite:id`) is called id."""
    return F.regexp_replace(xml, r"(<w\b[^>]*?\s)[\w:.-]*id(\s*=)", "$1id$2")


def word_index(df: DataFrame) -> DataFrame:
    """(meeting_id, speaker, pos, word_id, punc, start, end, word): all words and punctuation of words files in order."""
    x = df.select("meeting_id", "speaker", F.from_xml(_plain_ids(F.col("xml")), _WORDS).alias("x"))
    w = x.select("meeting_id", "speaker", F.posexplode("x.w").alias("pos", "w"))
    w = w.select("meeting_id", "speaker", F.col("pos").cast("long").alias("pos"), F.col("w._id").alias("word_id"), (F.lower(F.coalesce("w._punc", F.lit("false"))) == "true").alias("punc"), F.col("w._starttime").alias("start"), F.col("w._endtime").alias("end"), F.trim("w._VALUE").alias("word"))
    return w.where(F.col("word") != "")


def timed_words(df: DataFrame) -> DataFrame:
    """(meeting_id, speaker, word_idx, start, end, word): timed words, punctuation glued to the word before (which ends no earlier)."""
    w = word_index(df).where("start is not null and end is not null")
    at = F.sum(F.when(~F.col("punc"), 1).otherwise(0)).over(Window.partitionBy("meeting_id", "speaker").orderBy("pos"))
    w = w.withColumn("k", at).where("k > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), "")
    g = w.groupBy("meeting_id", "speaker", "k").agg(F.min_by("start", "pos").alias("start"), F.max("end").alias("end"), text.alias("word"))
    return g.select("meeting_id", "speaker", (F.col("k") - 1).cast("long").alias("word_idx"), "start", "end", "word")


def meeting_words(df: DataFrame) -> DataFrame:
    """All speakers' timed words of a meeting with their place in time."""
    w = timed_words(df)
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("start", "speaker", "word_idx")) - 1
    return w.select("meeting_id", n.cast("long").alias("place"), "speaker", "start", "end", "word")


def transcript(df: DataFrame) -> DataFrame:
    """(meeting_id, text): speakers in order of name, punctuation without a space before it."""
    w = word_index(df)
    piece = F.when(F.col("punc") | (F.row_number().over(Window.partitionBy("meeting_id").orderBy("speaker", "pos")) == 1), F.col("word")).otherwise(F.concat(F.lit(" "), "word"))
    p = w.select("meeting_id", "speaker", "pos", piece.alias("p"))
    return p.groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("speaker", "pos", "p"))), lambda s: s["p"]), "").alias("text"))


def participant_summaries(df: DataFrame) -> DataFrame:
    """(meeting_id, speaker, sent_idx, text): sentences that are neither blank nor a number."""
    s = df.select("meeting_id", "speaker", F.posexplode(F.from_xml("xml", _SUMMARY)["sent"]).alias("sent_idx", "text"))
    return s.select("meeting_id", "speaker", F.col("sent_idx").cast("long").alias("sent_idx"), F.trim("text").alias("text")).where((F.col("text") != "") & ~F.col("text").rlike(r"^\d+$"))


def abstractive_summaries(df: DataFrame) -> DataFrame:
    """(meeting_id, text): sentences of either element joined by spaces; null without any."""
    x = df.select("meeting_id", F.from_xml("xml", _SUMMARY).alias("x"))
    both = F.concat(F.coalesce("x.sentence", F.array().cast("array<string>")), F.coalesce("x.sent", F.array().cast("array<string>")))
    kept = F.filter(F.transform(both, lambda t: F.trim(t)), lambda t: t != "")
    return x.select("meeting_id", F.when(F.size(kept) > 0, F.array_join(kept, " ")).alias("text"))


def topics(df: DataFrame) -> DataFrame:
    """(meeting_id, topic_id, description, span_idx, speaker, first_id, last_id): topics at any depth, parents first.

    The elements nest without bound, so each file is walked by a parser; a file is one meeting's topics.
    """
    import xml.etree.ElementTree as ET

    import pandas as pd

    def walk(batches):
        for pdf in batches:
            rows = []
            for meeting, text in zip(pdf["meeting_id"], pdf["xml"], strict=True):
                n = 0
                stack = [t for t in reversed(list(ET.fromstring(text))) if t.tag.endswith("topic")]
                while stack:
                    t = stack.pop()
                    stack += [c for c in reversed(list(t)) if c.tag.endswith("topic")]
                    hrefs = [c.get("href", "") for c in t if c.tag.endswith("child")]
                    said = t.get("other_description") or ""
                    if said or hrefs:
                        rows += [(meeting, n, said, i, h) for i, h in enumerate(hrefs)] or [(meeting, n, said, 0, None)]
                        n += 1
            yield pd.DataFrame(rows, columns=["meeting_id", "topic_id", "description", "span_idx", "href"])

    t = df.select(F.col("meeting_id").cast("string"), "xml").mapInPandas(walk, "meeting_id string, topic_id long, description string, span_idx long, href string")
    ids = href_ids(F.col("href"))
    return t.select("meeting_id", "topic_id", "description", "span_idx", href_speaker(F.col("href")).alias("speaker"), F.try_element_at(ids, F.lit(1)).alias("first_id"), F.try_element_at(ids, F.lit(-1)).alias("last_id"))

