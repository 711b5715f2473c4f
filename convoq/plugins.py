"""Extension points for models, each with a deterministic default that needs none.

A plug-in is a callable on DataFrames or columns. Speech detection, recognition and embedding have no default: they
take audio, which the tables do not hold.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoq.functions.text import bag_cosine, overlap_ratio, tokenize

#: Texts of a group that are compared with each other in its row.
GATHERED = 256


class SimilarityScorer(Protocol):
    """Similarity of two texts, as a column from 0 to 1."""

    def __call__(self, a: Column, b: Column) -> Column: ...


class TextGenerator(Protocol):
    """Rows (by, order, text, question) to (by, best, answer)."""

    def __call__(self, rows: DataFrame, by: str, order: str, k: int) -> DataFrame: ...


class Rewriter(Protocol):
    """A question and the talk before it to a question that stands alone."""

    def __call__(self, question: Column, history: Column) -> Column: ...


class SegmentDetector(Protocol):
    """Audio files (path, content) to segments (meeting_id, seq, start_ms, end_ms)."""

    def __call__(self, files: DataFrame) -> DataFrame: ...


class SegmentEmbedder(Protocol):
    """Audio files and segments to vectors (meeting_id, seq, embedding)."""

    def __call__(self, files: DataFrame, segments: DataFrame) -> DataFrame: ...


class Transcriber(Protocol):
    """Audio files and chunks to words (meeting_id, word_idx, start_ms, end_ms, word)."""

    def __call__(self, files: DataFrame, chunks: DataFrame) -> DataFrame: ...


def lexical_similarity(a: Column, b: Column) -> Column:
    """Default embedder and similarity: cosine of binary token bags."""
    return bag_cosine(tokenize(a), tokenize(b))


def lexical_reranker(query: Column, text: Column) -> Column:
    """Default reranker: share of the query's tokens that the text has."""
    return overlap_ratio(tokenize(query), tokenize(text))


def extractive(rows: DataFrame, by: str, order: str, k: int = 2, scorer: SimilarityScorer = lexical_reranker) -> DataFrame:
    """Default generator: the k rows whose text scores highest against the question, ties in order."""
    s = rows.withColumn("score", scorer(F.col("question"), F.col("text")))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), order))).where(F.col("rank") <= k)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n")
    return r.groupBy(by).agg(F.round(F.max("score"), 6).alias("best"), text.alias("answer"))


def summaries(rows: DataFrame, by: list[str], order: str, k: int = 2) -> DataFrame:
    """Default summary of each group of texts: the k whose tokens are most common in the group, in order.

    by: meeting and speaker for speakers' summaries, meeting and topic for topics', the meeting alone for its own. A
    text's worth is the mean number of the group's texts that hold its distinct tokens, ties to the first; groups
    without a token have an empty summary. A group of up to GATHERED texts is weighed in its row, a larger one (counted)
    by rows of tokens.
    """
    large = rows.groupBy(*by).count().where(F.col("count") > GATHERED).drop("count")
    if large.isEmpty():
        return _summaries_in_row(rows, by, order, k)
    large = F.broadcast(large)  # a group of more than GATHERED texts each
    return _summaries_in_row(rows.join(large, by, "left_anti"), by, order, k).union(_summaries_by_token(rows.join(large, by, "left_semi"), by, order, k))


def _summaries_by_token(rows: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """By a row a token, which sorts with spilling however large a group is."""
    t = rows.select(*by, order, "text", F.explode_outer(F.array_distinct(tokenize(F.col("text")))).alias("token"))
    held = t.withColumn("held", F.when(F.col("token").isNotNull(), F.count("*").over(Window.partitionBy(*by, "token"))))
    worth = held.groupBy(*by, order, "text").agg(F.round(F.coalesce(F.avg("held"), F.lit(0.0)), 6).alias("worth"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("worth"), order))
    kept = worth.withColumn("r", first).where((F.col("r") <= k))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("worth") > 0, F.struct(order, "text")))), lambda x: x["text"]), " ")
    return kept.groupBy(*by).agg(F.count_if(F.col("worth") > 0).alias("n"), text.alias("summary"))


def _summaries_in_row(rows: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """By a row a group: what a text's tokens are held by is what it shares with each text, itself included."""
    bag = F.coalesce(F.transform(F.array_distinct(tokenize(F.col("text"))), lambda t: F.xxhash64(t)), F.array().cast("array<long>"))
    g = rows.groupBy(*by).agg(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"), bag.alias("b"))).alias("all"))
    held = lambda x: F.aggregate("all", F.lit(0).cast("long"), lambda s, y: s + F.size(F.array_intersect(x["b"], y["b"])))
    worth = lambda x: F.when(F.size(x["b"]) > 0, F.round(held(x) / F.size(x["b"]), 6)).otherwise(F.lit(0.0))
    weighed = F.array_distinct(F.transform("all", lambda x: F.struct((-worth(x)).alias("w"), x["o"].alias("o"), x["t"].alias("t"))))
    g = g.select(*by, F.filter(F.slice(F.array_sort(weighed), 1, k), lambda x: x["w"] < 0).alias("best"))
    text = F.array_join(F.transform(F.array_sort(F.transform("best", lambda x: F.struct(x["o"], x["t"].alias("t")))), lambda x: x["t"]), " ")
    return g.select(*by, F.size("best").cast("long").alias("n"), text.alias("summary"))


def repair_boundaries(df: DataFrame, partition: str, order: str, most_words: int = 3) -> DataFrame:
    """Default repair of speaker changes in mid-sentence: up to most_words words after the last end of a sentence go to
    the next segment of another speaker, if that starts in lower case (a sentence that goes on).
    """
    w = Window.partitionBy(partition).orderBy(order)
    tail = F.regexp_extract("text", r"[.!?]\s+([^.!?]+)$", 1)
    moves = (F.lead("speaker").over(w) != F.col("speaker")) & F.lead("text").over(w).rlike(r"^[a-z]") & (tail != "") & (F.size(F.split(tail, r"\s+")) <= most_words)
    t = df.withColumn("__tail", F.when(moves, tail).otherwise("")).withColumn("__from", F.coalesce(F.lag("__tail").over(w), F.lit("")))
    own = F.when(F.col("__tail") != "", F.rtrim(F.expr("left(text, length(text) - length(__tail))"))).otherwise(F.col("text"))
    return t.withColumn("text", F.when(F.col("__from") != "", F.concat_ws(" ", "__from", own)).otherwise(own)).drop("__tail", "__from")


#: Words that point at what was said before (fixed values of the default rewriter).
POINTING = ("it", "its", "that", "this", "they", "them", "their", "those", "these", "he", "she", "him", "her", "his", "there")


def standalone_question(question: Column, history: Column) -> Column:
    """Default rewriter: a question with a pointing word gets the last line of the history in front of it."""
    points = F.arrays_overlap(tokenize(question), F.array(*[F.lit(p) for p in POINTING]))
    last = F.element_at(F.split(history, "\n"), -1)
    return F.when(points & (F.coalesce(last, F.lit("")) != ""), F.concat(last, F.lit(" "), question)).otherwise(question)


def sufficient(question: Column, context: Column, least: float = 0.5) -> Column:
    """Default judge: whether the context has at least that share of the question's tokens."""
    return overlap_ratio(tokenize(question), tokenize(context)) >= least
