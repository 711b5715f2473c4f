"""Runs, gaps, windows and folds over ordered rows of a meeting.

What a row needs from the rows before it comes from `scan`, whose tasks hold a bin of a meeting, never all of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoq.operators.scan import ROWS, WIDTH, crowded, numbered, scan


def _w(partition: str | Sequence[str], *order) -> Window:
    keys = [partition] if isinstance(partition, str) else list(partition)
    return Window.partitionBy(*keys).orderBy(*order)


def joined(text: Column, *order: str) -> Column:
    """Aggregate: text joined by spaces in that order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("__t")))), lambda s: s["__t"]), " ")


def merge_runs(df: DataFrame, partition: str, order: str, key: str, text: str = "text") -> DataFrame:
    """Neighbouring rows with one key become one: first start, last end, texts joined."""
    many = crowded(df, partition)
    before = scan(df, partition, [order], previous={"__key": F.struct(F.col(key).alias("k"))}, width=ROWS, binned=many)
    changed = F.col("__key").isNull() | ~F.col(key).eqNullSafe(F.col("__key.k"))
    runs = numbered(before, changed, partition, [order], "run_idx", ROWS, many).drop("__key")
    return runs.groupBy(partition, "run_idx", key).agg(
        F.min_by("start_ms", order).alias("start_ms"), F.max_by("end_ms", order).alias("end_ms"),
        F.count("*").alias("n_utts"), joined(F.col(text), order).alias("text"),
    )


def gap_segments(df: DataFrame, partition: str, max_gap: int = 500) -> DataFrame:
    """Words in time order become segments while the speaker stays and the gap is at most max_gap."""
    by, many = ["start_ms", "word_idx"], crowded(df, partition)
    d = scan(df, partition, by, previous={"__speaker": F.col("speaker"), "__end": F.col("end_ms")}, binned=many)
    new = F.col("__speaker").isNull() | (F.col("__speaker") != F.col("speaker")) | (F.col("start_ms") - F.col("__end") > max_gap)
    s = numbered(d, new, partition, by, "seg_idx", binned=many)
    order = F.struct("start_ms", "word_idx")
    return s.groupBy(partition, "seg_idx", "speaker").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", order).alias("end_ms"), F.count("*").alias("n_words"),
        joined(F.col("word"), "start_ms", "word_idx").alias("text"),
    )


def silence_chunks(df: DataFrame, partition: str, order: str, min_gap: int = 2000) -> DataFrame:
    """Segments become chunks that end where the gap to the next is at least min_gap."""
    many = crowded(df, partition)
    d = scan(df, partition, ["start_ms", order], previous={"__end": F.col("end_ms")}, binned=many)
    new = F.col("__end").isNull() | (F.col("start_ms") - F.col("__end") >= min_gap)
    c = numbered(d, new, partition, ["start_ms", order], "chunk_idx", binned=many)
    return c.groupBy(partition, "chunk_idx").agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct("start_ms", order)).alias("end_ms"), F.count("*").alias("n_segments"))


def time_windows(df: DataFrame, size: int = 60_000, overlap: int = 2_000) -> DataFrame:
    """Chunks longer than size become windows of that size with stride size - overlap, the last one clipped."""
    stride = size - overlap
    length = F.col("end_ms") - F.col("start_ms")
    last = F.when(length > size, F.ceil((length - size) / stride)).otherwise(0)
    w = df.withColumn("win_idx", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    start = F.col("start_ms") + F.col("win_idx") * stride
    return w.withColumn("win_start", start).withColumn("win_end", F.least(start + size, F.col("end_ms")))


def word_windows(df: DataFrame, words: Column, size: int = 18, stride: int = 12) -> DataFrame:
    """Up to size words are one window; more become windows of size words at each stride (a tail may lie in the one before)."""
    n = F.size(words)
    at = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)))
    w = df.withColumn("__words", words).select("*", F.posexplode(at).alias("win_idx", "__at"))
    return w.withColumn("window", F.slice("__words", F.col("__at") + 1, F.lit(size))).withColumn("win_idx", F.col("win_idx").cast("long")).drop("__words", "__at")


def sub_segments(df: DataFrame, size: int = 300, stride: int = 100, most: int = 20) -> DataFrame:
    """Windows of size at each stride inside a segment; of more than most positions each (n div most)-th stays."""
    s = df.where(F.col("end_ms") - F.col("start_ms") >= size)
    n = F.floor((F.col("end_ms") - F.col("start_ms") - size) / stride) + 1
    step = F.when(n > most, F.floor(n / most)).otherwise(1)
    p = s.withColumn("__step", step.cast("long")).withColumn("__p", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))).where(F.pmod("__p", "__step") == 0)
    start = F.col("start_ms") + F.col("__p") * stride
    return p.withColumn("sub_idx", F.expr("__p div __step")).withColumn("sub_start", start).withColumn("sub_end", start + size).drop("__p", "__step")


def interval_union(df: DataFrame, partition, start: str = "start_ms", end: str = "end_ms", least: int = 0, slack: int = 0, width: int = WIDTH, binned: bool | None = None) -> DataFrame:
    """Intervals longer than 0 and at least `least` long, merged where they touch (or are up to slack apart)."""
    keys = [partition] if isinstance(partition, str) else list(partition)
    d = df.where((F.col(end) > F.col(start)) & (F.col(end) - F.col(start) >= least)) if slack == 0 else df.where(F.col(end) >= F.col(start))
    many = crowded(d, keys) if binned is None else binned
    d = scan(d, keys, [start, end], most={"__before": F.col(end)}, width=width, binned=many)
    m = numbered(d, F.col("__before").isNull() | (F.col(start) > F.col("__before") + slack), keys, [start, end], "union_idx", width, many)
    return m.groupBy(*keys, "union_idx").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_parts"))


def topic_groups(df: DataFrame, partition: str, order: str, max_topics: int = 4, total_ms: int = 90_000) -> DataFrame:
    """A topic number for each row: a new topic where the gap exceeds total_ms / max_topics, up to max_topics of them."""
    many = crowded(df, partition)
    d = scan(df, partition, ["start_ms", order], previous={"__end": F.col("end_ms")}, binned=many)
    far = (F.col("start_ms") - F.col("__end")) * max_topics > total_ms
    d = scan(d, partition, ["start_ms", order], total={"topic_idx": F.when(far, 1).otherwise(0)}, binned=many).drop("__end")
    return d.withColumn("topic_idx", F.least("topic_idx", F.lit(max_topics - 1)).cast("long"))


def assemble_sentences(df: DataFrame, partition: str, order: str = "word_idx") -> DataFrame:
    """Words up to one that ends in . ! or ? are a sentence; what is left at the end is one, too."""
    many = crowded(df, partition)
    d = scan(df, partition, [order], previous={"__ended": F.col("word").rlike(r"[.!?]$")}, width=ROWS, binned=many)
    s = numbered(d, F.coalesce("__ended", F.lit(True)), partition, [order], "sent_idx", ROWS, many)
    return s.groupBy(partition, "sent_idx").agg(
        F.min_by("start_ms", order).alias("start_ms"), F.max_by("end_ms", order).alias("end_ms"), F.count("*").alias("n_words"), joined(F.col("word"), order).alias("text")
    )


def bounded_chunks(df: DataFrame, partition: str, order: str, most: int = 4) -> DataFrame:
    """Rows in chunks of max(1, n div most), of which the first `most` stay."""
    n = F.count("*").over(Window.partitionBy(partition))
    rn = F.row_number().over(_w(partition, order)) - 1
    chunk = F.floor(rn / F.greatest(F.lit(1), F.floor(n / most))).cast("long")
    return df.withColumn("chunk_idx", chunk).where(F.col("chunk_idx") < most)


def batches(df: DataFrame, partition: str, order: str, size: int = 10) -> DataFrame:
    return df.withColumn("batch_idx", F.floor((F.row_number().over(_w(partition, order)) - 1) / size).cast("long"))


def label_runs(df: DataFrame, partition: str, order: str, value: str, length: Column | None = None, width: int = ROWS) -> DataFrame:
    """(partition, run_idx, value, run_length): null values neither count nor end a run; length is a row's weight."""
    v = df.where(F.col(value).isNotNull())
    many = crowded(v, partition)
    d = scan(v, partition, [order], previous={"__value": F.col(value)}, width=width, binned=many)
    r = numbered(d, ~F.col(value).eqNullSafe(F.col("__value")), partition, [order], "run_idx", width, many)
    return r.groupBy(partition, "run_idx", value).agg(F.sum(length if length is not None else F.lit(1)).cast("long").alias("run_length"))


def appearance_labels(df: DataFrame, partition: str, order: str, cluster: str) -> DataFrame:
    """Clusters named SPEAKER_00, SPEAKER_01, ... in order of first appearance."""
    first = F.min(order).over(Window.partitionBy(partition, cluster))
    d = df.withColumn("__first", first)
    return d.withColumn("label", F.format_string("SPEAKER_%02d", F.dense_rank().over(_w(partition, "__first")) - 1)).drop("__first")


def capped_groups(df: DataFrame, partition: str, order: str, max_gap: int = 800, max_length: int = 30_000) -> DataFrame:
    """Neighbours of one speaker join while the gap is at most max_gap and the whole at most max_length.

    A new speaker or a long gap ends a group whatever came before, so these chains are cut by a window. Only within a
    chain does it depend on how long the group has become whether a row joins: a fold over the chain's rows.
    """
    by, many = ["start_ms", order], crowded(df, partition)
    d = scan(df, partition, by, previous={"__speaker": F.col("speaker"), "__end": F.col("end_ms")}, binned=many)
    joins = (F.col("speaker") == F.col("__speaker")) & (F.col("start_ms") - F.col("__end") <= max_gap)
    chains = numbered(d, ~F.coalesce(joins, F.lit(False)), partition, by, "__chain", binned=many).drop("__speaker", "__end")
    group = "struct<s bigint, e bigint, n bigint>"
    state = f"struct<done array<{group}>, now {group}>"

    def fold(acc: Column, x: Column) -> Column:
        now, end = acc["now"], x["end_ms"].cast("long").alias("e")
        fits = x["end_ms"] - now["s"] <= max_length
        new = F.struct(x["start_ms"].cast("long").alias("s"), end, F.lit(1).cast("long").alias("n"))
        more = F.struct(now["s"].alias("s"), end, (now["n"] + 1).alias("n"))
        return (
            F.when(acc.isNull(), F.struct(F.array().cast(f"array<{group}>").alias("done"), new.alias("now")))
            .when(fits, F.struct(acc["done"].alias("done"), more.alias("now")))
            .otherwise(F.struct(F.array_append(acc["done"], now).alias("done"), new.alias("now")))
            .cast(state)
        )

    rows = F.array_sort(F.collect_list(F.struct("start_ms", order, "end_ms")))
    folded = F.aggregate(rows, F.lit(None).cast(state), fold, lambda a: F.array_append(a["done"], a["now"]))
    g = chains.groupBy(partition, "__chain", "speaker").agg(folded.alias("g")).select(partition, "__chain", "speaker", F.posexplode("g").alias("__pos", "g"))
    place = F.row_number().over(_w(partition, "__chain", "__pos")) - 1
    return g.select(partition, place.cast("long").alias("group_idx"), "speaker", F.col("g.s").alias("start_ms"), F.col("g.e").alias("end_ms"), F.col("g.n").alias("n_parts"))


def merge_overlapping(spans: Column, overlap: int = 6) -> Column:
    """An array of word arrays as one: each but the first adds what follows its common start with the last `overlap` words."""

    def fold(acc: Column, words: Column) -> Column:
        tail = F.when(F.size(acc) >= overlap, F.slice(acc, -overlap, overlap)).otherwise(acc)
        most = F.least(F.size(tail), F.size(words))
        same = F.aggregate(
            F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0),
            lambda k, i: F.when((i <= most) & (k == i - 1) & (F.try_element_at(tail, i) == F.try_element_at(words, i)), k + 1).otherwise(k),
        )
        return F.concat(acc, F.slice(words, same + 1, F.greatest(F.size(words), F.lit(1))))

    empty = F.array().cast("array<string>")
    return F.when(F.size(spans) > 0, F.aggregate(F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))), F.coalesce(F.try_element_at(spans, F.lit(1)), empty), fold)).otherwise(empty)
