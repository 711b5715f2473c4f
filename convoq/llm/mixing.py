"""Mixing sources to target weights by hash-threshold histograms.

A source's target is so many whole copies of it plus a rest. The rest is a set of documents: those
whose hash lies below the source's threshold. The threshold comes from a histogram of sizes by
source and hash bucket: all buckets that fit the rest are taken, and only the bucket on the
boundary is refined by the hash's next bits, level after level. Nothing is sorted, a source's
histogram has at most 2**BITS rows, and sums are combined before each shuffle, so a source that
holds a third of all rows is as good as any other. A row's hash depends on its doc_id, its text and,
among rows of a source that agree in both, on its number: reruns agree, a lower target keeps a subset
of what a higher one keeps, and rows without an id or with a repeated one are taken one by one.

Rows that repeat id and text are numbered in shares of SHARE_ROWS, so a hot one has many tasks.

Defined cases: null text is an empty text, of size 0; null sources are one source, ordered last; of rows
that repeat source, doc_id and text it is not said which are taken, only how many. Sources of size 0
get target 0. A text of any length is one number here. An empty table gives an empty result; extra
columns are not read (`mix`) or pass through (`mixed`), whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoq.llm.common import WORD_REGEX, bounded, dropped, fresh, quoted, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Bits of the hash that a level of refinement looks at, and how many levels there are.
BITS, LEVELS = 12, 5
#: Relative slack under which a computed target counts as one at its limit.
SLACK = 1e-12
#: Repeated rows in a share that one task numbers.
SHARE_ROWS = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def unit_hash(doc_id: Column, text: Column, number: Column) -> Column:
    """BITS * LEVELS bits: the first hexadecimal digits of the MD5 of id, text and number."""
    name = F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))), F.lit(":"), number.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def _hash_of(docs: DataFrame, number: Column) -> Column:
    return unit_hash(docs["doc_id"], docs["text"].cast("string"), number)


def numbered(rows: DataFrame, ties: DataFrame, columns: Sequence[str], row: str, number: str) -> DataFrame:
    """The rows with a tie's columns, in column `number` numbered from 0 within each tie (columns, count).

    rows is a written table whose column `row` differs in all rows. A tie's rows are dealt to shares, which are counted
    first; then each share numbers its own.
    """
    count, share, before = (fresh(rows.columns, c) for c in ("count", "share", "before"))
    there = {c: fresh(rows.columns, f"its_{c}") for c in (*columns, share)}
    t = bounded(ties.toDF(*[there[c] for c in columns], count))
    same = [F.col(c).eqNullSafe(F.col(there[c])) for c in columns]
    dealt = rows.join(t, same).withColumn(share, F.pmod(F.xxhash64(row), F.ceil(F.col(count) / SHARE_ROWS).cast("long"))).drop(*t.columns)
    sizes_ = dealt.groupBy(*columns, share).agg(F.count("*").alias(count))
    upto = F.sum(count).over(Window.partitionBy(*columns).orderBy(share))
    offsets = sizes_.select(*[F.col(c).alias(there[c]) for c in (*columns, share)], (upto - F.col(count)).alias(before))
    place = F.row_number().over(Window.partitionBy(*columns, share).orderBy(row)) - 1
    on = [F.col(c).eqNullSafe(F.col(there[c])) for c in (*columns, share)]
    placed = dealt.withColumn(number, place).join(bounded(offsets), on)
    return placed.select(*[quoted(c) for c in rows.columns], (F.col(number) + F.col(before)).cast("long").alias(number))


def sizes(docs: DataFrame) -> DataFrame:
    """A written table (doc_id, source, size, h0, h) of all rows: h is a row's hash of BITS * LEVELS bits, h0 the hash of the first of its kind."""
    text = docs["text"].cast("string")
    cols = [docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), words(text).alias("size"), _hash_of(docs, F.lit(0)).alias("h0")]
    rows = written(docs.select(*cols, F.md5(F.coalesce(text, F.lit(""))).alias("m"), F.monotonically_increasing_id().alias("row")), "sizes")
    tied = written(ties(rows), "ties")
    plain = rows.select("doc_id", "source", "size", "h0", F.col("h0").alias("h"))
    if not tied.limit(1).count():
        return plain
    again = numbered(rows, tied, ("source", "h0"), "row", "k")
    name = F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("m"), F.lit(":"), F.col("k").cast("string"))
    h = F.conv(F.substring(F.md5(name), 1, BITS * LEVELS // 4), 16, 10).cast("long")
    t = bounded(tied.select(F.col("source").alias("s"), F.col("h0").alias("t")))
    alone = plain.join(t, F.col("source").eqNullSafe(F.col("s")) & (F.col("h0") == F.col("t")), "left_anti")
    out = written(alone.union(again.select("doc_id", "source", "size", "h0", h.alias("h"))), "sizes")
    dropped(rows, tied)
    return out


def ties(rows: DataFrame) -> DataFrame:
    """(source, h0, count) of the hashes that several rows of a source have: their ids and texts are the same."""
    return rows.groupBy("source", "h0").agg(F.count("*").alias("count")).where(F.col("count") > 1)


def targets(by_source: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weights repeat along the sources in code point order, null last. What a source cannot hold (most
    times its size) is shared again by weight among the others until none is above its limit. The
    sources' statistics are what one window orders; documents are not.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = written(by_source.select("source", "source_size", w.alias("weight")), "sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, F.lit(False)
    while total:
        left, weight, n = s.agg(
            F.sum(F.when(full, most * F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.count_if(full)
        ).first()
        if not weight:
            break
        level = max(level, (share * total - left) / weight)
        full = level * F.col("weight") >= most * F.col("source_size") * (1 - SLACK)
        if s.where(full).count() == n:
            break
    target = F.when(full, most * F.col("source_size")).otherwise(level * F.col("weight"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def thresholds(rows: DataFrame, want: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, threshold): documents with h < threshold count once more than copies."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(ratio + SLACK)
    rest = F.greatest(F.lit(0.0), F.col("target") - copies * F.col("source_size"))
    at = written(want.select("*", copies.cast("long").alias("copies"), rest.alias("rest"), F.lit(0).cast("long").alias("threshold")), "budgets")
    for level in range(LEVELS):
        low = BITS * (LEVELS - level - 1)
        size = F.lit(1).cast("long") if level == 0 else None
        edge = bounded(at.where("rest > 0").select("source", "threshold"))
        # Only the bucket on the boundary is looked at again: at level 0 that is the whole source.
        part = rows.select("source", "size", "h", F.shiftright("h", low).alias("bucket"))
        inside = part.alias("r").join(
            edge.alias("e"),
            F.col("r.source").eqNullSafe(F.col("e.source"))
            & (F.lit(True) if size is not None else F.shiftright(F.col("r.h"), low + BITS) == F.shiftright(F.col("e.threshold"), low + BITS)),
        )
        hist = inside.groupBy("r.source", "r.bucket").agg(F.sum("r.size").alias("size"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("size").over(run)).join(at.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        # The first bucket that no longer fits; without one, all of it fits.
        fits = hist.groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "size"))).alias("edge"),
            F.max("bucket").alias("last"), F.sum("size").alias("all"),
        )
        j = at.alias("t").join(fits.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source")), "left")
        new = F.when(F.col("f.edge").isNotNull(), F.shiftleft(F.col("f.edge.bucket"), low)).when(F.col("f.last").isNotNull(), F.shiftleft(F.col("f.last") + 1, low)).otherwise(F.col("t.threshold"))
        left = F.when(F.col("f.edge").isNotNull(), F.col("t.rest") - F.col("f.edge.before")).when(F.col("f.last").isNotNull(), F.lit(0.0)).otherwise(F.col("t.rest"))
        if level == LEVELS - 1:  # one hash is left: it is in if that comes nearer the target
            new = new + F.when(F.col("f.edge").isNotNull() & (2 * left >= F.col("f.edge.size")), 1).otherwise(0)
        at = written(at.alias("t").join(fits.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source")), "left").select(
            "t.source", "t.source_size", "t.target", "t.copies", left.alias("rest"), new.cast("long").alias("threshold")), "budgets")
    return at


def _limit(most: float) -> int:
    """Rows are taken whole, so the limit is a whole number of copies."""
    if most < 1 or most != int(most):
        raise ValueError("most must be a whole number of copies, at least 1")
    return int(most)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row: copies is how often the mix takes it."""
    return _taken(sizes(docs), weights, share, most).drop("h0")


def _taken(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    limit = _limit(most)
    plan = thresholds(rows, targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    plan = bounded(plan.select(F.col("source").alias("s"), "source_size", "target", F.col("copies").alias("whole"), "threshold"))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    extra = F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", F.least(F.col("whole") + extra, F.lit(limit)).cast("long").alias("copies"), "h0", "whole", "threshold")


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, all columns as they are.

    A row that is alone with its id and text is decided where it is read. Rows that others repeat are written first, so
    that they can be numbered.
    """
    limit = _limit(most)
    taken = _taken(sizes(docs), weights, share, most)
    by_source = bounded(written(taken.groupBy("source").agg(F.max("whole").alias("whole"), F.max("threshold").alias("threshold")), "plan"))
    # Of a tie with `count` rows, `more` have one copy more than the others.
    tied = taken.groupBy("source", "h0").agg(F.count("*").alias("count"), F.sum(F.col("copies") - F.least("whole", F.lit(limit))).alias("more")).where(F.col("count") > 1)
    tied = written(tied, "ties")
    s, h, row, k, n, whole, below, t_s, t_h, more = (fresh(docs.columns, c) for c in ("source_name", "hash", "row", "k", "copies", "whole", "below", "tie_source", "tie_hash", "more"))
    out = [F.col(quoted(c)) for c in docs.columns]
    keyed = docs.select(*out, docs["source"].cast("string").alias(s), _hash_of(docs, F.lit(0)).alias(h))
    tie = bounded(tied.select(F.col("source").alias(t_s), F.col("h0").alias(t_h), F.col("more").alias(more)))
    is_tied = F.col(s).eqNullSafe(F.col(t_s)) & (F.col(h) == F.col(t_h))
    plan = by_source.select(F.col("source").alias(t_s), F.col("whole").alias(whole), F.col("threshold").alias(below))

    def copied(rows: DataFrame, extra: Column) -> DataFrame:
        times = F.least(F.col(whole) + F.when(extra, 1).otherwise(0), F.lit(limit)).cast("int")
        rows = rows.join(plan, F.col(s).eqNullSafe(F.col(t_s))).where(times > 0)
        return rows.select(*out, F.explode(F.array_repeat(F.lit(1), times)).alias(n)).select(*out)

    if not tied.limit(1).count():
        return copied(keyed, F.col(h) < F.col(below))
    alone = copied(keyed.join(tie, is_tied, "left_anti"), F.col(h) < F.col(below))
    several = written(keyed.join(tie, is_tied, "left_semi").withColumn(row, F.monotonically_increasing_id()), "repeated")
    several = numbered(several, tied.select("source", "h0", "count"), (s, h), row, k)
    several = several.join(tie, is_tied).drop(t_s, t_h)
    return alone.unionByName(copied(several, F.col(k) < F.col(more)))
