"""Diarization error: confusion, optimal assignment, error rates, detection, issues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from convoq.operators.intervals import frames, overlap_join, overlap_ms, sweep
from convoq.operators.scan import numbered
from convoq.operators.sequence import interval_union
from convoq.scratch import stored


def length() -> Column:
    return F.col("end") - F.col("start")


def aligned(gt: DataFrame, system: DataFrame | None = None, least_ms: int = 200) -> DataFrame:
    """The sweep of both sides' segments in frames; without a system, gt has both sides (see sweep)."""
    return sweep(frames(gt, least_ms), None if system is None else frames(system, least_ms))


def totals(sw: DataFrame) -> DataFrame:
    """A sweep's stretches summed by pair of speakers, as stretches from 0: all counts but runs can be taken from it.

    The sums are stored, so that the sweep is painted once, however often they are read.
    """
    sums = sw.groupBy("meeting_id", "gt", "sys").agg(F.sum(length()).cast("long").alias("end")).select("meeting_id", F.lit(0).cast("long").alias("start"), "end", "gt", "sys")
    return stored(sums, "totals")


def confusion(sw: DataFrame) -> DataFrame:
    """(meeting_id, gt, sys, frames) where both sides speak."""
    return sw.where("gt is not null and sys is not null").groupBy("meeting_id", "gt", "sys").agg(F.sum(length()).cast("long").alias("frames"))


def speakers(sw: DataFrame) -> DataFrame:
    """(meeting_id, side, speaker) of all that are heard in a sweep."""
    pairs = F.explode(F.array(F.struct(F.lit("gt").alias("side"), F.col("gt").alias("speaker")), F.struct(F.lit("sys").alias("side"), F.col("sys").alias("speaker"))))
    return sw.select("meeting_id", pairs.alias("p")).select("meeting_id", "p.*").where("speaker is not null").distinct()


def best_matching(weight: list[list[int]]) -> list[int]:
    """For each row a column, or -1: total weight is largest, and of such matchings the one that is first in
    lexicographic order (no column counts as last). Hungarian algorithm with exact integers.
    """
    n, m = len(weight), len(weight[0]) if weight else 0
    size = max(n, m)
    base = size + 1
    scale = base**n
    cost = [[0] * size for _ in range(size)]
    for i in range(size):
        for j in range(size):
            w = weight[i][j] if i < n and j < m else 0
            cost[i][j] = -w * scale + ((j if j < m else m) * base ** (n - 1 - i) if i < n else 0)
    inf = float("inf")
    u, v, row_of, way = [0] * (size + 1), [0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        row_of[0], j0 = i, 0
        least, used = [inf] * (size + 1), [False] * (size + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = row_of[j0], inf, 0
            for j in range(1, size + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(size + 1):
                if used[j]:
                    u[row_of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0], j0 = row_of[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if 1 <= row_of[j] <= n:
            out[row_of[j] - 1] = j - 1
    return out


def assignment(counts: DataFrame, heard: DataFrame, by: str = "meeting_id", value: str = "frames") -> DataFrame:
    """(by, gt, sys): a one-to-one map between speakers of the two sides with the largest total.

    counts (by, gt, sys, value) may lack pairs, heard (by, side, speaker) names all speakers. A meeting's matrix is
    speakers by speakers, so a group is small however long the meeting is.
    """
    c = counts.select(by, F.lit("pair").alias("side"), "gt", "sys", F.col(value).cast("long").alias("n"))
    s = heard.select(by, "side", F.when(F.col("side") == "gt", F.col("speaker")).alias("gt"), F.when(F.col("side") == "sys", F.col("speaker")).alias("sys"), F.lit(0).cast("long").alias("n"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gts, syss = sorted(pdf.loc[pdf.side == "gt", "gt"]), sorted(pdf.loc[pdf.side == "sys", "sys"])
        n = {(r.gt, r.sys): int(r.n) for r in pdf[pdf.side == "pair"].itertuples()}
        found = best_matching([[n.get((g, x), 0) for x in syss] for g in gts]) if gts and syss else []
        pairs = [(g, syss[j]) for g, j in zip(gts, found, strict=False) if j >= 0]
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(pairs), "gt": [p[0] for p in pairs], "sys": [p[1] for p in pairs]})

    kind = counts.schema[by].dataType.simpleString()
    return c.unionByName(s).groupBy(by).applyInPandas(solve, f"{by} {kind}, gt string, sys string")


def mapped(sw: DataFrame, mapping: DataFrame) -> DataFrame:
    """The sweep with sys_gt: the reference speaker that the system's stands for, null if none."""
    m = mapping.select("meeting_id", F.col("sys"), F.col("gt").alias("sys_gt"))
    return sw.join(m, ["meeting_id", "sys"], "left")


def error_counts(sw: DataFrame, unmapped: str = "miss_fa") -> DataFrame:
    """(meeting_id, missed, false_alarm, confusion, total) in frames of a mapped sweep.

    A system speaker without a partner counts as missed and as false alarm where the reference speaks, or, with
    unmapped='confusion', as confusion.
    """
    both = F.col("gt").isNotNull() & F.col("sys").isNotNull()
    lost = both & F.col("sys_gt").isNull()
    wrong = both & (F.col("sys_gt") != F.col("gt"))
    miss, extra = F.col("gt").isNotNull() & F.col("sys").isNull(), F.col("gt").isNull() & F.col("sys").isNotNull()
    twice = F.lit(unmapped == "miss_fa")
    total = lambda c: F.sum(F.when(c, length()).otherwise(0)).cast("long")
    return sw.groupBy("meeting_id").agg(
        total(miss | (lost & twice)).alias("missed"), total(extra | (lost & twice)).alias("false_alarm"),
        total(wrong | (lost & ~twice)).alias("confusion"), total(F.col("gt").isNotNull()).alias("total"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """counts with der, miss, fa and conf; 0 where the reference is silent throughout."""
    share = lambda c: F.when(F.col("total") > 0, F.round(c / F.col("total"), 6)).otherwise(F.lit(0.0))
    m, f, c = F.col("missed"), F.col("false_alarm"), F.col("confusion")
    return counts.select("*", share(m + f + c).alias("der"), share(m).alias("miss"), share(f).alias("fa"), share(c).alias("conf"))


def der(gt: DataFrame, system: DataFrame | None = None, unmapped: str = "miss_fa") -> DataFrame:
    t = totals(aligned(gt, system))
    return rates(error_counts(mapped(t, assignment(confusion(t), speakers(t))), unmapped))


def detection(gt: DataFrame, system: DataFrame, tolerance: int = 10, frame_ms: int = 10) -> DataFrame:
    """(meeting_id, tp, fn, fp) of speech frames, both sides widened by a tolerance; meetings with one side only get 0."""
    last = gt.select("meeting_id", "end_ms", F.lit(0).alias("side")).union(system.select("meeting_id", "end_ms", F.lit(1).alias("side"))).groupBy("meeting_id").agg(
        (F.expr(f"max(end_ms) div {frame_ms}") + 1).alias("n"), F.countDistinct("side").alias("sides")
    )

    def speech(df: DataFrame) -> DataFrame:
        wide = df.join(last, "meeting_id").select(
            "meeting_id", F.greatest(F.lit(0), F.expr(f"(start_ms - {tolerance}) div {frame_ms}")).alias("start_ms"), F.least(F.col("n"), F.expr(f"(end_ms + {tolerance}) div {frame_ms}")).alias("end_ms")
        )
        return interval_union(wide, "meeting_id", binned=False)

    g, s = speech(gt), speech(system)
    size = lambda df, name: df.groupBy("meeting_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).cast("long").alias(name))
    both = overlap_join(g.select("meeting_id", "start_ms", "end_ms"), s.select("meeting_id", "start_ms", "end_ms"), width=6_000).groupBy("meeting_id").agg(F.sum(overlap_ms()).cast("long").alias("tp"))
    t = last.where("sides = 2").join(both, "meeting_id", "left").join(size(g, "g"), "meeting_id", "left").join(size(s, "s"), "meeting_id", "left")
    tp, n_g, n_s = (F.coalesce(c, F.lit(0).cast("long")) for c in ("tp", "g", "s"))
    counted = t.select("meeting_id", tp.alias("tp"), (n_g - tp).alias("fn"), (n_s - tp).alias("fp"))
    return last.select("meeting_id").join(counted, "meeting_id", "left").select("meeting_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("tp", "fn", "fp")])


def quality(sw: DataFrame) -> DataFrame:
    """(meeting_id, matched, total): frames of the reference on which the mapped system agrees."""
    return sw.groupBy("meeting_id").agg(
        F.sum(F.when(F.col("sys_gt") == F.col("gt"), length()).otherwise(0)).cast("long").alias("matched"), F.sum(F.when(F.col("gt").isNotNull(), length()).otherwise(0)).cast("long").alias("total")
    )


def runs(sw: DataFrame, column: str) -> DataFrame:
    """(meeting_id, run_idx, column, run_length) of a sweep's speakers in frames; silence does not end a run."""
    v = sw.where(F.col(column).isNotNull())
    before = F.lag(column).over(Window.partitionBy("meeting_id").orderBy("start"))
    r = numbered(v, ~F.col(column).eqNullSafe(before), "meeting_id", ["start"], "run_idx", binned=False)
    return r.groupBy("meeting_id", "run_idx", column).agg(F.sum(length()).cast("long").alias("run_length"))


def joined_stretches(sw: DataFrame) -> DataFrame:
    """A mapped sweep with neighbouring stretches put together where both speakers stay: what a timeline shows."""
    w = Window.partitionBy("meeting_id").orderBy("start")
    same = F.lag("gt").over(w).eqNullSafe(F.col("gt")) & F.lag("sys_gt").over(w).eqNullSafe(F.col("sys_gt")) & (F.lag("end").over(w) == F.col("start"))
    n = numbered(sw, ~F.coalesce(same, F.lit(False)), "meeting_id", ["start"], "stretch_idx", binned=False)
    return n.groupBy("meeting_id", "stretch_idx", "gt", "sys_gt").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def issues(sw: DataFrame) -> DataFrame:
    """(meeting_id, issue, label, n): OSCILLATION, MERGE, SPLIT and EMPTY of a mapped sweep.

    One pass: a window finds where runs of either side begin, one aggregation by meeting counts them and gathers the
    pairs of speakers (few, however long the meeting), and the issues are made in the meeting's row.
    """
    before = Window.partitionBy("meeting_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begins = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.last(c, ignorenulls=True).over(before))
    pair = lambda a, b: F.collect_set(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).alias("a"), F.col(b).alias("b"))))
    seen = sw.select("meeting_id", "gt", "sys", "sys_gt", begins("gt").alias("new_gt"), begins("sys_gt").alias("new_sys"))
    m = seen.groupBy("meeting_id").agg(
        F.count_if("new_gt").alias("g"), F.count_if("new_sys").alias("s"), F.count("gt").alias("n_gt"), F.count("sys").alias("n_sys"), pair("sys", "gt").alias("merged"), pair("gt", "sys_gt").alias("split")
    )
    row = lambda kind, label, n: F.struct(F.lit(kind).alias("issue"), label.alias("label"), n.cast("long").alias("n"))

    def several(pairs: str, kind: str) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda p: p["a"]))
        counted = F.transform(names, lambda a: row(kind, a, F.size(F.filter(F.col(pairs), lambda p: p["a"] == a))))
        return F.filter(counted, lambda r: r["n"] > 1)

    none = F.array().cast("array<struct<issue string, label string, n bigint>>")
    one = lambda found, r: F.when(found, F.array(r)).otherwise(none)
    all_ = F.concat(
        one(F.col("s") > F.col("g"), row("OSCILLATION", F.lit(""), F.col("s"))), several("merged", "MERGE"), several("split", "SPLIT"),
        one((F.col("n_gt") == 0) | (F.col("n_sys") == 0), row("EMPTY", F.lit(""), F.lit(0))),
    )
    return m.select("meeting_id", F.explode(all_).alias("i")).select("meeting_id", "i.*")


def observed(counts: DataFrame, name: str = "errors") -> tuple[DataFrame, Observation]:
    """Error counts (missed, false_alarm, confusion, total) with their sums as metrics of whatever action runs on them."""
    o = Observation(name)
    return counts.observe(o, *[F.sum(c).alias(c) for c in ("missed", "false_alarm", "confusion", "total")]), o


def error_intervals(sw: DataFrame, window: int = 5, merge_gap: int = 50) -> DataFrame:
    """(meeting_id, err_idx, start, end, gt, sys): mismatches of a mapped sweep with `window` frames around them.

    Frames near a mismatch (if the reference speaks there) join while both labels stay and no more than merge_gap
    frames lie between. Of the mismatches before and after a stretch only the nearest can reach into it.
    """
    wrong = ~F.col("sys_gt").eqNullSafe(F.col("gt"))
    up, down = (Window.partitionBy("meeting_id").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("start"), F.desc("start")))
    speech = sw.where("gt is not null").select(
        "meeting_id", "start", "end", "gt", F.col("sys_gt").alias("sys"), wrong.alias("wrong"),
        F.max(F.when(wrong, F.col("end") + window)).over(up).alias("upto"), F.min(F.when(wrong, F.col("start") - window)).over(down).alias("since"),
    )
    inside = lambda f, a, b: F.when(F.col(b).isNotNull(), f(a, b)).alias(b)
    speech = speech.select("meeting_id", "start", "end", "gt", "sys", "wrong", inside(F.least, "end", "upto"), inside(F.greatest, "start", "since"))
    piece = lambda a, b: F.struct(F.col(a).alias("s"), F.col(b).alias("e"))
    near = F.when(F.col("wrong") | (F.col("upto") >= F.col("since")), F.array(piece("start", "end"))).otherwise(F.array(piece("start", "upto"), piece("since", "end")))
    part = speech.select("meeting_id", "gt", "sys", F.explode(near).alias("p")).select("meeting_id", "p.s", "p.e", "gt", "sys").where("s < e")
    w = Window.partitionBy("meeting_id").orderBy("s")
    new = ~(F.lag("gt").over(w).eqNullSafe(F.col("gt")) & F.lag("sys").over(w).eqNullSafe(F.col("sys"))) | (F.col("s") - (F.lag("e").over(w) - 1) > merge_gap)
    e = numbered(part, new | (F.row_number().over(w) == 1), "meeting_id", ["s"], "err_idx", binned=False)
    return e.groupBy("meeting_id", "err_idx", "gt", "sys").agg(F.min("s").alias("start"), (F.max("e") - 1).alias("end"))
