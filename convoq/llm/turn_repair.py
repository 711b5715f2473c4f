"""Repair of conversations whose turns are blank, repeated, cut off or in the wrong order.

A conversation is right if the initials of its roles read (s?(ua)+)?: nothing, or an optional system
turn and then user and assistant in turn. Edits and their costs: Keep 0, Rerole to user or assistant 2,
Delete 3, Insert an empty user or assistant turn 2; a truncated turn that stays adds 1, blank and
repeated turns must go. The cheapest edits are found by dynamic programming over four states (nothing
yet, after system, after user, after assistant), time-major: conversations of a bucket of lengths are
columns of one tensor, and each step updates the costs of all of them. Costs are computed from the
last turn back and kept; edits are then traced forward for all conversations at once, the
ASCII-least edit that keeps the least cost first, which gives the ASCII-least audit.

Rows are sorted by range, so a conversation of any length is spread over tasks. One that lies within
a task's rows and SEGMENT rows is solved there. Others are cut into segments: a segment's cost from
each state to each state is a 4 x 4 matrix; the few matrices of a conversation are multiplied from the
last back, which gives each segment its costs at the end, and its start state follows from the front.
Only matrices and states (one row for up to SEGMENT turns) pass one task per conversation, as a
stream.

Defined cases: a null role or text is one space, null turns come first, a null conv_id is a
conversation like any other. Rows of one turn come by role, then by the text's MD5; rows that agree in
all are interchangeable. A role's initial is its first character; an empty role has none and is never
legal. `alive` = false marks a row that is not there any more: it only names its conversation.
An empty table gives an empty result; extra columns are not read. Very long texts make shorter segments.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoq.llm.common import joined_unique, written
from convoq.shipping import ship

#: Rows and bytes of text of a segment; turns of a tensor.
SEGMENT, SEGMENT_BYTES, TENSOR = 1024, 4 << 20, 1 << 17
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: States are nothing, s, u, a. The state that an inserted or reroled turn leads to; that a kept turn of u, a, s or another role leads to (4: none).
_NEXT = np.array([2, 2, 3, 2])
_KEPT = np.array([[2, 2, 4, 2], [4, 4, 3, 4], [1, 4, 4, 4], [4, 4, 4, 4]])
_CODE = {"u": 0, "a": 1, "s": 2}
_NAME = {2: "user", 3: "assistant"}
_NEVER = 1 << 60
_END = np.array([0, _NEVER, _NEVER, 0])
_SPACE = " \t\n\x0b\x0c\r"

_KEY = ["turn", "role", "digest", "uid"]
_ROW = "struct<turn: long, role: string, text: string, uid: long>"
_STATS = "blank long, duplicate long, truncated long, illegal long, cost long, first_turn long, last_turn long, n_turns long, first_initial string, last_initial string"
_SEGMENT_COLUMNS = "conv_id long, turn long, role string, digest string, uid long"
_SOLVED = f"{_SEGMENT_COLUMNS}, whole boolean, audit string, messages array<struct<role: string, text: string>>, {_STATS}"
_CUT = f"{_SOLVED}, rows array<{_ROW}>"
_STAT_NAMES = [x.split()[0] for x in _STATS.split(", ")]


# The dynamic program ------------------------------------------------------------------------------------------------


class Turns:
    """What the program needs of one segment: role codes, which turns must go, which are truncated."""

    def __init__(self, rows: list[tuple], repeated: set[int] | None = None):
        self.role, self.gone, self.cut = np.full(len(rows), 3, np.int8), np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        seen, self.counts = set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for i, (_, role, text, _) in enumerate(rows):
            self.role[i] = _CODE.get(role[:1], 3)
            core = text.strip(_SPACE)
            again = (role, text) in seen if repeated is None else i in repeated
            fault = "blank" if not core else "duplicate" if again else "truncated" if core[-1] not in ".!?" else None
            if repeated is None:
                seen.add((role, text))
            if fault:
                self.counts[fault] += 1
                self.gone[i], self.cut[i] = fault != "truncated", fault == "truncated"


def _relaxed(cost: np.ndarray) -> np.ndarray:
    """Costs by state (second axis) when turns may be inserted first; two inserts reach all that inserts can."""
    for _ in range(2):
        cost = np.minimum(cost, cost[:, _NEXT] + INSERT)
    return cost


def backward(role: np.ndarray, gone: np.ndarray, cut: np.ndarray, there: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(turns + 1, conversations, states, ends): least cost from before a turn, in a state, to each of the ends.

    role, gone, cut, there: (turns, conversations); there is false for the filling after a conversation's last turn.
    end: (conversations, states, ends), the costs after the last turn.
    """
    out = np.empty((len(role) + 1, *end.shape), np.int64)
    out[-1] = _relaxed(end)
    at = np.arange(end.shape[0])[:, None]
    for t in range(len(role) - 1, -1, -1):
        after = out[t + 1]
        never = np.concatenate([after, np.full((len(after), 1, end.shape[2]), _NEVER)], 1)
        stay = np.minimum(never[at, _KEPT[role[t]]] + KEEP, after[:, _NEXT] + REROLE) + (TRUNCATED * cut[t])[:, None, None]
        now = np.minimum(after + DELETE, np.where(gone[t][:, None, None], _NEVER, stay))
        out[t] = np.where(there[t][:, None, None], _relaxed(now), after)
    return out


def trace(costs: np.ndarray, role: np.ndarray, gone: np.ndarray, cut: np.ndarray, there: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, last states): edits is (turns + 1, conversations, 3), two inserts and then the edit of the turn, as ASCII codes or 0."""
    edits, at = np.zeros((*costs.shape[:2], 3), np.uint8), np.arange(costs.shape[1])
    for t in range(len(role) + 1):
        last = t == len(role)
        now = costs[t]
        for k in range(2):
            best = now[at, state]
            if last:
                more = best != end[at, state]
            else:
                more = there[t] & (best != costs[t + 1][at, state] + DELETE) & (best == now[at, _NEXT[state]] + INSERT)
            edits[t, more, k] = ord("I")
            state = np.where(more, _NEXT[state], state)
        if last:
            break
        after, best = costs[t + 1], now[at, state]
        kept = _KEPT[role[t], state]
        drop = best == after[at, state] + DELETE
        keep = ~drop & ~gone[t] & (kept < 4) & (best == after[at, np.minimum(kept, 3)] + KEEP + TRUNCATED * cut[t])
        edits[t, :, 2] = np.where(there[t], np.where(drop, ord("D"), np.where(keep, ord("K"), ord("R"))), 0)
        state = np.where(there[t] & ~drop, np.where(keep, kept, _NEXT[state]), state)
    return edits, state


def buckets(turns: list[Turns]) -> Iterator[tuple[list[int], tuple[np.ndarray, ...]]]:
    """The conversations of one power of two in length at a time, as time-major arrays of bounded size."""
    by = defaultdict(list)
    for i, t in enumerate(turns):
        by[max(0, len(t.role) - 1).bit_length()].append(i)
    for size, which in sorted(by.items()):
        step = max(1, TENSOR >> size)
        for some in (which[x : x + step] for x in range(0, len(which), step)):
            most = max(len(turns[i].role) for i in some)
            role, gone, cut, there = (np.zeros((most, len(some)), kind) for kind in (np.int8, bool, bool, bool))
            for j, i in enumerate(some):
                n = len(turns[i].role)
                role[:n, j], gone[:n, j], cut[:n, j], there[:n, j] = turns[i].role, turns[i].gone, turns[i].cut, True
            yield some, (role, gone, cut, there)


def solved(turns: list[Turns], ends: np.ndarray, starts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(audits, costs, last states) of segments with these costs after them and start states."""
    audits, costs, last = [""] * len(turns), np.zeros(len(turns), np.int64), np.zeros(len(turns), np.int64)
    for some, arrays in buckets(turns):
        back = backward(*arrays, ends[some][:, :, None])[..., 0]
        edits, state = trace(back, *arrays, ends[some], starts[some])
        costs[some] = back[0][np.arange(len(some)), starts[some]] - ends[some][np.arange(len(some)), state]
        last[some] = state
        for j, i in enumerate(some):
            own = edits[:, j].ravel()
            audits[i] = own[own > 0].tobytes().decode()
    return audits, costs, last


def messages(rows: list[tuple], audit: str, state: int) -> list[dict]:
    """The repaired turns."""
    out, i = [], 0
    for edit in audit:
        if edit == "K":
            state = int(_KEPT[_CODE[rows[i][1][0]], state])
            out.append({"role": rows[i][1], "text": rows[i][2]})
        elif edit != "D":
            state = int(_NEXT[state])
            out.append({"role": _NAME[state], "text": rows[i][2] if edit == "R" else ""})
        i += edit != "I"
    return out


def _stats(rows: list[tuple], turns: Turns, cost: int) -> dict:
    known = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return {
        **turns.counts, "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "cost": int(cost),
        "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "n_turns": len(set(known)),
        "first_initial": initials[0] if rows else None, "last_initial": initials[-1] if rows else None,
    }


# Segments in Spark --------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with reproducible faults by crc32("conv_id:turn") % 20, nulls as one space; dropped rows have alive = false."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), how.alias("how"))
    out = out.withColumn("text", F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("how") == 4, "user").otherwise(F.col("role"))).withColumn("alive", F.col("how") != 0)
    return out.withColumn("copy", F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "how")


def _order(*keys: str) -> list[Column]:
    return [F.asc_nulls_first(k) for k in keys]


def _packed(records: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(records, schema=schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _solve(segments: list[tuple[dict, list[tuple]]], turns: list[Turns], ends: np.ndarray, starts: np.ndarray) -> list[dict]:
    audits, costs, _ = solved(turns, ends, starts)
    return [
        {**head, "audit": audit, "messages": messages(rows, audit, int(start)), **_stats(rows, t, cost)}
        for (head, rows), t, audit, cost, start in zip(segments, turns, audits, costs, starts, strict=True)
    ]


def _cut(sorted_rows: DataFrame) -> DataFrame:
    """Conversations that lie within one task, solved; of the others their segments, with rows."""
    schema = _arrow(sorted_rows.sparkSession, _CUT)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple], int, bool]]:
        """(head, rows, bytes, whole): a conversation's rows, in pieces of bounded size."""
        conv, head, rows, size, whole = object(), None, [], 0, False
        for b in batches:
            for c, turn, role, text, digest, uid, alive in zip(*(x.to_pylist() for x in b.columns), strict=True):
                full = head is not None and c == conv and (len(rows) >= SEGMENT or size >= SEGMENT_BYTES)
                if head is None or c != conv or full:
                    if head is not None:
                        yield head, rows, size, whole and not full
                    whole = head is not None and c != conv  # not the first of the task, which may have begun before
                    conv, head, rows, size = c, {"conv_id": c, "turn": turn, "role": role, "digest": digest, "uid": uid}, [], 0
                if alive:
                    rows.append((turn, role, text, uid))
                    size += len(text) + 64
        if head is not None:
            yield head, rows, size, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            turns = [Turns(r) for _, r in held]
            done = _solve(held, turns, np.tile(_END, (len(held), 1)), np.zeros(len(held), np.int64))
            return _packed([d | {"whole": True} for d in done], schema)

        held, n, size = [], 0, 0
        for head, rows, own, whole in pieces(batches):
            if not whole:
                yield _packed([{**head, "whole": False, "rows": [dict(zip(("turn", "role", "text", "uid"), r, strict=True)) for r in rows]}], schema)
                continue
            held.append((head, rows))
            n, size = n + len(rows) + 1, size + own
            if n >= 8 * SEGMENT or size >= SEGMENT_BYTES:
                yield out()
                held, n, size = [], 0, 0
        if held:
            yield out()

    return written(sorted_rows.select("conv_id", "turn", "role", "text", "digest", "uid", "alive").mapInArrow(run, _CUT), "conversations")


def _repeated(parts: DataFrame) -> DataFrame:
    """(segment, repeated): positions in a segment of turns whose role and text its conversation had before."""
    rows = parts.select("conv_id", F.col("uid").alias("segment"), F.posexplode("rows").alias("pos", "r"))
    rows = rows.select("segment", "pos", F.col("r.turn").alias("turn"), F.col("r.uid").alias("uid"), F.md5(F.to_json(F.struct("conv_id", "r.role", "r.text"))).alias("what"))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "uid")).alias("first")
    groups = written(rows.groupBy("what").agg(first, F.count("*").alias("n")).where("n > 1").select("what", F.col("first.uid").alias("first"), "n"), "repeated")
    total = rows.count()
    again = joined_unique(rows, groups, "what", total).where("uid <> first")
    return again.groupBy("segment").agg(F.collect_list("pos").alias("repeated"))


def _streamed(rows: DataFrame, step, first: np.ndarray | int, column: str, out: str, kind: str, back: bool) -> DataFrame:
    """(uid, out): what step carries along each conversation's segments, from the last if back; step gives (carried, out)."""
    order = [F.asc_nulls_first("conv_id"), *[(F.desc_nulls_last(k) if back else F.asc_nulls_first(k)) for k in _KEY]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, carried = object(), first
        for b in batches:
            found = []
            for c, value in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                conv, carried = c, first if c != conv else carried
                carried, given = step(carried, np.array(value, np.int64))
                found.append(given)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found)], ["uid", out])

    dealt = rows.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "uid", column).mapInArrow(run, f"uid long, {out} {kind}")


def _per_segment(segments: DataFrame, f, out: str) -> DataFrame:
    """f(heads, rows, turns, ends, starts) of each batch of segments gives the records of `out`."""
    schema = _arrow(segments.sparkSession, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 8):
                got = b.slice(at, 8).to_pylist()
                rows = [[tuple(r[k] for k in ("turn", "role", "text", "uid")) for r in g.pop("rows")] for g in got]
                turns = [Turns(r, set(g.pop("repeated") or ())) for r, g in zip(rows, got, strict=True)]
                ends = np.array([g.pop("ends", None) or _END for g in got], np.int64) if "ends" in got[0] else None
                starts = np.array([g.pop("start") for g in got], np.int64) if "start" in got[0] else None
                yield _packed(f(got, rows, turns, ends, starts), schema)

    return segments.mapInArrow(run, out)


def _matrices(heads, rows, turns, ends, starts) -> list[dict]:
    out = [None] * len(heads)
    for some, arrays in buckets(turns):
        unit = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, _NEVER), (len(some), 4, 4))
        for i, m in zip(some, backward(*arrays, unit)[0], strict=True):
            out[i] = {**heads[i], "matrix": m.ravel().tolist()}
    return out


def _last_states(heads, rows, turns, ends, starts) -> list[dict]:
    last = np.stack([solved(turns, ends, np.full(len(turns), s))[2] for s in range(4)], 1)
    return [{**h, "lasts": x.tolist()} for h, x in zip(heads, last, strict=True)]


def _final(heads, rows, turns, ends, starts) -> list[dict]:
    return [{**d, "whole": False} for d in _solve(list(zip(heads, rows, strict=True)), turns, ends, starts)]


def repaired(rows: DataFrame) -> DataFrame:
    """A row for each conversation (whole) or segment of one: audit, repaired messages, counts of faults, cost, order keys.

    rows: conv_id, turn, role, text, and alive if some rows are to be taken as dropped.
    """
    spark = rows.sparkSession
    ship(spark)
    alive = F.coalesce(F.col("alive"), F.lit(True)) if "alive" in rows.columns else F.lit(True)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"), alive.alias("alive"))
    rows = rows.withColumn("digest", F.md5("text")).withColumn("uid", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = _cut(rows.repartitionByRange(parts, *_order("conv_id", *_KEY)).sortWithinPartitions(*_order("conv_id", *_KEY)))
    whole, cut = found.where("whole").drop("rows"), found.where("not whole").select("conv_id", *_KEY, "rows")
    segments = written(cut.join(_repeated(cut).withColumnRenamed("segment", "uid"), "uid", "left").select("conv_id", *_KEY, "rows", "repeated"), "segments")
    heads = _SEGMENT_COLUMNS

    def back(after: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, list[int]]:
        return np.minimum(_NEVER, (matrix.reshape(4, 4) + after).min(1)), after.tolist()

    def forth(state: int, lasts: np.ndarray) -> tuple[int, int]:
        return int(lasts[state]), state

    matrices = _per_segment(segments, _matrices, f"{heads}, matrix array<long>")
    ends = written(_streamed(matrices, back, _END, "matrix", "ends", "array<long>", True), "ends")
    with_ends = segments.join(ends, "uid").select("conv_id", *_KEY, "rows", "repeated", "ends")
    lasts = _per_segment(with_ends, _last_states, f"{heads}, lasts array<long>")
    starts = written(_streamed(lasts, forth, 0, "lasts", "start", "long", False), "starts")
    final = _per_segment(with_ends.join(starts, "uid").select("conv_id", *_KEY, "rows", "repeated", "ends", "start"), _final, _SOLVED)
    return whole.unionByName(final)


def report(found: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation.

    The digest of a conversation that has several segments is made of their messages as a stream, in order, in one task:
    SHA-256 has no other way. That task holds one batch of segments.
    """
    faults = ["blank", "duplicate", "truncated", "illegal", "cost"]
    ddl = f"conv_id long, gaps long, {', '.join(f'{c} long' for c in faults)}, audit string, repaired_sha256 string"
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
    whole = found.where("whole").select("conv_id", gaps.alias("gaps"), *faults, "audit", F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"))
    schema = _arrow(found.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = (g for b in batches for at in range(0, b.num_rows, 8) for g in b.slice(at, 8).to_pylist())
        for conv, own in groupby(segments, key=lambda g: g["conv_id"]):
            total, digest, begun, audit = dict.fromkeys(faults, 0), hashlib.sha256(), False, []
            first, last, n, initial = None, None, 0, None
            for g in own:
                for m in g["messages"]:
                    digest.update((("\n" if begun else "") + m["role"] + ":" + m["text"]).encode())
                    begun = True
                audit.append(g["audit"])
                for c in faults:
                    total[c] += g[c]
                if g["first_initial"] is not None:
                    total["illegal"] += initial is not None and initial + g["first_initial"] not in LEGAL
                    initial = g["last_initial"]
                if g["first_turn"] is not None:
                    n += g["n_turns"] - (g["first_turn"] == last)
                    first, last = g["first_turn"] if first is None else first, g["last_turn"]
            out = {"conv_id": conv, "gaps": 0 if first is None else last - first + 1 - n, **total, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            yield _packed([out], schema)

    cut = found.where("not whole").repartition("conv_id").sortWithinPartitions(*_order("conv_id", *_KEY))
    return whole.unionByName(cut.select("conv_id", "messages", "audit", *_STAT_NAMES).mapInArrow(run, ddl))
