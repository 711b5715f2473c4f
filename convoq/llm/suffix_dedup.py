"""Suffix-array dedup: bytes covered by a WINDOW-byte string that also starts anywhere else are removed.

Sorting all suffixes of a corpus would move its text many times over, so suffix arrays are built only
where repeats can be:

1. Every window has an anchor value, the least hash among its GRAM-byte substrings. Equal windows have
   equal anchors, so a window can only repeat if its anchor value does. Stretches of windows with one
   anchor value (segments) are told apart by hashes; text stays where it is.
2. Segments whose anchor value occurs once, in them too, are done. A segment that occurs twice as a whole repeats as a
   whole. Only distinct segments that share an anchor value with others need their bytes looked at.
3. Those are dealt out by anchor value and sorted by two-stage suffix sorting: suffixes smaller than
   their successors are sorted directly, the others are induced by a scan over the buckets; common
   prefixes of neighbours then tell which windows are equal. Values with more than PIECE distinct
   segments (the edges of a passage that many documents share) are dealt out in pieces; each piece
   sends one digest for each class of equal windows, and classes that are alone in their piece learn
   from the digests whether another piece has them.
4. The repeated windows of each distinct segment go back to all its occurrences, and each document's
   bytes are cut once.

Results are exact but for collisions of 128 bits of hash. Copies count through sums made before the
shuffle, never as pairs.

Defined cases: null and empty texts have no bytes; texts shorter than WINDOW have no windows and stay;
repeated rows (same doc_id and text) are copies of each other; null doc_ids are documents like any
other; very long texts are hashed CHUNK bytes at a time and cut in segments like any other; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoq.llm.common import dropped, small, written
from convoq.shipping import ship

WINDOW = 200
GRAM = 80
#: Windows in a segment at most, bytes that are hashed at once, distinct segments in a piece, bytes in a suffix array.
SEGMENT, CHUNK, PIECE, ARRAY = 128, 1 << 18, 1024, 1 << 18
_U = np.uint64
_M = 0x9E3779B97F4A7C15
_MI = pow(_M, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """Anchor values of all windows of a text, a chunk at a time."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram, self.wide = window, gram, window - gram + 1
        self.up, self.down = _powers(_M, CHUNK + window), _powers(_MI, CHUNK + window)

    def anchors(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor value, whether the window starts with the substring of that hash) of each window."""
        n = len(text) - self.window + 1
        parts = [self._chunk(text[at : at + CHUNK + self.window - 1]) for at in range(0, n, CHUNK)]
        return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts, strict=True)))

    def _chunk(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros(len(text) + 1, _U)
        np.cumsum(text.astype(_U) * self.down[: len(text)], out=total[1:])
        h = (total[self.gram :] - total[: -self.gram]) * self.up[: len(text) - self.gram + 1]
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
        grams, size = h, 1
        while size * 2 <= self.wide:
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        rest = self.wide - size
        h = np.minimum(h[:-rest], h[rest:]) if rest else h
        return h, grams[: len(h)] == h


def segments(text: np.ndarray, hasher: _Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor value, first window, number of windows, own) of the stretches of windows with one anchor value.

    own: the value's substring occurs more than once in the stretch, so its windows may repeat each other.
    """
    a, at_start = hasher.anchors(text)
    first = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    size = np.diff(np.append(first, len(a)))
    if size.max() > SEGMENT:
        pieces = -(-size // SEGMENT)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, size = np.repeat(first, pieces) + nth * SEGMENT, np.minimum(np.repeat(size, pieces) - nth * SEGMENT, SEGMENT)
    passed = np.concatenate([[0], np.cumsum(at_start)])
    return a[first], first, size, passed[first + size - 1] > passed[first]


# The suffix array ----------------------------------------------------------------------------------------------------


def suffix_order(text: bytes, depth: int = WINDOW) -> np.ndarray:
    """All suffixes in order of their first `depth` bytes, by two-stage sorting."""
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    step = np.append(np.sign(t[1:].astype(np.int16) - t[:-1]), -1)  # the last suffix is larger than its empty successor
    decided = np.where(step != 0, np.arange(n), n)
    small = step[np.minimum.accumulate(decided[::-1])[::-1]] > 0
    at = np.flatnonzero(small)
    direct = np.array(sorted(at.tolist(), key=lambda i: text[i : i + depth]), np.int64)
    count = np.bincount(t, minlength=256)
    end = np.cumsum(count)
    start, head = end - count, end - count
    order = np.full(n, -1, np.int64)
    for c, k in enumerate(np.bincount(t[at], minlength=256).tolist()):
        if k:
            order[end[c] - k : end[c]], direct = direct[:k], direct[k:]
    order[head[t[n - 1]]] = n - 1
    head[t[n - 1]] += 1
    for c in np.flatnonzero(count).tolist():
        low = start[c]
        while low < head[c]:  # runs of one byte
            before = order[low : head[c]] - 1
            low = head[c]
            before = before[before >= 0]
            before = before[(t[before] == c) & ~small[before]]
            order[low : low + len(before)] = before
            head[c] += len(before)
        before = order[start[c] : end[c]] - 1
        before = before[before >= 0]
        before = before[t[before] > c]
        by = np.argsort(t[before], kind="stable")
        before = before[by]
        for d, k in zip(*np.unique(t[before], return_counts=True), strict=True):
            order[head[d] : head[d] + k], before = before[:k], before[k:]
            head[d] += k
    return order


def common_prefixes(text: bytes, order: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Length, up to depth, of the prefix that each suffix in order shares with the one before (the first: 0)."""
    padded = np.frombuffer(text + bytes(depth + 8), np.uint8)
    words = np.zeros(len(padded) - 7, _U)
    for k in range(8):
        words |= padded[k : k + len(words)].astype(_U) << _U(8 * (7 - k))
    out = np.zeros(len(order), np.int64)
    a, b, live = order[:-1], order[1:], np.arange(1, len(order))
    for k in range(0, depth, 8):
        differ = words[a + k] ^ words[b + k]
        same = differ == 0
        gone = ~same
        out[live[gone]] = k + 8 - np.searchsorted(_BYTE, differ[gone], side="right")
        a, b, live = a[same], b[same], live[same]
    out[live] = depth
    return np.minimum(out, depth)


#: 2**(8 k): a difference below the k-th leaves 8 - k bytes alike.
_BYTE = np.array([1 << (8 * k) for k in range(8)], _U)


def equal_windows(parts: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each part, the class of each of its windows; windows have one class if their bytes are equal."""
    text = b"".join(parts)
    size = np.array([len(p) for p in parts])
    first = np.cumsum(size) - size
    valid = np.zeros(len(text), bool)
    for f, s in zip(first.tolist(), size.tolist(), strict=True):
        valid[f : f + max(0, s - window + 1)] = True
    order = suffix_order(text, window)
    order = order[valid[order]]
    classes = np.full(len(text), -1, np.int64)
    if len(order):
        prefix = common_prefixes(text, order, window)
        classes[order] = np.cumsum(prefix < window)
    return [classes[f : f + max(0, s - window + 1)] for f, s in zip(first.tolist(), size.tolist(), strict=True)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, length) of the stretches of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


# The Spark stages ----------------------------------------------------------------------------------------------------

_ANCHORS = "h long, f long, doc_id long, th long, at int, n int, own boolean"
_RUNS = "h long, f long, runs array<struct<s int, l int>>, alone array<struct<d1 long, d2 long, s int, n int>>"


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, digest = _Hasher(window, gram), xxhash.xxh3_64_intdigest
        for b in small(batches):
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for row, text in enumerate(_bytes(b.column(2))):
                if len(text) < window:
                    continue
                h, at, n, own = segments(np.frombuffer(text, np.uint8), hasher)
                view = memoryview(text)
                f = np.array([digest(view[i : i + k + window - 1]) for i, k in zip(at.tolist(), n.tolist(), strict=True)], _U)
                for col, x in zip(cols, (h.view(np.int64), f.view(np.int64), np.full(len(h), row), at, n, own), strict=True):
                    col.append(x)
            h, f, row, at, n, own = (np.concatenate(c) if c else np.empty(0, np.int64) for c in cols)
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(f), b.column(0).take(row), b.column(1).take(row), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(own.astype(bool))],
                ["h", "f", "doc_id", "th", "at", "n", "own"],
            )

    return run


def _cut_segments(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = [
                (w["h"], w["f"], w["c"], w["pieces"], text[w["at"] : w["at"] + w["n"] + window - 1])
                for text, wanted in zip(_bytes(b.column(0)), b.column(1).to_pylist(), strict=True) for w in wanted
            ]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["h", "f", "c", "pieces", "seg"])

    return run


def _sorted_pieces(window: int):
    """Rows come in order of (h, piece); an array takes whole groups, so equal windows of a piece meet in one."""

    def solve(rows: list[tuple]) -> list[tuple]:
        if not rows:
            return []
        classes = equal_windows([r[4] for r in rows], window)
        weight = np.zeros(max((int(c.max()) for c in classes if len(c)), default=0) + 1, np.int64)
        for r, c in zip(rows, classes, strict=True):
            np.add.at(weight, c, min(r[2], 2))
        out, told = [], set()
        for (h, f, _, pieces, seg), c in zip(rows, classes, strict=True):
            alone = []
            if pieces > 1:
                for s, k in enumerate(c.tolist()):
                    if k not in told:
                        told.add(k)
                        d = xxhash.xxh3_128_intdigest(seg[s : s + window])
                        alone.append({"d1": _signed(d >> 64), "d2": _signed(d & (1 << 64) - 1), "s": s, "n": int(min(weight[k], 2))})
            found = [{"s": s, "l": n} for s, n in runs(weight[c] > 1)]
            if found or alone:
                out.append((h, f, found, alone))
        return out

    pair = pa.list_(pa.struct([("s", pa.int32()), ("l", pa.int32())]))
    told = pa.list_(pa.struct([("d1", pa.int64()), ("d2", pa.int64()), ("s", pa.int32()), ("n", pa.int32())]))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pair, told), strict=True)], ["h", "f", "runs", "alone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for b in batches:
            for h, f, c, pieces, seg, piece in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (h, piece) != last and size >= ARRAY:
                    yield batch(solve(rows))
                    rows, size = [], 0
                last = (h, piece)
                rows.append((h, f, c, pieces, seg))
                size += len(seg)
        yield batch(solve(rows))

    return run


def _removed(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out: list[tuple] = []
            for text, found in zip(_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for r in sorted((r["a"], r["l"]) for r in found or ()):
                    stop = r[0] + r[1] + window - 1
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], stop)
                    else:
                        spans.append([r[0], stop])
                cuts = [0, *[x for s in spans for x in s], len(text)]
                kept = b"".join(text[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True))
                row = (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept, [x for s in spans for x in s]) if keep_text else row)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())][: 6 if keep_text else 4]
            cols = list(zip(*out, strict=True)) or [[]] * len(types)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names[: len(types) + 1])

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, piece: int = PIECE) -> DataFrame:
    """A written table (doc_id, th, a, l): l windows from byte a on repeat, in the document with that id and text hash th."""
    anchors = written(docs.select("doc_id", "th", "text").mapInArrow(_anchor_rows(window, gram), _ANCHORS), "anchors")
    again = anchors.groupBy("h").agg(F.count("*").alias("k"), F.max("own").alias("o")).where("k > 1 or o").select("h")
    again = written(again, "again")  # so that the join's sides are both shuffled by it and a hot value can be split
    held = written(anchors.join(again, "h", "left_semi"), "repeats")
    dropped(anchors)
    place = F.min(F.struct("doc_id", "th", "at", "n", "own")).alias("p")
    distinct = written(held.groupBy("h", "f").agg(F.count("*").alias("c"), place).select("h", "f", "c", "p.*"), "segments")
    several = written(distinct.groupBy("h").agg(F.count("*").alias("d"), F.max("own").alias("o")).where("d > 1 or o"), "shared")
    pieces = F.ceil(F.col("d") / piece).cast("int").alias("pieces")
    open_ = written(distinct.join(several, "h").select("h", "f", "c", "doc_id", "th", "at", "n", pieces), "open")
    wanted = open_.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "f", "c", "pieces", "at", "n")).alias("wanted"))
    with_text = docs.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th")))
    cut = with_text.select("d.text", "w.wanted").mapInArrow(_cut_segments(window), "h long, f long, c long, pieces int, seg binary")
    dealt = cut.select("*", F.pmod(F.col("f"), F.col("pieces")).cast("int").alias("piece")).repartition("h", "piece").sortWithinPartitions("h", "piece")
    solved = written(dealt.mapInArrow(_sorted_pieces(window), _RUNS), "solved")
    found = solved.where(F.size("runs") > 0).select("h", "f", F.explode("runs").alias("r")).select("h", "f", "r.s", "r.l")
    told = solved.where(F.size("alone") > 0).select("h", "f", F.explode("alone").alias("t")).select("h", "f", "t.*")
    counted = told.groupBy("d1", "d2").agg(F.sum("n").alias("total"), F.count("*").alias("tellers")).where("total > 1 and tellers > 1")
    late = told.where("n = 1").join(counted, ["d1", "d2"]).select("h", "f", "s", F.lit(1).alias("l"))
    whole = distinct.where("c > 1").select("h", "f", F.lit(0).alias("s"), F.col("n").alias("l"))
    flags = whole.union(found.union(late).join(whole.select("h", "f"), ["h", "f"], "left_anti"))
    flags = written(flags.groupBy("h", "f").agg(F.collect_list(F.struct("s", "l")).alias("r")), "flags")
    dropped(again, distinct, several, open_, solved)
    where = held.join(flags, ["h", "f"]).select("doc_id", "th", "at", F.explode("r").alias("r"))
    where = written(where.select("doc_id", "th", (F.col("at") + F.col("r.s")).alias("a"), F.col("r.l").alias("l")), "windows")
    dropped(held, flags)
    return where


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, piece: int = PIECE, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row; with keep_text also kept (binary) and spans (starts and ends in turn)."""
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    where = repeated_windows(keyed, window, gram, piece)
    by_doc = where.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "l")).alias("found"))  # rows that repeat id and text tell the same
    both = keyed.alias("d").join(by_doc.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th")), "left")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<long>" * keep_text
    out = written(both.select("d.doc_id", "d.text", "w.found").mapInArrow(_removed(window, keep_text), kind), "deduped")
    dropped(where)
    return out
