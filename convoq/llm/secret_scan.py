"""Secret scans: patterns per text, and corpus-wide ownership frequency for what patterns leave open.

Base spans come from three fixed patterns. Besides, long strings that mix two or three of lower case,
upper case and digits are candidates. Each candidate (of a base span: its value) is hashed, and hashes are counted over the
corpus by distinct repositories and distinct owners. A string that many owners share is a copied
example; one that few owners have in few repositories looks live. Live-looking candidates become
spans of kind `live`; base spans always stay, and are counted as live or copied.

A string that a third of the corpus holds is one hot hash: (hash, owner, repository) triples are summed
before the shuffle and counted in two steps, by owner and then by hash, and the spans of a hot hash get
its verdict by a broadcast of the at most 1,000 hashes that can be hot.

Defined cases: null text is an empty text; very long texts are scanned whole; offsets count code points; a null owner or repository is a
value of its own; repeated rows are results of their own and one repository; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoq.llm.common import joined_unique, small, written
from convoq.shipping import ship

KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
#: A candidate that no pattern names: this long, with two of lower case, upper case and digits, and this many bits per
#: character (of the 4 that hex digits can have, fewer). With two classes only, it must be that long without separators.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{24,}")
UNBROKEN = re.compile(r"[A-Za-z0-9]{24,}")
HEX_DIGITS = re.compile(r"[0-9A-F]+|[0-9a-f]+")
LEAST_BITS, LEAST_HEX_BITS = 3.5, 3.0
#: More owners than this and a string is a copied example; more repositories, too.
OWNERS, REPOSITORIES = 3, 3


def bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the three patterns, ordered by start, then kind."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(k, m.start(), m.end(), m[0]) for k, p in (("access", ACCESS), ("hex", HEX)) for m in p.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def drawn(value: str) -> bool:
    """Whether a string of candidate characters looks drawn at random."""
    lower, digit = any("a" <= c <= "z" for c in value), any(c.isdigit() for c in value)
    upper = any("A" <= c <= "Z" for c in value)
    if not (lower and upper and digit):
        mixed = digit if lower != upper else any("A" <= c <= "Z" for c in value[1:]) and lower  # not a word with a capital
        if not mixed or not UNBROKEN.search(value):
            return False
    return bits(value) >= (LEAST_HEX_BITS if HEX_DIGITS.fullmatch(value) else LEAST_BITS)


def candidates(text: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """What no base span covers and looks drawn at random."""
    found = []
    for m in CANDIDATE.finditer(text):
        v = m[0]
        if not drawn(v):
            continue
        if all(m.end() <= s or m.start() >= e for _, s, e, _ in taken):
            found.append(("live", m.start(), m.end(), v))
    return found


def _digest(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode()) - (1 << 63)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_SPAN = pa.struct([("start", pa.int64()), ("kind_no", pa.int32()), ("end", pa.int64()), ("h", pa.int64())])
_SCHEMA = "doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start long, kind_no int, end long, h long>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        out: list[list] = [[] for _ in range(5)]
        for text in b.column(3).to_pylist():
            base = base_spans(text or "")
            spans = sorted(base + candidates(text or "", base), key=lambda s: (s[1], KINDS.index(s[0])))
            n = Counter(s[0] for s in base)
            row = (n["assign"], n["access"], n["hex"], hashlib.sha256(joined([s[:3] for s in base]).encode()).hexdigest(),
                   [{"start": s, "kind_no": KINDS.index(k), "end": e, "h": _digest(v)} for k, s, e, v in spans])
            for col, x in zip(out, row, strict=True):
                col.append(x)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(_SPAN))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]],
            ["doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )


def ownership(found: DataFrame) -> DataFrame:
    """(h, owners, repositories, n) over (h, owner, repository): n is how many rows have the hash."""
    triples = found.groupBy("h", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repository", F.lit("\0")).alias("repository")).agg(F.count("*").alias("n"))
    by_owner = triples.groupBy("h", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied) for every row.

    owner is the row's source and repository its text unless they are given, so copies of a document are one.
    """
    ship(docs.sparkSession)
    owner = F.col("source") if owner is None else owner
    repository = F.xxhash64(F.col("text").cast("string")) if repository is None else repository
    rows = docs.select(F.col("doc_id").cast("long"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.col("text").cast("string"))
    rows = written(rows.mapInArrow(_scan, _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "spans")
    each = rows.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("s")).select("row", "owner", "repository", "s.*")
    seen = written(ownership(each), "ownership")
    live = (F.col("owners") <= owners) & (F.col("repositories") <= repositories)
    total = seen.agg(F.sum("n")).first()[0] or 0
    named = joined_unique(each.select("row", "start", "kind_no", "end", "h"), seen.select("h", live.alias("is_live"), "n"), "h", total)
    stays = named.where((F.col("kind_no") < 3) | F.col("is_live"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind_no") + 1)
    span = F.struct("start", "kind_no", F.concat_ws(":", kind, "start", "end").alias("as_text"))
    spans = F.array_join(F.transform(F.array_sort(F.collect_list(span)), lambda s: s["as_text"]), ",")
    by_row = stays.groupBy("row").agg(spans.alias("spans"), F.count_if("is_live").alias("n_live"), F.count_if(~F.col("is_live")).alias("n_copied"))
    return rows.join(by_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
