"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits. Two fingerprints that differ in at most 3 bits have a
segment in which they differ in at most 1, so each fingerprint probes, in either segment's table,
its own value and those with one more bit set (the partner with the bit clear does the probing),
and every match is verified over all 64 bits. Equal fingerprints are one node, so copies never
meet in pairs.

A segment value shared by more than DENSE fingerprints would make the matches grow with the square
of its group. Such groups are dealt out once more, by a ball around the other segment: fingerprints
meet at values within 1 or 2 bits of their own, and all that meet at a value hang on one of those
within 1 bit. That gives the same components from a number of rows in proportion to the group.

Defined cases: null text is an empty text; a text of one or two words has its whole word sequence as
its only shingle; no words give fingerprint 0, which links like any other. Rows with a null doc_id
are linked but never name a component (null if there is no other id). Repeated rows stay, each with
the same component. Of a very long text all shingles count, CHUNK at a time. An empty table gives an
empty result; extra columns are not read (`near_duplicates`) or pass through (`keep_one`).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoq.llm.common import LOWER, dropped, fresh, quoted, shuffled, small, written
from convoq.llm.graph import connected_components
from convoq.shipping import ship

SEED = 42
DISTANCE = 3
DENSE = 256
SHINGLE = 3
CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of a text's word shingles."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    grams = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else iter([words])
    digest, join, counts = xxhash.xxh64_intdigest, b" ".join, np.zeros(64, np.int64)
    while part := [digest(join(g), SEED) for g in islice(grams, CHUNK)]:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        texts = b.column(2).cast(pa.binary()).to_pylist()
        fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "th", "fp"])


def _key(docs: DataFrame) -> tuple[Column, Column]:
    return docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp): fp is the fingerprint's 64 bits as a signed long, th a hash of the text."""
    ship(docs.sparkSession)
    doc_id, th = _key(docs)
    return docs.select(doc_id.alias("doc_id"), th.alias("th"), docs["text"].cast("string")).mapInArrow(_fingerprints, "doc_id long, th long, fp long")


def _half(fp: Column, s: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if s else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _tag(value: Column, s: int) -> Column:
    return value.bitwiseOR(F.lit(s << 32))


def _bits(value: Column, high: int) -> Column:
    """The bit values below 2**high that are clear in value."""
    return F.filter(F.array(*[F.lit(1 << i) for i in range(high)]), lambda b: value.bitwiseAND(b) == 0)


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between the fingerprints in column fp; they join all that chains of 3 or fewer bits join."""
    halves = [distinct.select("fp", _tag(_half(F.col("fp"), s), s).alias("key"), F.lit(s).alias("s")) for s in (0, 1)]
    entry = halves[0].union(halves[1])
    sizes = entry.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    entries = written(entry.join(shuffled(sizes), "key", "left"), "segments")
    probe = entries.select("fp", "key", F.explode(F.concat(F.array(F.lit(0).cast("long")), _bits(F.col("key"), 32))).alias("bit"))
    probes = probe.select(F.col("fp").alias("a"), F.col("key").bitwiseXOR(F.col("bit")).alias("key"), (F.col("bit") == 0).alias("same"))
    few = entries.where(F.coalesce("size", F.lit(1)) <= dense).select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    found = probes.join(shuffled(few), "key").where(near & (~F.col("same") | (F.col("a") < F.col("b")))).select("a", "b")
    many = entries.where(F.col("size") > dense)
    if many.limit(1).count():
        found = found.union(_dense_links(probes, many))
    return found


def _dense_links(probes: DataFrame, many: DataFrame) -> DataFrame:
    """The same for crowded segment values: all meet at values of the other segment, not in pairs.

    A table entry visits its other segment's values within 1 and 2 bits, a prober (1 bit away in the
    segment) those within 1. The smallest entry within 1 bit of a value is within 3 bits of all others there.
    """
    other = lambda c: F.when(F.col("key") >= F.lit(1 << 32), _half(F.col(c), 0)).otherwise(_half(F.col(c), 1))
    one = [F.lit(0).cast("long"), *[F.lit(1 << i) for i in range(32)]]
    two = [F.lit((1 << i) | (1 << j)) for i in range(32) for j in range(i)]
    member = many.select("key", "fp", other("fp").alias("o"))
    close = member.select("key", "fp", F.explode(F.transform(F.array(*one), lambda m: F.col("o").bitwiseXOR(m))).alias("z"))
    far = member.select("key", "fp", F.explode(F.transform(F.array(*two), lambda m: F.col("o").bitwiseXOR(m))).alias("z"))
    guest = probes.where("not same").join(shuffled(many.select("key").distinct()), "key").select("key", F.col("a").alias("fp"), other("a").alias("o"))
    guest = guest.select("key", "fp", F.explode(F.transform(F.array(*one), lambda m: F.col("o").bitwiseXOR(m))).alias("z"))
    hub = close.groupBy("key", "z").agg(F.min("fp").alias("b"))
    return close.union(far).union(guest).join(shuffled(hub), ["key", "z"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """(doc_id, th, fp, component_id) for every row: component_id is the smallest doc_id reachable over links."""
    return _components(docs, dense).select("doc_id", "th", "fp", "component_id")


def _components(docs: DataFrame, dense: int) -> DataFrame:
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = connected_components(links(nodes.select("fp"), dense)).withColumnRenamed("node", "fp")
    named = nodes.join(shuffled(roots), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = written(named, "roots")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = written(named.join(shuffled(least), "root").select("fp", "root", "component_id"), "components")
    return rows.join(shuffled(by_fp), "fp")


def keep_one(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """One row of each near-duplicate component of docs, all columns as they are.

    It is the row with the smallest doc_id (null last), of several with that id the one with the smallest text
    hash, and any of those that repeat both.
    """
    found = written(_components(docs, dense), "found")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("k"))
    i, t = fresh(docs.columns, "first_id"), fresh(docs.columns, "first_text")
    first = written(first.select(F.col("k.doc_id").alias(i), F.col("k.th").alias(t)), "first")
    doc_id, th = _key(docs)
    kept = docs.join(shuffled(first), doc_id.eqNullSafe(F.col(i)) & (th == F.col(t)), "left_semi")
    if found.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        kept = kept.withColumn(t, F.xxhash64(kept["text"].cast("string"))).dropDuplicates(["doc_id", t])
    dropped(found)
    return kept.select(*[quoted(c) for c in docs.columns])
