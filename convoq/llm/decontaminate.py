"""Benchmark decontamination: size-partitioned MinHash containment search, verified on the shingles.

A document holds an item if it has at least THRESHOLD of the item's distinct word shingles. Items are
partitioned by size; an item of q shingles is sketched by its q - ceil(THRESHOLD q) + 1 smallest
shingle hashes, a bottom-k MinHash so long that a document without any of them cannot hold the item.
(A sketch of the documents, as in banded forms of this search, misses short items in long documents;
sketching the items alone finds all of them.) Documents are hashed once, partition by partition
only those large enough for its items are looked up, and every candidate is verified on the exact
shingles, not on hashes.

Items are taken in blocks of bounded size, each a broadcast of its texts. A worker keeps sketches of a
block and makes an item's shingles when a document asks for them. One block is looked up in the pass
that reads the documents. Of several, each is a pass of its own whose hits, one row for a text that
has any, are a written table; so any number of items works in the same memory, at one more pass over
the documents for BLOCK_CHARS more. Documents are not shuffled for one block, and for several only by
the hash of their text; a passage that a third of them share costs nothing extra.

Defined cases: words are compared in lower case (A-Z) without ASCII punctuation; an item of fewer than
SHINGLE words has its whole word sequence as its shingle; null items and items without words are in no
document; null and empty texts hold nothing; texts of any length are looked up whole, an item longer than
a block is a block; repeated items (item_id or text) and repeated documents are results of their own;
without items nothing is contaminated; an empty table gives an empty result; extra columns are not read
(`contaminated`) or pass through (`clean`), whatever their names.
"""

from __future__ import annotations

import math
import string
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoq.llm.common import LOWER, bounded, fresh, quoted, with_column, written

SHINGLE = 5
THRESHOLD = 0.8
#: Characters of items in a block, words in the cache of hashes, items in the cache of shingles.
BLOCK_CHARS = 32_000_000
CACHE, CACHE_ITEMS = 300_000, 2_000
_PLAIN = LOWER.translate(bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation)))
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_words = _Words()


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of each k words in a row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = hashes[:n] * _FACTORS[0]
    for i in range(1, k):
        h = h + hashes[i : i + n] * _FACTORS[i]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams_of(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[i:] for i in range(k)), strict=False))


class Items:
    """A block of items, partitioned by shingle length and size: sketches as arrays, shingles when they are asked for."""

    def __init__(self, items: list[tuple[int, bytes | None]], threshold: float = THRESHOLD):
        self.threshold, self.items, self.shingles = threshold, [], {}
        parts: dict[tuple[int, int], tuple[list[np.ndarray], list[int], list[int]]] = {}
        for item_id, text in items:
            words = normal_words(text)
            if not words:
                continue
            k = min(SHINGLE, len(words))
            n = len(grams_of(words, k))
            hashes = np.unique(shingle_hashes(word_hashes(words), k))
            sketch, at, needs = parts.setdefault((k, n.bit_length()), ([], [], []))
            sketch.append(hashes[: len(hashes) - math.ceil(threshold * len(hashes) - 1e-9) + 1])
            at += [len(self.items)] * len(sketch[-1])
            needs.append(math.ceil(threshold * n - 1e-9))
            self.items.append((item_id, text, k))
        self.parts = []
        for (k, _), (sketch, at, needs) in sorted(parts.items()):
            every, item = np.concatenate(sketch), np.array(at, np.int32)
            order = np.argsort(every, kind="stable")
            hashes, first = np.unique(every[order], return_index=True)
            there = np.zeros(1 << 16, bool)
            there[(hashes >> np.uint64(48)).astype(np.int64)] = True
            self.parts.append((k, min(needs), hashes, there, np.append(first, len(every)), item[order]))

    def grams(self, j: int) -> set[tuple[bytes, ...]]:
        if j not in self.shingles:
            if len(self.shingles) >= CACHE_ITEMS:
                self.shingles.clear()
            _, text, k = self.items[j]
            self.shingles[j] = grams_of(normal_words(text), k)
        return self.shingles[j]

    def held_by(self, text: bytes | None) -> list[tuple[int, float]]:
        """(item_id, containment) of the items that text holds, in item order."""
        words = normal_words(text)
        hashes, made, found = word_hashes(words), {}, set()
        for k, least, sketch, there, first, items in self.parts:
            if len(words) - k + 1 < least:
                continue
            if k not in made:
                made[k] = shingle_hashes(hashes, k)
            h = made[k]
            h = h[there[(h >> np.uint64(48)).astype(np.int64)]]
            at = np.minimum(np.searchsorted(sketch, h), len(sketch) - 1)
            for i in np.unique(at[sketch[at] == h]).tolist():
                found.update((k, j) for j in items[first[i] : first[i + 1]].tolist())
        mine = {k: grams_of(words, k) for k in {k for k, _ in found}}
        out = []
        for k, j in sorted(found, key=lambda x: x[1]):
            wanted = self.grams(j)
            if (n := len(wanted & mine[k])) >= math.ceil(self.threshold * len(wanted) - 1e-9):
                out.append((self.items[j][0], n / len(wanted)))
        return out


_built: dict[str, Items] = {}


def _items(name: str, shared, threshold: float) -> Items:
    """A block's Items, built once in a worker, which keeps the last block only."""
    if name not in _built:
        _built.clear()
        _built[name] = Items(shared.value, threshold)
    return _built[name]


_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64())]))
HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("containment", T.DoubleType())]))


def _shared(block: DataFrame) -> Broadcast:
    """A block's items on all executors."""
    items = [(r[0], r[1].encode() if r[1] is not None else None) for r in block.orderBy("item_id", "text").collect()]
    return block.sparkSession.sparkContext.broadcast(items)


def _looked_up(docs: DataFrame, shared: Broadcast, threshold: float, name: str) -> DataFrame:
    """docs with the hits of one block in column `name`."""
    key = uuid.uuid4().hex

    def lookup():
        known = _items(key, shared, threshold)
        return lambda texts: pa.array([[{"item_id": j, "containment": c} for j, c in known.held_by(t)] for t in texts], _HIT)

    return with_column(docs, "text", lookup, HITS, name)


def _text_key(text: Column) -> Column:
    return F.md5(text.cast("string"))


def with_hits(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, name: str = "hits") -> DataFrame:
    """docs with an array of (item_id, containment) in column `name`, empty where a document holds no item."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS))
    if blocks == 1:
        return _looked_up(docs, _shared(items), threshold, name)
    texts, found = docs.select(F.col("text").cast("string").alias("text")), None
    for i in range(blocks):
        shared = _shared(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i))
        hits = _looked_up(texts, shared, threshold, "part").where(F.size("part") > 0).select(_text_key(F.col("text")).alias("its_text"), "part")
        hits = written(hits.groupBy("its_text").agg(F.first("part").alias("part")), "hits")
        shared.destroy()
        found = hits if found is None else found.union(hits)
    key, none = fresh([*docs.columns, name], "its_text"), F.array().cast(HITS)
    found = bounded(written(found.groupBy("its_text").agg(F.flatten(F.collect_list("part")).alias(name)), "hits").withColumnRenamed("its_text", key))
    return docs.join(found, _text_key(docs["text"]) == F.col(key), "left").select(*[docs[quoted(c)] for c in docs.columns], F.coalesce(found[name], none).alias(name))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, max_containment) for every row; item_ids are joined by commas."""
    hits = with_hits(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, threshold).select("doc_id", F.array_sort("hits").alias("hits"))
    return hits.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"),
        F.array_join(F.transform("hits", lambda h: h["item_id"].cast("string")), ",").alias("item_ids"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["containment"])), F.lit(0.0)).alias("max_containment"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no item, all columns as they are."""
    name = fresh(docs.columns, "hits")
    return with_hits(docs, benchmark, threshold, name).where(F.size(name) == 0).select(*[quoted(c) for c in docs.columns])
