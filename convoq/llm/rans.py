"""Token ids as a file format: static range asymmetric numeral system (rANS) in interleaved blocks.

Every whole text is encoded with a tokenizer file, an end id follows each document, and the ids are
written in ascending doc_id order. One frequency table, counted over all ids of the corpus, serves all
blocks. A block holds whole documents' ids in up to LANES interleaved rANS states, so that each numpy step
encodes or decodes as many ids; a block depends on nothing but the table, so blocks decode in parallel.

    table row:  part -1, the frequencies (they sum to a power of two, 2**PRECISION or more if there are so many ids)
    block row:  part and seq (ascending with doc_id), first doc_id and last one, checkpoints (each
                document's id count and the crc32 of its ids), the number of ids, the states, the
                words, and the crc32 of states and words

Files are Parquet rows of these; the blocks of a part are in one file. A damaged block is found by its
checksum, a wrongly decoded document by its checkpoint; either raises.

A text is cut where no token of the vocabulary's pattern reaches over: before a single space or around
a single line feed between other characters, and after a word. What was encoded before is looked up in a
table of bounded size, the rest goes to the tokenizers library.

Ids are dealt in ranges of (doc_id, checksum, row), so rows without an id or with the same one spread over
as many ranges as they fill. The number of ranges and the ids in one both grow with the root of the
corpus; a task sorts its range with spilling and holds one block of it.

Defined cases: null and empty texts have only the end id; repeated doc_ids and a null one (first in
order) are documents of their own, ordered by their ids' checksum; a very long text is one document in
one block, whose size it may exceed BLOCK_IDS by; an empty table gives a table row, no blocks and an
empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convoq.llm.common import dropped, small, written
from convoq.scratch import new_path
from convoq.shipping import ship

END_ID = 0
PRECISION = 18
LOWEST = np.uint64(1 << 31)
#: States of a block at most, and ids for which it has one.
LANES, LANE_IDS = 8192, 64
#: Ids after which a block ends (with its document), ids for which there is one range (n**2 times as many ids have n
#: ranges), and pieces in a worker's table.
BLOCK_IDS = 1 << 20
PART_IDS = 1 << 18
CACHE = 600_000
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_LETTERS = "".join(c for c in map(chr, range(256)) if re.fullmatch(f"[{_LATIN}]", c))
#: Pieces: a word; points after it; a line feed; whatever else stands between white space; white space with what follows.
_PIECE = re.compile(rf" ?[{_LATIN}]++(?![^\W\d_])|(?<=[{_LATIN}])[.,!?;:]++(?=[ \n]|\Z)|(?<=\S)\n(?=\S)| ?\S+|\s+\S*")
#: Characters that Python counts as white space and the vocabulary's pattern doesn't.
_ODD = "\x1c\x1d\x1e\x1f"
#: The vocabulary writes bytes as characters: printable ones as they are, the others, in order, from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_SHOWN = "".join(_OTHERS.get(b, chr(b)) for b in range(256))
_ID = attrgetter("id")
_U = np.uint64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Known(dict):
    """piece -> its ids as bytes; asks the tokenizer for what is missing.

    At half of CACHE pieces it starts anew, and the last generation is kept to take from what is met again.
    """

    def __init__(self, tokenizer, kind: str):
        self.tokenizer, self.model, self.kind, self.last = tokenizer, tokenizer.model, {"<u2": "H", "<u4": "I"}[kind], {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE // 2:
            self.last = dict(self)
            self.clear()
        got = self[piece] = self.last.get(piece) or self.ask(piece)
        return got

    def ask(self, piece: str) -> bytes:
        if not (piece[1:] if piece[0] == " " else piece).strip(_LETTERS):
            # A word: the model itself is asked for it, one character a byte, without the steps before it.
            ids = map(_ID, self.model.tokenize(charmap_decode(piece.encode(), "strict", _SHOWN)[0]))
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return array(self.kind, ids).tobytes()


class Encoder:
    """text -> ids; looks pieces up before it asks the tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known = _Known(self.tokenizer, self.kind)

    def encode(self, text: str) -> np.ndarray:
        if any(c in text for c in _ODD):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        return np.frombuffer(b"".join(map(self.known.__getitem__, _PIECE.findall(text))), self.kind)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file in a Python worker, which serves many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Table:
    """Frequencies of ids that sum to 2**precision; every id that occurs has one of at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.precision = int(self.freq.sum()).bit_length() - 1
        if int(self.freq.sum()) != 1 << self.precision or self.precision > 30:
            raise ValueError("frequencies must sum to a power of two, 2**30 at most")
        self._ids = None

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray) -> Table:
        freq = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
        precision = max(PRECISION, len(ids).bit_length() + 1)
        if len(ids):
            total, room = int(counts.sum()), (1 << precision) - len(ids)
            share = np.array([int(c) * room // total for c in counts], np.int64)
            freq[ids] = 1 + share
            freq[ids[int(np.argmax(counts))]] += room - share.sum()
        else:
            freq[0] = 1 << precision
        return cls(freq)

    def ids_of(self, slots: np.ndarray) -> np.ndarray:
        if self._ids is None:
            self._ids = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._ids[slots]


def encode_block(ids: np.ndarray, table: Table) -> tuple[bytes, bytes]:
    """(states, words): id i is in lane i % LANES; lanes are encoded from the last id to the first."""
    n = len(ids)
    lanes = min(LANES, max(1, n // LANE_IDS))
    steps = -(-n // lanes)
    f_all, s_all = table.freq[ids], table.start[ids]
    x = np.full(lanes, LOWEST, _U)
    precision, out = table.precision, []
    for step in range(steps - 1, -1, -1):
        lo, hi = step * lanes, min(n, (step + 1) * lanes)
        f, s, y = f_all[lo:hi], s_all[lo:hi], x[: hi - lo]
        full = y >= f << _U(63 - precision)
        if full.any():
            out.append(y[full].astype("<u4")[::-1])
            y = np.where(full, y >> _U(32), y)
        q = y // f
        x[: hi - lo] = (q << _U(precision)) + (y - q * f) + s
    words = np.concatenate(out)[::-1] if out else np.empty(0, "<u4")
    return x.astype("<u8").tobytes(), words.astype("<u4").tobytes()


def decode_block(states: bytes, words: bytes, n: int, table: Table) -> np.ndarray:
    x, stream, at = np.frombuffer(states, "<u8").astype(_U), np.frombuffer(words, "<u4"), 0
    lanes = len(x)
    ids = np.empty(n, "<u4")
    mask = _U((1 << table.precision) - 1)
    for lo in range(0, n, lanes):
        hi = min(n, lo + lanes)
        y = x[: hi - lo]
        slot = y & mask
        got = table.ids_of(slot)
        ids[lo:hi] = got
        y = table.freq[got] * (y >> _U(table.precision)) + slot - table.start[got]
        low = y < LOWEST
        if k := int(low.sum()):
            y[low] = (y[low] << _U(32)) | stream[at : at + k].astype(_U)
            at += k
        x[: hi - lo] = y
    if at != len(stream) or (x != LOWEST).any():
        raise ValueError("a block's words don't end where its ids do")
    return ids


_TOKENS = "doc_id long, n_tokens long, ids_crc32 long, ids binary, counts binary"


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, ids, counts) for every row: ids end with END_ID and are packed.

    counts, on one row of a batch, is how often the batch has each id.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pack = encoder(path), zstandard.ZstdCompressor(level=3)
        end = np.array([END_ID], "<u4")
        for b in small(batches):
            ids = [np.concatenate([now.encode(t or ""), end]) for t in b.column(1).to_pylist()]
            counts = [pack.compress(np.bincount(np.concatenate(ids)).astype("<u4").tobytes())] if ids else []
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([pack.compress(_narrow(x)) for x in ids], pa.binary()), pa.array(counts + [None] * (len(ids) - 1), pa.binary()),
                ],
                ["doc_id", "n_tokens", "ids_crc32", "ids", "counts"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _TOKENS)


def _narrow(ids: np.ndarray) -> bytes:
    """The low halves of all ids, then the high halves if any is over 65,535."""
    low, high = (ids & 0xFFFF).astype("<u2"), (ids >> 16).astype("<u2")
    return low.tobytes() + (high.tobytes() if high.any() else b"")


def _widen(packed: bytes, n: int) -> np.ndarray:
    halves = np.frombuffer(packed, "<u2")
    return halves[:n].astype("<u4") | (halves[n:].astype("<u4") << 16 if len(halves) > n else 0)


def count_ids(tokens: DataFrame) -> tuple[Table, int]:
    """The shared table and the number of all ids: the batches' counts are summed in each task, then over all; its size is the vocabulary's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, unpack = np.zeros(1, np.int64), zstandard.ZstdDecompressor()
        for b in batches:
            for packed in b.column(0).to_pylist():
                c = np.frombuffer(unpack.decompress(packed), "<u4")
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
                total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = tokens.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = sorted(counts.collect())
    return Table.of_counts(np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.int64)), sum(r[1] for r in got)


def in_parts(tokens: DataFrame, n_ids: int) -> DataFrame:
    """tokens in ranges of doc_id, one a partition: part, then the columns, in ascending order within each part."""
    n = max(1, math.ceil(math.sqrt(n_ids / PART_IDS)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("ids_crc32"), F.col("row")]
    dealt = tokens.drop("counts").repartitionByRange(n, *order).select(F.spark_partition_id().alias("part"), "*")
    return dealt.sortWithinPartitions(*order).drop("row")


_BLOCKS = (
    "part int, seq int, first_id long, last_id long, n_ids long, doc_ids array<long>, doc_tokens array<long>, doc_crc32 array<long>, "
    "states binary, words binary, crc32 long"
)


def _block(part: int, seq: int, docs: list[tuple], table: Table) -> dict:
    ids = np.concatenate([d[3] for d in docs])
    states, words = encode_block(ids, table)
    return {
        "part": part, "seq": seq, "first_id": docs[0][0], "last_id": docs[-1][0], "n_ids": len(ids), "doc_ids": [d[0] for d in docs],
        "doc_tokens": [d[1] for d in docs], "doc_crc32": [d[2] for d in docs], "states": states, "words": words, "crc32": zlib.crc32(words, zlib.crc32(states)),
    }


def _schema(ddl: str, spark: SparkSession) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes docs (doc_id, text) to path in the format above."""
    spark = docs.sparkSession
    tokens = written(tokenized(docs, tokenizer).withColumn("row", F.monotonically_increasing_id()), "tokens", "uncompressed")
    table, n_ids = count_ids(tokens)
    schema, shared = _schema(_BLOCKS, spark), spark.sparkContext.broadcast(table.freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unpack = Table(shared.value), zstandard.ZstdDecompressor()
        part, seq, size, docs = None, 0, 0, []
        for b in batches:
            for p, doc_id, n, crc, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if docs and (p != part or size >= BLOCK_IDS):
                    yield pa.RecordBatch.from_pylist([_block(part, seq, docs, now)], schema)
                    seq, size, docs = (seq + 1 if p == part else 0), 0, []
                elif p != part:
                    seq = 0
                part = p
                docs.append((doc_id, n, crc, _widen(unpack.decompress(packed), n)))
                size += n
        if docs:
            yield pa.RecordBatch.from_pylist([_block(part, seq, docs, now)], schema)

    head = spark.createDataFrame([(-1, table.freq.astype("<u4").tobytes())], "part int, states binary")
    in_parts(tokens, n_ids).mapInArrow(run, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    dropped(tokens)
    head.write.parquet(f"{path}/table")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(part, seq, place, doc_id, n_tokens, ids_crc32, ids): every document, decoded and checked; order by part, seq, place."""
    table = np.frombuffer(spark.read.parquet(f"{path}/table").first().states, "<u4")
    shared = spark.sparkContext.broadcast(table)
    kinds = "part int, seq int, place int, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Table(shared.value)
        for b in batches:
            for r in b.to_pylist():
                if zlib.crc32(r["words"], zlib.crc32(r["states"])) != r["crc32"]:
                    raise ValueError(f"block {r['part']}:{r['seq']} is damaged")
                ids = decode_block(r["states"], r["words"], r["n_ids"], now)
                docs = np.split(ids, np.cumsum(r["doc_tokens"])[:-1])
                crcs = [zlib.crc32(np.ascontiguousarray(x)) for x in docs]
                if crcs != r["doc_crc32"]:
                    raise ValueError(f"block {r['part']}:{r['seq']} decodes to other ids")
                k = len(docs)
                cols = [pa.array([r["part"]] * k, pa.int32()), pa.array([r["seq"]] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(list(map(len, docs)), pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int64) for x in docs], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["part", "seq", "place", "doc_id", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, kinds)


def round_trip(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Writes docs, reads the files back and returns (doc_id, start, n_tokens, ids_crc32) from them."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write(docs, path, tokenizer)
    docs_read = written(read(spark, path, with_ids=False), "index")
    # Starts: blocks are few; each part's total comes from its blocks, each document's place from its block.
    blocks = docs_read.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    before_part = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("p0"))
    before = blocks.select("part", "seq", (F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")).alias("b0")).join(before_part, "part")
    inside = F.sum("n_tokens").over(Window.partitionBy("part", "seq").orderBy("place")) - F.col("n_tokens")
    placed = docs_read.select("part", "seq", "doc_id", "n_tokens", "ids_crc32", inside.alias("d0"))
    return placed.join(before, ["part", "seq"]).select("doc_id", (F.col("p0") + F.col("b0") + F.col("d0")).alias("start"), "n_tokens", "ids_crc32")
