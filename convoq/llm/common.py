"""What the corpus operators share: byte tables, written intermediate tables, checked broadcasts, joins on hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from convoq.scratch import new_path
from convoq.shipping import ship

#: Words are runs of bytes other than these: bytes.split() without arguments splits at the same six.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Rows of a table that may be broadcast; more rows take the shuffled form of the same join.
BROADCAST_ROWS = 20_000
#: Rows of an Arrow batch that are turned into Python objects at once, and bytes of a batch while a table is written.
ARROW_ROWS, ARROW_BYTES = 1_000, 16 << 20
#: A key with more than one in so many rows of a table is hot; there are never more hot keys than this.
HOT_SHARES = 1_000

#: Session settings while a table is written: shuffle files go with their plan, Arrow batches are small.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES),
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block; after it they are what they were."""
    was = {k: v for k, v in dict(spark.conf.getAll).items() if k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in values:
            if k in was:
                spark.conf.set(k, was[k])
            else:
                spark.conf.unset(k)


def written(df: DataFrame, what: str = "table", codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: lineage ends there and a lost executor loses nothing.

    The shuffle files that led to it go as soon as it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    with settings(spark, _WRITING):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes the files of written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(batches: Iterable[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, to bound the Python objects made of one; Spark bounds a batch's bytes."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), rows):
            yield b.slice(at, rows)


def quoted(column: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def with_column(docs: DataFrame, source: str, f: Callable[[], Callable[[list[bytes | None]], pa.Array]], kind: DataType, name: str) -> DataFrame:
    """docs with one more column, made by a function of the texts of a batch; other columns may have any names.

    f is called once in a task and gives that function. Rows go through Python as one struct.
    """
    ship(docs.sparkSession)
    at = docs.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = f()
        for b in small(batches):
            rows = pa.array(b.column(0))
            yield pa.RecordBatch.from_arrays([rows, of(rows.field(at).cast(pa.binary()).to_pylist())], ["row", "made"])

    packed = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    out = packed.mapInArrow(run, StructType([packed.schema["row"], StructField("made", kind)]))
    return out.select(*[F.col("row." + quoted(c)).alias(c) for c in docs.columns], F.col("made").alias(name))


def fresh(columns: Iterable[str], name: str) -> str:
    """name, with underscores before it until none of the columns is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def joined_unique(rows: DataFrame, table: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """rows inner-joined by key with table, which has each key once and in n how many of the `total` rows have it.

    Keys with more than total / HOT_SHARES rows are at most HOT_SHARES, so they are broadcast and their rows stay where
    they are; the rows of the others are shuffled, and none of those keys can fill a task.
    """
    is_hot = F.col(n) * HOT_SHARES > total
    hot = F.broadcast(table.where(is_hot))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(shuffled(table.where(~is_hot)), key))


def shuffled(df: DataFrame) -> DataFrame:
    """df with a hint that joins with it shuffle both sides.

    Spark takes a table's compressed files for its size and a generator for one row a row, so that a table that grows with
    the corpus may look small enough to broadcast.
    """
    return df.hint("merge")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows (counted), else df itself."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
