"""Files: JSON in and out, dataset scans, configuration, the vector store."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoq.functions.text import base_name, collection_name

TRANSCRIPT = "array<struct<start string, end string, speaker string, text string>>"
SPEAKER_SUMMARY = "array<struct<id string, info array<struct<text string, start double, end double>>, summary string>>"
TOPIC_SUMMARY = "array<struct<topic_id int, summary string, evidence array<struct<speaker string, text string, start double, end double>>>>"


@dataclass
class Config:
    """Paths and parameters; nested keys are read with get('a', 'b'), missing ones give the default."""

    values: dict = field(default_factory=dict)

    @classmethod
    def from_yaml(cls, spark: SparkSession, path: str) -> Config:
        """A small YAML file of nested scalars, read through Spark so that any store works."""
        root: dict = {}
        stack: list[tuple[int, dict]] = [(-1, root)]
        for (line,) in spark.read.text(path, wholetext=False).collect():
            body = line.split(" #")[0].rstrip()
            if not body.strip() or body.lstrip().startswith("#") or ":" not in body:
                continue
            depth = len(body) - len(body.lstrip())
            key, value = (x.strip() for x in body.strip().split(":", 1))
            while stack[-1][0] >= depth:
                stack.pop()
            if value:
                stack[-1][1][key] = value.strip("\"'")
            else:
                stack.append((depth, stack[-1][1].setdefault(key, {})))
        return cls(root)

    def get(self, *keys: str, default=None):
        at = self.values
        for k in keys:
            if not isinstance(at, dict) or k not in at:
                return default
            at = at[k]
        return at


def json_files(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """(file, item): elements of the JSON array in each file; tolerant: whatever stands before the first [ is skipped."""
    f = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.input_file_name(), r"^.*/", "").alias("file"), "value")
    text = F.when(F.instr("value", "[") > 0, F.expr("substring(value, instr(value, '['))")).otherwise(F.col("value")) if tolerant else F.col("value")
    return f.select("file", F.explode_outer(F.from_json(text, schema)).alias("item"))


def transcripts(spark: SparkSession, path: str, tolerant: bool = True) -> DataFrame:
    return json_files(spark, path, TRANSCRIPT, tolerant).select("file", "item.*")


def speaker_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, summary, text, start, end): info entries may be structs or plain strings; speakers without any stay."""
    raw = json_files(spark, path, "array<struct<id string, summary string, info array<string>>>").select("file", "item.*")
    e = raw.select("file", "id", "summary", F.explode_outer("info").alias("info"))
    s = F.from_json("info", "text string, start double, end double")
    plain = ~F.coalesce(F.col("info").startswith("{"), F.lit(False))
    return e.select("file", "id", "summary", F.when(plain, F.col("info")).otherwise(s["text"]).alias("text"), F.when(~plain, s["start"]).alias("start"), F.when(~plain, s["end"]).alias("end"))


def topic_summaries(spark: SparkSession, path: str, evidence: int = 5) -> DataFrame:
    """(file, topic_id, summary, evidence): at most `evidence` entries of evidence."""
    t = json_files(spark, path, TOPIC_SUMMARY).select("file", "item.*")
    return t.withColumn("evidence", F.slice("evidence", 1, evidence))


def write_json(df: DataFrame, path: str, by: str = "meeting_id", mode: str = "overwrite") -> None:
    """One folder of JSON lines for each value of `by`; rows of a value stay together."""
    df.repartition(by).write.mode(mode).partitionBy(by).json(path)


#: Names of the files that hold summaries and transcripts of a meeting.
NAMES = {"speaker": "speaker_summarization_{}.json", "topic": "topic_summarization_{}.json", "meeting": "meeting_summarization_{}.json", "transcript": "final_transcriptions_{}.json"}
PREFIX = "final_transcriptions_"


def _arrow_writes(uri: str) -> bool:
    try:
        pafs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _writer(uri: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes each (name, value) as a file of the folder: under a hidden name first, so that a task that is repeated or stopped leaves none half written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for name, value in zip(b.column(0), b.column(1), strict=True):
                hidden = f"{root}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(hidden) as out:
                    out.write(value.as_py().encode() + b"\n")
                if uri.startswith("file:"):
                    Path(root, f".{name}.crc").unlink(missing_ok=True)  # Hadoop's checksum of an older file
                fs.move(hidden, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([b.column(0)], ["name"])

    return run


def write_named(df: DataFrame, path: str, kind: str, file: str = "file", order: str | None = None) -> None:
    """One JSON array a source file, called after it: `topic_summarization_m1.json` for rows of `final_transcriptions_m1.json`.

    kind: speaker, topic, meeting, transcript, or any name with a {} in it. Rows are gathered by file and written by the
    executors, each file under its own name; where Arrow does not know the file system, Spark writes a folder for each file and
    the driver renames what it wrote.
    """
    spark, name = df.sparkSession, NAMES.get(kind, kind)
    cols = [c for c in df.columns if c not in (file, order)]
    row = F.struct(*[F.col(order) if order else F.lit(0).alias("o")], F.struct(*cols).alias("x"))
    base = F.regexp_replace(base_name(F.col(file)), f"^{PREFIX}", "")
    items = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"])
    text = df.withColumn("name", F.format_string(name.replace("{}", "%s"), base)).groupBy("name").agg(F.to_json(items).alias("value"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *parts]))
    fs = where().getFileSystem(conf)
    uri = re.sub(r"^file:/+", "file:///", where().makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString())
    if _arrow_writes(uri):
        text.mapInArrow(_writer(uri), "name string").write.format("noop").mode("overwrite").save()
        return
    text.repartition("name").write.mode("overwrite").partitionBy("name").text(where("_parts").toString())
    for folder in fs.listStatus(where("_parts")):
        if folder.isDirectory():
            for part in fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder.getPath(), "part-*")):
                to = where(folder.getPath().getName().split("=", 1)[1])
                fs.delete(to, False)
                fs.rename(part.getPath(), to)
    fs.delete(where("_parts"), True)


def listing(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(name, path, length, modified) of the files of a folder with that ending, contents unread."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    return f.select(F.regexp_replace("path", r"^.*/", "").alias("name"), "path", "length", F.col("modificationTime").alias("modified"))


def dataset_metadata(df: DataFrame, drop: str = "audio", n: int = 5) -> DataFrame:
    """The first rows of a dataset without its heavy column."""
    return df.drop(drop).limit(n)


def diarization_rows(df: DataFrame) -> DataFrame:
    """(meeting_id, seq, speaker, start_ms, end_ms) from parallel arrays timestamps_start, timestamps_end, speakers."""
    z = df.select("meeting_id", F.posexplode(F.arrays_zip("timestamps_start", "timestamps_end", "speakers")).alias("seq", "z"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return z.select("meeting_id", F.col("seq").cast("long").alias("seq"), F.col("z.speakers").alias("speaker"), ms("z.timestamps_start").alias("start_ms"), ms("z.timestamps_end").alias("end_ms"))


def upsert_vectors(points: DataFrame, path: str, name: str = "file") -> DataFrame:
    """Adds collections of vectors (file, id, vector, payload) to a table partitioned by collection.

    A collection that is there already is left as it is. Returns the whole table.
    """
    spark = points.sparkSession
    p = points.withColumn("collection", collection_name(F.col(name))).drop(name)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        have = spark.read.parquet(path).select("collection").distinct()
        p = p.join(have, "collection", "left_anti")
    p.repartition("collection").write.mode("append").partitionBy("collection").parquet(path)
    return spark.read.parquet(path)
