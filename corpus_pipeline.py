"""A training corpus from documents: rules, near-duplicates, benchmarks, mix, token files.

Each stage takes the table its predecessor wrote and works on all of it. A stage's input may hold
nulls, repeated rows and extra columns; what becomes of them is said in the operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convoq.llm import decontaminate, mixing, quality_rules, rans, simhash
from convoq.llm.common import dropped, table, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality_rules.kept(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row, read back from the token files."""
    return rans.round_trip(docs)


STAGES = [("quality_rules", rules), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", benchmarks), ("source_mixing", mix), ("token_output", token_files)]

#: Learned rules, components and encoded files are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), name)
        if before:
            dropped(before)
        docs = before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
