"""Corpus pipeline: quality rules, near-duplicate join, decontamination, personal data, packing.

Each stage takes what its predecessor kept, as a table, and all but the last return the columns of documents. What a stage
returns reads tables of its own, which the next call of a stage drops: it must be written before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from schedlake.llm import decontamination, jaccard, packing, pii, quality
from schedlake.llm.shared import Scratch, written

#: Near-duplicates here are judged on five words and a similarity of 0.8.
SHINGLE, PERCENT = 5, 80
#: The tables of the last stage called.
_LEFT: list[Scratch] = []


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Drops the tables of the stage before, so that the disk holds those of one stage at a time."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _LEFT:
            _LEFT.pop().drop(spark)
        with Scratch(spark).recording() as scratch:
            result = fn(spark, docs, sf_dir)
        _LEFT.append(scratch)
        return result

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail a rule, and documents of hosts that fail nearly always."""
    return quality.keep_good(docs)


@stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return jaccard.one_of_each(docs, n=SHINGLE, percent=PERCENT)


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold benchmark passages in at least one word of twenty."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontamination.decontaminate(docs, benchmark).where(~decontamination.contaminated()).select("row.*")


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows the text."""
    found = pii.find(docs).select("row.*", F.col("spans").alias("__spans"))
    cleaned = pii.redacted(F.col("text"), F.col("__spans"))
    out = {"text": cleaned} | ({"n_chars": F.when(F.size("__spans") > 0, F.length(cleaned).cast("long")).otherwise(F.col("n_chars"))}
                               if "n_chars" in docs.columns else {})
    return found.withColumns(out).select(*docs.columns)


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, as pieces with their ids and places."""
    cut = packing.written_pieces(docs)
    return packing.with_ids(cut, packing.pack(cut)).select(
        "doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules), ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination), ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: No SQL: EM, connected components and packing are beyond it; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, each in STAGES[:-1]:
        with Scratch(spark).recording() as scratch:
            docs = written(each(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        before.drop(spark)
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
