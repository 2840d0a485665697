"""The corpus pipeline: stages over `documents`, each stored before the next reads it.

Rows are never capped or sampled; NULL and empty texts are rejected by the first stage, which keeps only texts with words.
Extra columns of the input are dropped, so clashing names can't occur.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm import decontaminate, linededup, sentencepiece_sa, simhash, weaklabels
from sparkprep.llm.common import WORD
from sparkprep.session import release, scratch_path, scratch_scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Scratch folders of the stage called last.
_USED: list[str] = []


def stage(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage whose result is written before the next stage is called, which then deletes the scratch folders behind it."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_USED)
        with scratch_scope(_USED):
            return fn(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return weaklabels.classify(docs.select(COLUMNS)).where("kept").select(COLUMNS)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with a recurring template go, and documents that keep no word; n_chars follows a text that changed."""
    clean = linededup.drop_recurring(docs.select(COLUMNS))
    clean = clean.where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word Jaccard of 0.8) stays, the one with the smallest id."""
    return simhash.keep_one_similar(docs.select(COLUMNS))


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a near copy of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.with_leaks(docs.select(COLUMNS), items).where(F.size("leaks") == 0).select(COLUMNS)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it."""
    coded = sentencepiece_sa.encode(docs.select("doc_id", "lang", "source", "text"), round_trip="round_trip")
    return coded.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontaminate", benchmark), ("tokens", tokens),
]
#: SQL can't express the learned classifier, the embedding or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, fn in STAGES:
        path = scratch_path(spark, name)
        fn(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(before)
        before.append(path)
    release(_USED)
    return docs
