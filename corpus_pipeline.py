"""The corpus pipeline: quality, line dedup, near-dedup, decontamination and packing over ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.frames import scratch_path
from corpusloom.llm import decontamination, line_dedup, near_copies, packing, quality
from corpusloom.llm.queries import tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a text that was cut."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the rows that op3 learns from.

    Null and empty texts are judged as empty, each repeated row by itself; no documents give no documents.
    """
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    return quality.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their smallest document only; no document goes, even one that is left empty.

    Null texts stay null; rows that repeat a key and text lose the same lines; a null key loses nothing.
    """
    return _counted(line_dedup.dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard 0.8 or more of five-word shingles) the smallest document stays. Candidates
    come from op1's deletion variants of SimHashes and, beyond their radius, from prefixes; then all are compared exactly.

    Texts without words, null and empty ones among them, are one group; rows that repeat a kept key all stay, and
    a null key goes where its group has others.
    """
    return near_copies.keep_representatives(docs, words=5, least=0.8)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; a document that is mostly benchmark goes. Null and empty texts have no words and stay."""
    return _counted(decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens. A null or empty text is its end token; repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path(), with_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_text),
    ("packing", pack_windows),
]

#: SQL has neither the classifier nor the tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; between stages rows are Parquet in the shared folder, so that a lost
    executor costs a stage's tasks and no more. They go when the session ends."""
    folder = scratch_path(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
