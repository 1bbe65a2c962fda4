"""Readers and writers of the pipeline's files. Paths may be in any store that Spark reads."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import running_total

BENCHMARK = "query_id string, query string, Eng_Query string, query_type string, source_lang string, target_lang string, has_answer boolean, answer_status string, ground_truth_parent_passage_ids array<string>, ground_truth_chunk_ids_by_strategy map<string,array<string>>"


@dataclass(frozen=True)
class RetrievalConfig:
    """What a retrieval run reads from its configuration."""

    top_k: int = 30
    eval_k_values: tuple[int, ...] = (1, 3, 5, 10)
    mrr_k: int = 10
    rrf_k: int = 60
    retrieval_modes: tuple[str, ...] = ("dense", "hybrid_rrf")
    embedding_models: tuple[str, ...] = ()
    local_test_only_embedder: str = "TEST_ONLY:dim256"
    collection_name: str = "chunks"
    distance: str = "cosine"
    extra: dict = field(default_factory=dict)


def read_config(spark: SparkSession, path: str) -> RetrievalConfig:
    """A YAML (or JSON) configuration; keys that aren't read are kept in ``extra``."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    try:
        import yaml

        given = yaml.safe_load(text) or {}
    except ImportError:
        given = json.loads(text)
    names = {"top_k": int, "mrr_k": int, "rrf_k": int, "eval_k_values": tuple, "retrieval_modes": tuple, "local_test_only_embedder": str, "collection_name": str, "distance": str}
    known = {k: kind(given.pop(k)) for k, kind in names.items() if k in given}
    models = tuple(m["name"] if isinstance(m, dict) else m for m in given.pop("embedding_models", ()))
    return RetrievalConfig(**known, embedding_models=models, extra=given)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table. A count reads no column, so the scan takes the numbers of rows from the files' footers."""
    return spark.read.parquet(path).count()


def first_rows(frame: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows by a column: deterministic, unlike a bare limit. 0 gives none."""
    return frame.orderBy(order).limit(n)


def with_place(frame: DataFrame, name: str = "place") -> DataFrame:
    """A table's rows with their place in file order: file, then row within it."""
    return frame.select("*", F.concat_ws(":", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0")).alias(name))


def first_in_files(frame: DataFrame, n: int, name: str = "place") -> DataFrame:
    """The first ``n`` rows of a table in file order, with their place (see ``with_place``). 0 gives none.

    Rows are counted by file, from a scan that reads no column; the files before the last wanted row come whole, that one's
    rows by their number. Nothing is sorted, and no task reads more than its files. A row of numbers for each file of the
    table is joined by name.
    """
    counts = frame.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count("*").alias("_rows"))
    before = running_total(counts, [], ["_file"], F.col("_rows"), "_before").where(F.col("_before") < n).select("_file", "_before")
    rows = frame.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    placed = rows.join(before, F.col("_path") == F.col("_file")).where(F.col("_before") + F.col("_row") < n)
    place = F.concat_ws(":", "_path", F.lpad(F.col("_row").cast("string"), 12, "0"))
    return placed.select(*frame.columns, place.alias(name))


def write_table(frame: DataFrame, path: str, skip_empty: bool = False) -> bool:
    """Overwrite a Parquet table; with ``skip_empty`` nothing is written for no rows."""
    if skip_empty and frame.isEmpty():
        return False
    frame.write.mode("overwrite").parquet(path)
    return True


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks by strategy and language folders; the columns stay in the files."""
    chunks.withColumn("strategy", F.col("chunk_strategy")).withColumn("lang", F.col("language")).write.mode("overwrite").partitionBy("strategy", "lang").parquet(path)


def read_chunks(spark: SparkSession, path: str, strategies: Sequence[str] | None = None) -> DataFrame:
    """Chunks of all or some strategies; others' folders aren't listed for reading."""
    rows = spark.read.parquet(path)
    if strategies:
        rows = rows.where(F.col("strategy").isin(*strategies))
    return rows.drop("strategy", "lang")


def write_json_lines(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCHMARK).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file, stamped with the time."""
    stamped = report.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    stamped.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame | None:
    """A report, or None where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.json(path)
