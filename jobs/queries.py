"""The jobs as catalogue queries: each runs twice into one new folder, and gives the output as it stands then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.frames import shared_folder
from corpusloom.plans import oracle
from jobs import chunk_corpus, term_index


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints; its files stay."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_chunk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _folder(spark, "chunk-corpus")
    for _ in range(2):
        chunk_corpus.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", output)
    rows = spark.read.parquet(f"{output}/chunks")
    return rows.select("chunk_id", "chunk_strategy", "language", "is_selected", F.col("token_count_estimate").alias("tokens"), F.col("char_count").alias("chars"), "chunk_text_hash", "is_duplicate_chunk", "duplicate_of_chunk_id", "below_min_length")


def job2_term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _folder(spark, "term-index")
    for _ in range(2):
        term_index.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", output)
    return spark.read.parquet(f"{output}/hits").select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), "source", "lang")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_chunk_corpus": job1_chunk_corpus, "job2_term_index": job2_term_index}


_KEPT = f"""marked AS (SELECT d.doc_id, d.lang, coalesce(d.text, '') AS text, CAST(coalesce(l.quality, 0) AS INTEGER) AS is_selected FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)
), ps AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS query_id, 0 AS passage_index, is_selected, CASE WHEN lang = 'en' THEN 'english' ELSE 'target' END AS language, text, {oracle.strip('text')} AS prim, doc_id || '_p0' AS parent, 'DESCRIPTION' AS query_type
  FROM marked QUALIFY row_number() OVER (PARTITION BY lang = 'en', text, is_selected ORDER BY doc_id) = 1
)"""


def oracle_sql() -> dict[str, str]:
    chunks = oracle.CHUNKS.replace(oracle.PASSAGES, _KEPT)
    ranked = oracle.bm25_ctes("SELECT doc_id AS chunk_id, text FROM documents", "SELECT item_id AS query_id, text FROM benchmark", 10)
    return {
        "job1_chunk_corpus": f"WITH {chunks} SELECT chunk_id, chunk_strategy, language, is_selected, token_count_estimate AS tokens, char_count AS chars, chunk_text_hash, is_duplicate_chunk, duplicate_of_chunk_id, below_min_length FROM chunks WHERE {oracle.strip('text')} <> ''",
        "job2_term_index": f"WITH {ranked} SELECT query_id, rank, doc_id, round(score, 6) AS score, source, lang FROM sparse JOIN documents ON doc_id = chunk_id",
    }
