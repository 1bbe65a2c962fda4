"""Documents to a chunk corpus for retrieval: validated, normalised, without exact copies, in several chunk views.

    python -m jobs.chunk_corpus --documents PATH --labels PATH --output PATH [--config jobs/chunk_corpus.json]

Writes ``chunks`` (by chunk_strategy and language), ``rejected`` (documents that can't be used, by reason) and
``report`` (a row for each strategy) into the output folder. A run replaces them all, so it can be run again.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunking, ingest, reports
from jobs.common import CHANGED, command_line, read_config, settings_kept

DEFAULTS = {"source_lang": "en", "target_lang": "mul", "query_type": "DESCRIPTION", "strategies": list(chunking.STRATEGIES), "least_chars": 10, "drop_duplicates": False, "drop_short": False}
PATHS = {"documents": "Parquet: doc_id, lang, text", "labels": "Parquet: doc_id, quality; 1 marks a selected passage", "output": "folder to write"}
log = logging.getLogger("jobs.chunk_corpus")

#: Of the chunks' files. A split chunk has its passage's whole text beside its own: a dictionary that holds such texts writes
#: each once, and zstd finds what it doesn't hold. Row groups are small, as a task has a file of each folder open. The least and
#: greatest text of a page, which take a comparison of each text with both, serve nobody.
FILES = {"compression": "zstd", "parquet.block.size": 32 << 20, "parquet.dictionary.page.size": 8 << 20}
FILES |= {"parquet.size.statistics.enabled": "false"} | {f"parquet.column.statistics.enabled#{c}": "false" for c in ("text", "text_english", "text_target", "metadata")}
#: One more than the folders that a task writes at once, each strategy's in both languages: Spark sorts the rest of a task's
#: rows as soon as so many files are open, not beyond it.
FOLDERS = 2 * len(chunking.STRATEGIES) + 1
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def raw_records(documents: DataFrame, labels: DataFrame, known: dict, carried: Sequence[str] = ()) -> DataFrame:
    """A record of one passage for each document: English texts in one list, others in the other; marks from the labels.

    Of several labels of a document the largest counts. ``place`` is the document's id, by which copies are told apart;
    ``carried`` columns stay beside it.
    """
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    text, english = F.coalesce("text", F.lit("")), F.coalesce(F.col("lang") == "en", F.lit(False))
    inner = F.struct(
        F.array(F.when(english, text).otherwise("")).alias("English_passages"),
        F.array(F.when(english, "").otherwise(text)).alias("Translated_passages"),
        F.array(F.coalesce("quality", F.lit(0)).cast("int")).alias("is_selected"),
    )
    fixed = [F.lit(known[c]).alias(c) for c in ("source_lang", "target_lang", "query_type")]
    empty = [F.lit("").alias(c) for c in ("Eng_Query", "Eng_Answer", "query", "Answer")]
    rows = documents.select("doc_id", "lang", "text", *carried).join(marks, "doc_id", "left")
    return rows.select(*fixed, *empty, F.lit(None).cast("string").alias("meta"), F.col("doc_id").alias("query_id"), inner.alias("passages"), F.col("doc_id").alias("place"), *carried)


def records(documents: DataFrame, labels: DataFrame, known: dict) -> tuple[DataFrame, DataFrame]:
    """Normalised records without exact copies, and corrupt ones.

    Which records are equal, or corrupt, is found with a text's digest in its place. Documents then meet the first of
    equal ones and their labels at their own id, so that a text moves once at most, and only what stays is normalised.
    """
    digests = documents.withColumn("text", F.sha2(F.coalesce("text", F.lit("")), 256))
    usable, corrupt = ingest.split_corrupt(ingest.validate(raw_records(digests, labels, known)))
    first = ingest.firsts(ingest.normalize(usable, "place"), "place")
    kept = raw_records(documents.join(first, F.col("doc_id") == F.col("_place")), labels, known, ["_nth"])
    whole, _ = ingest.split_corrupt(ingest.validate(kept))
    return ingest.numbered(ingest.normalize(whole, "_nth")).drop("_nth"), corrupt


def run(spark: SparkSession, documents: str, labels: str, output: str, config: str | None = None) -> dict[str, int]:
    """Build the corpus; returns the rows read and written by table."""
    known = read_config(spark, config, DEFAULTS)
    with settings_kept(spark, (*CHANGED, WRITERS)):
        spark.conf.set(WRITERS, str(FOLDERS))
        docs, marks = spark.read.parquet(documents), spark.read.parquet(labels)
        usable, corrupt = records(docs, marks, known)
        chunks = chunking.flagged_views(usable, known["strategies"], known["least_chars"])
        kept = chunking.drop_flagged(chunks, known["drop_duplicates"], known["drop_short"])
        kept.write.mode("overwrite").options(**FILES).partitionBy("chunk_strategy", "language").parquet(f"{output}/chunks")
        corrupt.groupBy("corruption_reason").agg(F.count("*").alias("documents")).write.mode("overwrite").parquet(f"{output}/rejected")
        written = spark.read.schema(kept.schema).parquet(f"{output}/chunks")
        reports.strategy_report(written).write.mode("overwrite").json(f"{output}/report")
        counts = {"documents": docs.count(), "labels": marks.count(), "rejected": int(spark.read.parquet(f"{output}/rejected").agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]), "chunks": written.count()}
    log.info("read %d documents from %s and %d labels from %s", counts["documents"], documents, counts["labels"], labels)
    log.info("rejected %d documents; wrote %d chunks to %s/chunks", counts["rejected"], counts["chunks"], output)
    return counts


if __name__ == "__main__":
    command_line("chunk corpus", PATHS, run)
