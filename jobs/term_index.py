"""A BM25 index that grows with its documents, and what each query finds in it.

    python -m jobs.term_index --documents PATH --queries PATH --output PATH [--config jobs/term_index.json]

The documents are read as a file stream: each run indexes the files that no earlier run has, as new segments, and
stops when there are none left. Then all queries are searched in the whole index. Into the output folder go
``index`` (by segment), ``checkpoint`` (the stream's) and ``hits`` (by language, replaced by each run).
A batch that is run again after a failure writes its own segment again; a run without new files changes nothing.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.term_index import TermIndex
from jobs.common import command_line, read_config, settings_kept

DEFAULTS = {"top_k": 10, "k1": 1.5, "b": 0.75, "epsilon": 0.25, "files_per_batch": None}
PATHS = {"documents": "Parquet files that only grow in number: doc_id, text, lang, source", "queries": "Parquet: item_id, text", "output": "folder to write"}
log = logging.getLogger("jobs.term_index")


def as_pattern(path: str) -> str:
    """A path that matches itself alone: file streams take a single file only through a pattern."""
    return f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, queries: str, output: str, config: str | None = None) -> dict[str, int]:
    """Index what is new and search; returns the numbers of rows read and written."""
    known = read_config(spark, config, DEFAULTS)
    documents = documents.rstrip("/")
    index, read = TermIndex(spark, f"{output}/index"), []

    def add(batch: DataFrame, number: int) -> None:
        index.add(batch, number, "doc_id", "text")

    with settings_kept(spark):
        source = spark.readStream.schema(spark.read.parquet(documents).schema)
        if known["files_per_batch"]:
            source = source.option("maxFilesPerTrigger", known["files_per_batch"])
        stream = source.parquet(as_pattern(documents)).writeStream.foreachBatch(add).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
        stream.awaitTermination()
        read = [p["numInputRows"] for p in stream.recentProgress]
        asked = spark.read.parquet(queries)
        hits = index.search(asked, known["top_k"], known["k1"], known["b"], known["epsilon"], "item_id")
        found = hits.withColumnRenamed("chunk_id", "doc_id").join(spark.read.parquet(documents).select("doc_id", "lang", "source"), "doc_id")
        found = found.select("query_id", "rank", "doc_id", "score", "source", "lang")
        found.write.mode("overwrite").partitionBy("lang").parquet(f"{output}/hits")
        counts = {"new_documents": sum(read), "documents": index.statistics().rows, "queries": asked.count(), "hits": spark.read.schema(found.schema).parquet(f"{output}/hits").count()}
    log.info("read %d new documents from %s; the index at %s/index has %d", counts["new_documents"], documents, output, counts["documents"])
    log.info("read %d queries from %s; wrote %d hits to %s/hits", counts["queries"], queries, counts["hits"], output)
    return counts


if __name__ == "__main__":
    command_line("term index", PATHS, run)
