"""Structural reports over chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: The known query types. Fixed values.
QUERY_TYPES = ("DESCRIPTION", "NUMERIC", "ENTITY", "PERSON", "LOCATION")

COMPARED = {"chunk_strategy", "chunk_text_hash", "is_duplicate_chunk", "duplicate_of_chunk_id", "below_min_length", "parent_passage_id", "query_id", "is_selected", "char_count"}


def require_columns(chunks: DataFrame, names: set[str] = COMPARED) -> None:
    """Raise where a report's columns are missing."""
    missing = names - set(chunks.columns)
    if missing:
        raise ValueError(f"chunks lack the columns {', '.join(sorted(missing))}")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """``dimension, value, n``: chunks by strategy, language and query type, in one pass over grouping sets."""
    grouped = chunks.groupingSets([["chunk_strategy"], ["language"], ["query_type"]], "chunk_strategy", "language", "query_type").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    dimension = F.when(F.col("g") == 3, "chunk_strategy").when(F.col("g") == 5, "language").otherwise("query_type")
    value = F.when(F.col("g") == 3, F.col("chunk_strategy")).when(F.col("g") == 5, F.col("language")).otherwise(F.col("query_type"))
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "n")


def chunk_report(chunks: DataFrame) -> DataFrame:
    """Totals and lengths of written chunks, in one row."""
    return chunks.agg(
        F.count("*").alias("output_chunks"),
        F.count_if(F.col("is_selected") != 0).alias("selected_chunks"),
        F.count_if(F.col("is_selected") == 0).alias("non_selected_chunks"),
        F.round(F.avg("char_count"), 2).alias("average_chunk_length_chars"),
        F.min("char_count").cast("long").alias("min_chunk_length_chars"),
        F.max("char_count").cast("long").alias("max_chunk_length_chars"),
    )


def merged_report(chunks: DataFrame, normalization: DataFrame | None) -> DataFrame:
    """The chunk report beside the ingestion counters; nulls where there is no ingestion report."""
    own = chunk_report(chunks)
    names = ("input_rows_examined", "malformed_records", "empty_passages_records", "answer_present_records", "no_answer_records", "exact_duplicates_dropped", "content_distinct_duplicate_query_ids")
    if normalization is None:
        return own.select("*", *[F.lit(None).cast("long").alias(c) for c in names])
    return own.crossJoin(F.broadcast(normalization.select(*names).limit(1)))


def validation_report(chunks: DataFrame) -> DataFrame:
    """Problems by partition (chunk_strategy, language): eleven critical counts, one of warnings, the verdict.

    Ids are counted by group first, so that repeated ids are found without holding all ids of a partition. A row's
    problems are bits of one number, and an unknown query type is a row beside its chunk's, so that what is grouped by id
    is counts alone.
    """
    text = X.filled("text")
    stripped = X.strip("text")
    row_checks = {
        "null_chunk_id": F.col("chunk_id").isNull(),
        "null_query_id": F.col("query_id").isNull(),
        "invalid_language": ~F.coalesce(F.col("language").isin("target", "english"), F.lit(False)),
        "negative_passage_index": F.col("passage_index") < 0,
        "invalid_is_selected": ~F.coalesce(F.col("is_selected").isin(0, 1), F.lit(False)),
        "empty_text": stripped == "",
        "orphan_parent": ~F.col("parent_passage_id").eqNullSafe(F.concat("query_id", F.lit("_p"), "passage_index")),
        "leaked_no_answer": F.lower(stripped) == "no answer present.",
        "bad_unicode": ~F.is_valid_utf8(text),
        "bad_metadata": ~X.json_valid("metadata"),
    }
    unknown = ~F.coalesce(F.col("query_type").isin(*QUERY_TYPES), F.lit(False))
    keys = ["chunk_strategy", "language"]
    counted = [*row_checks, "unknown_query_type"]
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(v, F.lit(1 << at)).otherwise(F.lit(0)) for at, v in enumerate([*row_checks.values(), unknown])])
    none = F.lit(None).cast("string")
    own = F.struct(F.lit(True).alias("chunk"), F.col("chunk_id").alias("id"), none.alias("odd"), bits.alias("bits"))
    odd = F.struct(F.lit(False).alias("chunk"), none.cast(chunks.schema["chunk_id"].dataType).alias("id"), F.col("query_type").alias("odd"), F.lit(0).alias("bits"))
    rows = chunks.select(*keys, F.explode(F.when(unknown, F.array(own, odd)).otherwise(F.array(own))).alias("_row")).select(*keys, "_row.*")
    sums = [F.count_if(F.col("bits").bitwiseAND(F.lit(1 << at)) != 0).alias(c) for at, c in enumerate(counted)]
    by_id = rows.groupBy(*keys, "chunk", "id", "odd").agg(F.count("*").alias("n"), *sums)
    repeated = F.sum(F.when(F.col("chunk"), F.col("n") - 1))
    out = by_id.groupBy(*keys).agg(F.sum(F.when(F.col("chunk"), F.col("n"))).alias("rows"), repeated.alias("duplicate_chunk_id"), *[F.sum(c).alias(c) for c in counted], F.array_join(F.slice(F.array_sort(F.collect_set("odd")), 1, 10), ",").alias("unknown_values"))
    critical = ["duplicate_chunk_id", *row_checks]
    passed = F.lit(True)
    for c in critical:
        passed &= F.col(c) == 0
    return out.select(*keys, "rows", *critical, "unknown_query_type", "unknown_values", passed.alias("passed"))


def passed(report: DataFrame) -> bool:
    """The verdict over all partitions."""
    return report.where("not passed").isEmpty()


def strategy_report(chunks: DataFrame) -> DataFrame:
    """By strategy: chunks, duplicates and their rate, short chunks, mean length, selected passages represented."""
    require_columns(chunks)
    return chunks.groupBy("chunk_strategy").agg(
        F.count("*").alias("total_chunks"),
        F.count_if("is_duplicate_chunk").alias("duplicate_chunks"),
        F.round(F.count_if("is_duplicate_chunk") / F.count("*") * 100, 2).alias("duplicate_rate_pct"),
        F.count_if("below_min_length").alias("below_min_chunks"),
        F.round(F.avg("char_count"), 2).alias("average_length"),
        F.count_distinct(F.when(F.col("is_selected") == 1, F.col("parent_passage_id"))).alias("selected_passages"),
    )


def comparison_report(chunks: DataFrame) -> DataFrame:
    """The corpus-wide comparison in one row: duplication within passages and of texts anywhere, averages, extremes."""
    require_columns(chunks)
    total = chunks.agg(
        F.count("*").alias("total_chunks"),
        F.count_if("is_duplicate_chunk").alias("duplicate_chunks"),
        F.count_if(~F.col("is_duplicate_chunk")).alias("canonical_chunks"),
        F.round(F.count_if("is_duplicate_chunk") / F.count("*"), 4).alias("duplicate_ratio"),
        F.count_distinct("parent_passage_id").alias("unique_parent_passages"),
        F.count_distinct("query_id").alias("unique_source_records"),
        F.coalesce(F.sum("is_selected"), F.lit(0)).alias("selected"),
        F.count_if("below_min_length").alias("below_min"),
    )
    total = total.withColumns({
        "non_selected": F.col("total_chunks") - F.col("selected"),
        "chunks_per_passage": F.round(F.try_divide("total_chunks", "unique_parent_passages"), 3),
        "chunks_per_record": F.round(F.try_divide("total_chunks", "unique_source_records"), 3),
        "below_min_pct": F.round(F.try_divide("below_min", "total_chunks") * 100, 2),
    })
    texts = chunks.groupBy("chunk_text_hash").count().agg(F.count("*").alias("unique_texts"), F.count_if(F.col("count") > 1).alias("texts_more_than_once"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("instances_beyond_first"))
    by = strategy_report(chunks)
    name, n, mean = F.col("chunk_strategy"), F.col("total_chunks"), F.col("average_length")
    extremes = by.agg(
        F.min(F.struct(n, name))["chunk_strategy"].alias("fewest_chunks"),
        F.min(F.struct(-n, name))["chunk_strategy"].alias("most_chunks"),
        F.min(F.struct(mean, name))["chunk_strategy"].alias("most_compact"),
        F.min(F.struct(-mean, name))["chunk_strategy"].alias("least_compact"),
    )
    return total.crossJoin(texts).crossJoin(extremes)


def length_histogram(chunks: DataFrame) -> DataFrame:
    """``chunk_strategy, bucket, n``; a null strategy is all of them."""
    rows = chunks.select("chunk_strategy", X.length_bucket("char_count").alias("bucket"))
    return rows.groupingSets([["chunk_strategy", "bucket"], ["bucket"]], "chunk_strategy", "bucket").agg(F.count("*").alias("n"))
