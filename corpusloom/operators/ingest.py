"""Raw records to normalised records: validation, mapping, exact dedup, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.frames import running_total

REQUIRED_FIELDS = ("source_lang", "target_lang", "query_id", "query_type", "passages", "Eng_Query", "Eng_Answer", "query", "Answer")
REQUIRED_PASSAGE_KEYS = ("English_passages", "Translated_passages", "is_selected")
PASSAGES = "array<struct<passage_index:int,text_english:string,text_target:string,is_selected:int>>"


# The texts of problems and warnings below are fixed values: reports are compared by them.


def schema_problem(schema: T.StructType) -> str | None:
    """What makes every row of a table corrupt: a missing field, passages of the wrong type, a missing key."""
    for name in REQUIRED_FIELDS:
        if name not in schema.names:
            return f"Missing required top-level field: '{name}'"
    kind = schema["passages"].dataType
    if not isinstance(kind, T.StructType):
        return f"passages is not a dict/object (got {kind.simpleString()})"
    for name in REQUIRED_PASSAGE_KEYS:
        if name not in kind.names:
            return f"passages missing required key: '{name}'"
    return None


def _lists() -> tuple[Column, Column, Column]:
    return tuple(F.col(f"passages.{k}") for k in REQUIRED_PASSAGE_KEYS)


def corruption_reason(schema: T.StructType) -> Column:
    """The first fatal problem of a row, null where it is usable. A selection mark that is neither an integer nor
    blank is fatal as well, since it can't be normalised."""
    whole = schema_problem(schema)
    if whole:
        return F.lit(whole)
    english, translated, selected = _lists()
    lengths = F.concat(F.lit("Mismatched passage list lengths: English_passages="), F.size(english), F.lit(", Translated_passages="), F.size(translated), F.lit(", is_selected="), F.size(selected))
    odd = F.exists(selected, lambda v: v.isNull() | (v.try_cast("int").isNull() & (X.strip(v.cast("string")) != "")))
    return (
        F.when(F.col("query_id").isNull(), "query_id is null")
        .when(F.col("passages").isNull(), "passages is null")
        .when(english.isNull() | translated.isNull() | selected.isNull(), "One or more passage sub-fields is null")
        .when((F.size(english) != F.size(translated)) | (F.size(translated) != F.size(selected)), lengths)
        .when(odd, "is_selected is not an integer")
    )


def warnings() -> Column:
    """Non-fatal problems of a row, in the order of their checks."""
    english, translated, selected = _lists()
    empty = F.when((F.size(english) == 0) & (F.size(translated) == 0), F.array(F.lit("empty_passages: both English_passages and Translated_passages are empty")))
    fields = F.array_compact(F.array(*[F.when(~F.is_valid_utf8(c), F.lit(f"unicode_encode_issue:{c}")) for c in ("query", "Eng_Query", "Answer", "Eng_Answer")]))
    texts = F.array_compact(F.transform(translated, lambda t, i: F.when(~F.is_valid_utf8(t), F.concat(F.lit("unicode_encode_issue:Translated_passages["), i, F.lit("]")))))
    mark = lambda kind, v, i: F.concat(F.lit(f"{kind}:index="), i, F.lit(":value="), v)
    whole = lambda v: v.try_cast("int")
    marks = F.array_compact(F.transform(selected, lambda v, i: F.when(whole(v).isNull(), mark("non_integer_is_selected", v, i)).when(~whole(v).isin(0, 1), mark("unexpected_is_selected_value", v, i))))
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(part, none) for part in (empty, fields, texts, marks)])


def validate(raw: DataFrame) -> DataFrame:
    """``raw`` with ``corruption_reason`` and ``validation_warnings``."""
    reason = corruption_reason(raw.schema)
    marked = raw.withColumn("corruption_reason", reason)
    if schema_problem(raw.schema):
        return marked.withColumn("validation_warnings", F.array().cast("array<string>"))
    return marked.withColumn("validation_warnings", F.when(F.col("corruption_reason").isNull(), warnings()).otherwise(F.array().cast("array<string>")))


def split_corrupt(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and corrupt ones."""
    return validated.where("corruption_reason is null").drop("corruption_reason"), validated.where("corruption_reason is not null")


def corrupt_examples(validated: DataFrame, order: str, most: int = 10) -> DataFrame:
    """The first corrupt rows by ``order``."""
    return validated.where("corruption_reason is not null").select(order, "corruption_reason").orderBy(order).limit(most)


def warning_counts(validated: DataFrame) -> DataFrame:
    """Rows by kind of warning (its text before the first colon)."""
    kinds = validated.select(F.explode("validation_warnings").alias("warning"))
    return kinds.groupBy(F.substring_index("warning", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


def zipped_passages() -> Column:
    """One struct for each translated passage; a missing English text is empty, a missing mark 0."""
    english, translated, selected = _lists()
    return F.transform(
        translated,
        lambda t, i: F.struct(
            i.cast("int").alias("passage_index"),
            X.filled(F.get(english, i)).alias("text_english"),
            X.filled(t).alias("text_target"),
            F.coalesce(F.get(selected, i).try_cast("int"), F.lit(0)).alias("is_selected"),
        ),
    )


def record_hash() -> Column:
    """SHA-256 of the record's content: seven stripped fields and the passages; neither query_id nor meta."""
    names = ("Answer", "Eng_Answer", "Eng_Query", "query", "query_type", "source_lang", "target_lang")
    content = F.struct(*[X.strip(c).alias(c) for c in names[:3]], F.col("passages"), *[X.strip(c).alias(c) for c in names[3:]])
    return F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256)


def meta_json(schema: T.StructType) -> Column:
    """meta as JSON text: an object as it is, other values as {"raw": value}, null and empty as null."""
    if "meta" not in schema.names:
        return F.lit(None).cast("string")
    kind = schema["meta"].dataType
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json("meta")
    value = F.col("meta").cast("string") if not isinstance(kind, T.ArrayType) else F.to_json("meta")
    return F.when(value.isNull() | (value == ""), None).otherwise(F.to_json(F.struct(value.alias("raw"))))


def normalize(usable: DataFrame, order: str | Sequence[str] | None = None) -> DataFrame:
    """Usable raw rows as normalised records (NFC texts, zipped passages, answer status, content hash).

    The hash is of the texts before NFC. ``order`` names columns to carry along, for ``dedup``. Rows that aren't usable
    give records without meaning, and no error, as long as the table has all fields.
    """
    order = [order] if isinstance(order, str) else list(order or ())
    rows = usable.withColumn("_hash", record_hash()).withColumn("_meta", meta_json(usable.schema)).withColumn("_zipped", zipped_passages())
    texts = X.nfc_all(F.flatten(F.transform("_zipped", lambda p: F.array(p["text_english"], p["text_target"]))))
    rows = rows.withColumn("_texts", texts)
    rebuilt = F.transform(
        "_zipped",
        lambda p, i: F.struct(p["passage_index"].alias("passage_index"), F.get("_texts", 2 * i).alias("text_english"), F.get("_texts", 2 * i + 1).alias("text_target"), p["is_selected"].alias("is_selected")),
    )
    answer = X.nfc("Eng_Answer")
    warned = F.col("validation_warnings") if "validation_warnings" in usable.columns else F.array().cast("array<string>")
    return rows.withColumn("_answer", answer).select(
        F.col("query_id").cast("string").alias("query_id"),
        F.col("query_id").cast("long").alias("raw_query_id"),
        *[X.nfc(c).alias(c) for c in ("source_lang", "target_lang", "query_type")],
        X.nfc("query").alias("query_target"),
        X.nfc("Eng_Query").alias("query_english"),
        X.nfc("Answer").alias("answer_target"),
        F.col("_answer").alias("answer_english"),
        X.has_answer("_answer").alias("has_answer"),
        X.answer_status("_answer").alias("answer_status"),
        rebuilt.cast(PASSAGES).alias("passages"),
        F.col("_meta").alias("meta"),
        F.col("_hash").alias("source_record_hash"),
        F.lit(False).alias("is_duplicate_query_id"),
        F.lit(False).alias("is_exact_duplicate"),
        warned.alias("validation_warnings"),
        *map(F.col, order),
    )


def mark_duplicates(records: DataFrame, order: str) -> DataFrame:
    """``is_exact_duplicate`` where an earlier row by ``order`` (a different value for each row) has the same content.

    The first row is an aggregate of hashes, so that content that a third of all rows share is combined before
    it moves, and records meet the first rows by their own place, never by a shared hash.
    """
    firsts = records.groupBy("source_record_hash").agg(F.min(order).alias("_first")).select("_first")
    return records.join(firsts, F.col(order) == F.col("_first"), "left").withColumn("is_exact_duplicate", F.col("_first").isNull()).select(*records.columns)


def firsts(records: DataFrame, order: str) -> DataFrame:
    """``_place`` of the first of equal records by ``order``, and ``_nth``: how many such records of its query_id are before it.

    Ids and places alone are deduplicated and numbered, a common id in many ranges.
    """
    keys = records.groupBy("source_record_hash").agg(F.min(F.struct(F.col(order).alias("place"), "raw_query_id")).alias("first")).select("first.*")
    return running_total(keys, ["raw_query_id"], ["place"], F.lit(1), "_nth").select(F.col("place").alias("_place"), "_nth")


def numbered(records: DataFrame) -> DataFrame:
    """Records with ``_nth`` (see ``firsts``): the n-th later one of a query_id gets the suffix __dup{n}."""
    renamed = F.when(F.col("_nth") > 0, F.concat("query_id", F.lit("__dup"), "_nth")).otherwise(F.col("query_id"))
    return records.withColumn("query_id", renamed).withColumn("is_duplicate_query_id", F.col("_nth") > 0)


def dedup(records: DataFrame, order: str) -> DataFrame:
    """Keep the first of equal records; the n-th later record of a query_id gets the suffix __dup{n}.

    Records move once, to their own place.
    """
    return numbered(records.join(firsts(records, order), F.col(order) == F.col("_place"))).select(*records.columns)


def dedup_stats(records: DataFrame, order: str) -> DataFrame:
    """Four counters of ``dedup``, in one row."""
    firsts = records.groupBy("source_record_hash").agg(F.count("*").alias("rows"), F.min_by("raw_query_id", order).alias("raw_query_id"))
    kept = firsts.groupBy("raw_query_id").agg(F.count("*").alias("n"), F.sum(F.col("rows") - 1).alias("dropped"))
    return kept.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("unique_source_record_hashes"),
        F.coalesce(F.sum("dropped"), F.lit(0)).alias("exact_duplicates_dropped"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("content_distinct_duplicate_query_ids"),
        F.count_if(F.col("n") > 1).alias("query_ids_with_multiple_occurrences"),
    ).select("unique_source_record_hashes", "exact_duplicates_dropped", "content_distinct_duplicate_query_ids", "query_ids_with_multiple_occurrences")


def flatten(records: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return records.withColumn("passages", F.to_json("passages")).withColumn("validation_warnings", F.to_json("validation_warnings"))


def reconstruct(flat: DataFrame) -> DataFrame:
    """The reverse of ``flatten``; null or broken JSON gives an empty list."""
    passages = F.coalesce(F.from_json("passages", PASSAGES), F.array().cast(PASSAGES))
    warned = F.coalesce(F.from_json("validation_warnings", "array<string>"), F.array().cast("array<string>"))
    return flat.withColumn("passages", passages).withColumn("validation_warnings", warned)


def normalization_report(validated: DataFrame, records: DataFrame, order: str, kept: DataFrame | None = None) -> DataFrame:
    """The ingestion counters, in one row; ``kept``: what ``dedup`` gave, where it is written already."""
    rows = validated.agg(F.count("*").alias("input_rows_examined"), F.count_if(F.col("corruption_reason").isNotNull()).alias("malformed_records"), F.count_if(F.exists("validation_warnings", lambda w: w.startswith("empty_passages"))).alias("empty_passages_records"))
    kept = (dedup(records, order) if kept is None else kept).agg(
        F.count("*").alias("normalized_records"), F.count_if("has_answer").alias("answer_present_records"), F.count_if(~F.col("has_answer")).alias("no_answer_records"), F.coalesce(F.sum(F.size("passages")), F.lit(0)).alias("total_passages")
    )
    return rows.crossJoin(kept).crossJoin(dedup_stats(records, order))
