"""Profiling of tables whose columns aren't known beforehand, and of raw records."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def column_types(frame: DataFrame) -> dict[str, str]:
    return dict(frame.dtypes)


def null_counts(frame: DataFrame) -> DataFrame:
    """``column, n_null``, all columns in one pass."""
    one = frame.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in frame.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_null")) for c in frame.columns])
    return one.select(F.inline(pairs))


def repeated_keys(frame: DataFrame, key: str) -> DataFrame:
    """``n_repeated``: rows whose key an earlier row has; nulls count as equal."""
    return frame.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_repeated"))


def value_counts(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n``, nulls included, in one pass over grouping sets."""
    names = list(columns)
    if not names:
        raise ValueError("no column is named")
    cast = frame.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    grouped = cast.groupingSets([[c] for c in names], *names).agg(*[F.grouping(c).alias(f"g_{i}") for i, c in enumerate(names)], F.count("*").alias("n"))
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(names):
        name = F.when(F.col(f"g_{i}") == 0, F.lit(c)).otherwise(name)
        value = F.when(F.col(f"g_{i}") == 0, F.col(f"`{c}`")).otherwise(value)
    return grouped.select(name.alias("column"), value.alias("value"), "n")


def nested_lengths(frame: DataFrame, column: str) -> DataFrame:
    """``field, min_length, max_length, lengths``: sizes of the lists in a struct column (the 20 shortest distinct)."""
    kind = frame.schema[column].dataType
    if not isinstance(kind, T.StructType):
        raise ValueError(f"{column} is {kind.simpleString()}, not a struct")
    lists = [f.name for f in kind.fields if isinstance(f.dataType, T.ArrayType)]
    if not lists:
        raise ValueError(f"{column} has no list field")
    sizes = F.array(*[F.struct(F.lit(n).alias("field"), F.size(F.col(f"`{column}`.`{n}`")).alias("n")) for n in lists])
    rows = frame.select(F.inline(sizes)).where("n >= 0").groupBy("field", "n").count()
    return rows.groupBy("field").agg(F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.array_join(F.slice(F.array_sort(F.collect_list("n")), 1, 20), ",").alias("lengths"))


def nested_types(frame: DataFrame, column: str) -> dict[str, str]:
    """Inner field types of a struct column; {} for others."""
    kind = frame.schema[column].dataType
    return {f.name: f.dataType.simpleString() for f in kind.fields} if isinstance(kind, T.StructType) else {}


def selection_stats(raw: DataFrame) -> DataFrame:
    """Passages and selected passages by record, in one row."""
    english, marks = F.size("passages.English_passages"), F.size(F.filter("passages.is_selected", lambda v: v.try_cast("int") == 1))
    rows = raw.select(F.when(english >= 0, english).alias("n"), F.when(marks >= 0, marks).alias("s"))
    return rows.agg(
        F.min("n").alias("min_passages"),
        F.max("n").alias("max_passages"),
        F.min("s").alias("min_selected"),
        F.max("s").alias("max_selected"),
        F.count_if(F.col("s") == 0).alias("records_with_zero_selected"),
        F.count_if(F.col("s") >= 1).alias("records_with_selected"),
    )


def no_answer_stats(raw: DataFrame, order: str, checked: int = 20) -> DataFrame:
    """No-answer rows and their share; of the first ``checked`` by ``order``, how many have no selected passage.

    Null and blank answers don't count here, unlike in normalisation.
    """
    marked = raw.select(order, F.lower(X.strip("Eng_Answer")).isin("no answer present.", "no answer present").alias("none"), F.coalesce(F.forall("passages.is_selected", lambda v: v.try_cast("int") == 0), F.lit(False)).alias("zero"), F.col("passages.is_selected").isNotNull().alias("listed"))
    total = marked.agg(F.count_if("none").alias("no_answer_count"), F.round(F.try_divide(F.count_if("none"), F.count("*")), 4).alias("no_answer_ratio"))
    first = marked.where("none").orderBy(order).limit(checked).agg(F.count_if("listed").alias("checked_sample_size"), F.count_if(F.col("listed") & F.col("zero")).alias("confirmed_all_zero"))
    return total.crossJoin(first)


def text_lengths(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, min_chars, max_chars, mean_chars, median_chars`` of non-null texts; the median is exact."""
    rows = frame.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.char_length(F.col(f"`{c}`").cast("string")).alias("n")) for c in columns]))).where("n is not null")
    return rows.groupBy("column").agg(F.min("n").alias("min_chars"), F.max("n").alias("max_chars"), F.round(F.avg("n"), 2).alias("mean_chars"), F.percentile("n", F.lit(0.5)).alias("median_chars"))


def sample_records(frame: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first rows by ``order`` as JSON."""
    return frame.orderBy(order).limit(n).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns])).alias("record"))


def file_sizes(frame: DataFrame) -> DataFrame:
    """``n_files, bytes`` of a table read from files."""
    files = frame.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.count("*").alias("n_files"), F.sum("file_size").alias("bytes"))


def failure_report(error: Exception, phase: str) -> str:
    """A report in place of a result, as JSON."""
    return json.dumps({"status": "FAILED", "phase": phase, "error_type": type(error).__name__, "error": str(error)}, ensure_ascii=False)


def any_null(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a null in one of the columns."""
    return frame.where(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in columns]))
