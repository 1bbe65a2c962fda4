"""Adapters from the synthetic tables to the shapes that the operators take. Deterministic, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import QUERY_TYPES

TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a text table whose files give fewer tasks than there are cores is dealt out to as many."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in TEXTS and rows.rdd.getNumPartitions() < cores else rows


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, text, is_selected (the quality label, 0 where there is none)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text").join(labels, "doc_id", "left").select("doc_id", "lang", "text", F.coalesce("quality", F.lit(0)).cast("int").alias("is_selected"))


def raw_records(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """Raw records of ten documents each; English texts in one list, others in the other.

    ``broken`` plants problems by record number: null ids and passages, unequal lists, empty lists, odd marks.
    """
    docs = marked_documents(spark, sf_dir).withColumn("record", F.floor(F.col("doc_id") / 10).cast("long"))
    grouped = docs.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("doc_id", "lang", "text", "is_selected"))).alias("p"))
    english = F.transform("p", lambda p: F.when(p["lang"] == "en", p["text"]).otherwise(F.lit("")))
    translated = F.transform("p", lambda p: F.when(p["lang"] == "en", F.lit("")).otherwise(p["text"]))
    marks = F.transform("p", lambda p: p["is_selected"])
    none = F.array().cast("array<string>")
    n = F.col("record")
    if broken:
        english = F.when(n % 17 == 3, F.slice(english, 1, F.size("p") - 1)).when(n % 29 == 11, none).otherwise(english)
        translated = F.when(n % 29 == 11, none).otherwise(translated)
        marks = F.when(n % 29 == 11, F.array().cast("array<int>")).when(n % 23 == 7, F.transform("p", lambda p, i: i.cast("int"))).when(n % 37 == 5, F.lit(None)).otherwise(marks)
    inner = F.struct(english.alias("English_passages"), translated.alias("Translated_passages"), marks.alias("is_selected"))
    answered = F.exists("p", lambda p: p["is_selected"] == 1)
    answer = F.when(answered, "yes").otherwise(" No Answer Present. ")
    kind = F.get(F.array(*map(F.lit, QUERY_TYPES)), (n % 5).cast("int"))
    return grouped.select(
        F.lit("en").alias("source_lang"),
        F.lit("mul").alias("target_lang"),
        F.when(n % 4 == 0, F.lit(None)).when(n % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("m"), n)).cast("string").alias("meta"),
        F.when(F.lit(broken) & (n % 31 == 13), F.lit(None)).otherwise(n).cast("long").alias("query_id"),
        kind.alias("query_type"),
        (F.when(n % 19 == 6, F.lit(None)).otherwise(inner) if broken else inner).alias("passages"),
        F.concat(F.lit("What is "), n, F.lit("?")).alias("Eng_Query"),
        answer.alias("Eng_Answer"),
        F.concat(F.lit("q "), n).alias("query"),
        answer.alias("Answer"),
        "record",
    )


def single_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw record for each document, with ids that collide (doc_id mod 300) and content that repeats."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    inner = F.struct(F.array(F.when(F.col("lang") == "en", text).otherwise("")).alias("English_passages"), F.array(F.when(F.col("lang") == "en", F.lit("")).otherwise(text)).alias("Translated_passages"), F.array(F.lit(0)).alias("is_selected"))
    return docs.select(F.lit("en").alias("source_lang"), F.col("lang").alias("target_lang"), F.lit(None).cast("string").alias("meta"), (F.col("doc_id") % 300).alias("query_id"), F.lit("ENTITY").alias("query_type"), inner.alias("passages"), *[F.lit("").alias(c) for c in ("Eng_Query", "Eng_Answer", "query", "Answer")], F.col("doc_id").alias("record"))
