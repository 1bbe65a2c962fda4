"""The pipeline's jobs from files to files: each reads tables, writes tables and a report, and returns what it reports."""

from __future__ import annotations

import json
import time
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import scratch_path, stored
from ..operators import benchmark as B
from ..operators import chunking as C
from ..operators import evaluation as E
from ..operators import ingest as I
from ..operators import profile as P
from ..operators import reports as R
from ..operators import retrieval as S
from ..sources import tables
from ..sources.term_index import TermIndex
from ..sources.vector_store import VectorCollection
from ..streaming.index_build import build_index


#: What counts records, where a table has none.
RECORD = "place string, source_record_hash string, raw_query_id long, has_answer boolean, passages array<int>"
# The keys of manifests and run reports below are fixed values of their formats.
NO_LEAK = "Answers and selection marks are never embedded, stored in queries or used as a filter; marks serve for ground truth alone."


def _one_row(spark: SparkSession, *rows: dict) -> DataFrame:
    """Rows of a report as JSON, so that any value has a place."""
    texts = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    schema = F.schema_of_json(F.lit(json.dumps(rows[0])))
    return texts.select(F.from_json("value", schema).alias("r")).select("r.*")


def ingest(spark: SparkSession, file: str, output: str, limit: int | None = None) -> DataFrame:
    """Raw Parquet to normalised records; ``limit`` counts malformed rows too, in file order. Returns the report.

    The raw table is read once: validated and normalised rows go into a table of the session, by whether they are usable,
    and everything else reads that.
    """
    began = time.perf_counter()
    rows = spark.read.parquet(file)
    rows = tables.with_place(rows) if limit is None else tables.first_in_files(rows, limit)
    validated = I.validate(rows)
    checks = ["place", "corruption_reason", "validation_warnings"]
    if I.schema_problem(rows.schema):
        checked, records = stored(validated.select(*checks), "ingest"), None
    else:
        carried = I.normalize(validated, checks[:2]).withColumn("usable", F.col("corruption_reason").isNull())
        path = scratch_path(spark, "ingest")
        carried.write.mode("overwrite").partitionBy("usable").parquet(path)
        whole = spark.read.schema(carried.schema).parquet(path)
        checked, records = whole.select(*checks), whole.where("usable").drop("usable", "corruption_reason")
        tables.write_table(I.dedup(records, "place").drop("place"), f"{output}/normalized", skip_empty=True)
    written = spark.read.parquet(f"{output}/normalized") if records is not None and not records.isEmpty() else None
    empty = validated.sparkSession.createDataFrame([], RECORD) if records is None else records
    report = I.normalization_report(checked, empty, "place", empty if written is None else written)
    about = {
        "input_file": F.lit(file),
        "limit_applied": F.lit(limit).cast("long"),
        "input_rows_total_in_file": F.lit(tables.row_count(spark, file)).cast("long"),
        "validation_warnings_total": F.lit(checked.agg(F.coalesce(F.sum(F.size("validation_warnings")), F.lit(0))).first()[0]).cast("long"),
        "processing_time_seconds": F.lit(round(time.perf_counter() - began, 3)),
    }
    tables.write_report(report.withColumns(about), f"{output}/normalization_report")
    tables.write_table(I.corrupt_examples(checked, "place"), f"{output}/corrupt_examples")
    tables.write_table(I.warning_counts(checked), f"{output}/warning_counts")
    return tables.read_report(spark, f"{output}/normalization_report")


def chunk(spark: SparkSession, records: str, output: str, limit: int | None = None, strategies: Sequence[str] = C.STRATEGIES, normalization_report: str | None = None, least_chars: int = 10, drop_duplicates: bool = False, drop_short: bool = False) -> DataFrame:
    """Normalised records to chunks by strategy and language; ``limit`` is in file order. Returns the merged report."""
    rows = spark.read.parquet(records)
    rows = rows if limit is None else tables.first_in_files(rows, limit, "_place").drop("_place")
    tables.write_chunks(C.drop_flagged(C.flagged_views(rows, strategies, least_chars), drop_duplicates, drop_short), output)
    chunks = tables.read_chunks(spark, output)
    before = tables.read_report(spark, normalization_report) if normalization_report else None
    if before is None:
        warnings.warn(f"there is no ingestion report at {normalization_report}: its counters are null", stacklevel=2)
    tables.write_report(R.merged_report(chunks, before), f"{output}_report")
    tables.write_table(R.chunk_counts(chunks), f"{output}_counts")
    return tables.read_report(spark, f"{output}_report")


def validate(spark: SparkSession, chunks: str) -> bool:
    """Whether no partition of chunks has a critical problem; the counts are written beside them."""
    report = R.validation_report(tables.read_chunks(spark, chunks))
    tables.write_report(report, f"{chunks}_validation")
    return R.passed(tables.read_report(spark, f"{chunks}_validation"))


def compare(spark: SparkSession, chunks: str) -> dict[str, DataFrame]:
    """The structural comparison of strategies: corpus, by strategy, lengths."""
    rows = tables.read_chunks(spark, chunks)
    parts = {"corpus": R.comparison_report(rows), "strategies": R.strategy_report(rows), "lengths": R.length_histogram(rows)}
    for name, part in parts.items():
        tables.write_report(part, f"{chunks}_comparison/{name}")
    return {name: spark.read.json(f"{chunks}_comparison/{name}") for name in parts}


def make_benchmark(spark: SparkSession, records: str, output: str, size: int = 1000, seed: int = 42, chunks: str | None = None, require_answer: bool = False) -> DataFrame:
    """Benchmark queries as JSON lines, with ground truth; a manifest by type and one of the run beside them."""
    pool = B.eligible(spark.read.parquet(records), require_answer)
    truth = B.ground_truth(B.stratified_sample(pool, size, seed), tables.read_chunks(spark, chunks) if chunks else None)
    tables.write_json_lines(truth, output)
    written = tables.read_benchmark(spark, output)
    tables.write_report(B.benchmark_manifest(pool, written), f"{output}_manifest")
    about = {"status": "COMPLETE", "input_file": records, "seed": seed, "requested_size": size, "actual_size": written.count(), "eligible_pool_size": pool.count(), "require_answer_only": require_answer, "chunks_dir_used_for_ground_truth": chunks, "output_file": output, "anti_leakage_note": NO_LEAK}
    tables.write_report(_one_row(spark, about), f"{output}_run")
    return written


def make_corpus(spark: SparkSession, benchmark: str, chunks: str, output: str, size: int = 50_000, seed: int = 42, strategies: Sequence[str] | None = None) -> DataFrame:
    """The corpus to search: positives, hard negatives, a seeded fill. Missing ground truth is written beside it."""
    asked = tables.read_benchmark(spark, benchmark)
    tables.write_table(B.corpus_subset(tables.read_chunks(spark, chunks, strategies), asked, size, seed), output)
    corpus = spark.read.parquet(output)
    tables.write_report(B.corpus_manifest(corpus), f"{output}_manifest")
    tables.write_table(B.missing_ground_truth(asked, corpus), f"{output}_missing")
    missing = spark.read.parquet(f"{output}_missing")
    origins = {r["origin"]: r["count"] for r in corpus.groupBy("origin").count().collect()}
    wanted = asked.select(F.explode("ground_truth_parent_passage_ids")).distinct().count()
    # the ids of a benchmark's passages without chunks: at most as many as the benchmark has
    about = {"status": "COMPLETE", "chunks_dir": chunks, "benchmark_queries_file": benchmark, "seed": seed, "target_corpus_size": size, "actual_corpus_size": sum(origins.values())}
    about |= {f"{name}_chunks": origins.get(name, 0) for name in ("positive", "hard_negative", "random_negative")}
    about |= {"positive_parent_passage_ids": wanted, "missing_ground_truth_passage_ids": sorted(r[0] for r in missing.collect()), "missing_ground_truth_count": missing.count(), "output_file": output}
    tables.write_report(_one_row(spark, about), f"{output}_run")
    return corpus


def index(spark: SparkSession, corpus: str, collection: str, progress: str, model: str = "TEST_ONLY:dim256", device: str = "cpu", batch_files: int = 16) -> int:
    """Build a vector collection, going on where an interrupted build stopped. Returns its points."""
    return build_index(spark, corpus, collection, progress, model, device, batch_files)


def retrieve(spark: SparkSession, query: str, collection: str, corpus: str, model: str = "TEST_ONLY:dim256", k: int = 10, language: str | None = None, query_type: str | None = None) -> dict:
    """One query against a stored collection."""
    given: Mapping[str, str | None] = {"language": language, "query_type": query_type}
    store, filtered = VectorCollection(spark, collection), {n: v for n, v in given.items() if v}
    return S.retrieve(spark, query, S.get_embedder(model), store.points(filtered), spark.read.parquet(corpus), k, filtered, store.distance)


def _stage_times(spark: SparkSession, queries: DataFrame, points: DataFrame, terms: TermIndex, embedder, config: tables.RetrievalConfig, most: int | None) -> list[tuple[str, float]]:
    """Milliseconds of each stage of single queries, for the first ``most`` of them by id (None: all), one at a time. The
    term index is there before, so its building isn't timed."""
    times = []

    def timed(stage: str, f):
        began = time.perf_counter()
        found = f()
        times.append((stage, (time.perf_counter() - began) * 1000))
        return found, times[-1][1]

    def ranking(frame: DataFrame) -> DataFrame:
        return spark.createDataFrame(frame.orderBy("rank").collect(), frame.schema)

    chosen = queries.orderBy("query_id")
    for row in (chosen if most is None else chosen.limit(most)).toLocalIterator():
        vector, embedded = timed("embedding_ms", lambda: [float(x) for x in embedder.embed([row["text"]], is_query=True)[0]])  # noqa: B023
        asked = spark.createDataFrame([(row["query_id"], row["text"], vector)], "query_id string, text string, embedding array<float>")
        dense, searched = timed("dense_ms", lambda: ranking(S.dense_topk(asked, points, config.top_k, config.distance)))  # noqa: B023
        if "dense" in config.retrieval_modes:
            times.append(("total_dense_ms", embedded + searched))
        if "hybrid_rrf" in config.retrieval_modes:
            sparse, matched = timed("sparse_ms", lambda: ranking(terms.search(asked, config.top_k)))  # noqa: B023
            _, fused = timed("fusion_ms", lambda: S.rrf([dense, sparse], config.rrf_k).collect())  # noqa: B023
            times.append(("total_hybrid_ms", embedded + searched + matched + fused))
    return times


def run_benchmark(spark: SparkSession, corpus: str, benchmark: str, output: str, config: tables.RetrievalConfig = tables.RetrievalConfig(), models: Sequence[str] | None = None, top_k: int | None = None, device: str = "cpu", warm_up_calls: int = 5, timed_queries: int | None = 3) -> dict[str, DataFrame]:
    """Metrics by mode, overall and by query type, for each model.

    The corpus is embedded once a model, into a table, and split into words once, into a term index beside the results.
    All queries are searched together for the metrics; the latency percentiles by stage are of ``timed_queries``
    queries (None: of every one) that are run one at a time. Beside the metrics lie the latencies and what the run was.
    """
    config = replace(config, top_k=top_k or config.top_k)
    rows = spark.read.parquet(corpus)
    asked = tables.read_benchmark(spark, benchmark)
    relevant = E.relevance(asked)
    queries = asked.join(relevant, "query_id", "left_semi").select("query_id", "query_type", F.coalesce(F.nullif("query", F.lit("")), "Eng_Query").alias("text"))
    found, runs, terms = {}, [], TermIndex(spark, f"{output}/terms")
    terms.add(rows)
    for model in models or config.embedding_models or (config.local_test_only_embedder,):
        embedder = S.get_embedder(model, device)
        warm = S.warm_up(embedder, warm_up_calls)
        name = model.replace("/", "_").replace(":", "_")
        began = time.perf_counter()
        tables.write_table(S.embed(rows.select("chunk_id", "text"), embedder).drop("text"), f"{output}/{name}/points")
        embedded = (time.perf_counter() - began) * 1000
        points = spark.read.parquet(f"{output}/{name}/points")
        dense = S.dense_topk(S.embed(queries, embedder, is_query=True), points, config.top_k, config.distance)
        sparse = terms.search(queries, config.top_k)
        ranked = S.retrieval_modes(dense, sparse, config.retrieval_modes, config.rrf_k)
        tables.write_table(ranked, f"{output}/{name}/ranked")
        times = spark.createDataFrame(_stage_times(spark, queries, points, terms, embedder, config, timed_queries), "stage string, ms double")
        tables.write_report(E.latency_summary(times, "ms", ["stage"]), f"{output}/{name}/latency")
        size, n_asked = points.count(), queries.count()
        about = {"model": model, "status": "COMPLETE", "dimension": embedder.dimension, "is_test_only_proxy": model.startswith("TEST_ONLY:"), "device": device, "warmup_ms_excluded_from_latency": round(warm, 2), "warmup_calls": warm_up_calls, "corpus_size": size, "queries_evaluated": n_asked}
        about |= {"embed_corpus_total_ms": round(embedded, 2), "embed_corpus_ms_per_chunk": round(embedded / max(1, size), 4), "timed_queries": timed_queries, "benchmark_query_count": asked.count(), "top_k": config.top_k, "corpus_file": corpus, "benchmark_queries_file": benchmark, "config_used": json.dumps(asdict(config)), "anti_leakage_note": NO_LEAK}
        runs.append(about)
        scored = E.per_query(spark.read.parquet(f"{output}/{name}/ranked"), relevant, config.eval_k_values, config.mrr_k, ["mode"])
        tables.write_report(E.overall(scored.join(queries.select("query_id", "query_type"), "query_id")), f"{output}/{name}/metrics")
        found[model] = tables.read_report(spark, f"{output}/{name}/metrics")
    tables.write_report(_one_row(spark, *runs), f"{output}/run")
    return found


def inspect(spark: SparkSession, file: str, output: str, sample: int = 5) -> dict[str, DataFrame]:
    """A profile of a table whose columns aren't known; a failure is written as a report and raised."""
    try:
        rows = spark.read.parquet(file)
        names = set(rows.columns)
        parts = {"null_counts": P.null_counts(rows), "files": P.file_sizes(rows)}
        counted = [c for c in ("source_lang", "target_lang", "query_type") if c in names]
        texts = [c for c in ("query", "Eng_Query", "Answer", "Eng_Answer") if c in names]
        if counted:
            parts["value_counts"] = P.value_counts(rows, counted)
        if texts:
            parts["text_lengths"] = P.text_lengths(rows, texts)
        if "query_id" in names:
            parts["repeated_query_ids"] = P.repeated_keys(rows, "query_id")
        if P.nested_types(rows, "passages") if "passages" in names else False:
            parts |= {"passages": P.nested_lengths(rows, "passages"), "selection": P.selection_stats(rows)}
            if {"Eng_Answer", "query_id"} <= names:
                parts["no_answer"] = P.no_answer_stats(rows, "query_id")
        parts["sample"] = P.sample_records(rows, rows.columns[0], sample)
        for name, part in parts.items():
            tables.write_report(part, f"{output}/{name}")
    except Exception as error:
        spark.createDataFrame([(P.failure_report(error, "inspect"),)], "value string").write.mode("overwrite").text(f"{output}/failure")
        raise
    return {name: spark.read.json(f"{output}/{name}") for name in parts}
