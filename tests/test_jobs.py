"""The jobs from raw files to metrics, end to end."""

import json

import pytest

from corpusloom.plans import jobs
from corpusloom.plans.fixtures import raw_records
from corpusloom.sources import tables


def test_all_jobs(spark, tiny, tmp_path):
    base = str(tmp_path)
    raw_records(spark, tiny, broken=True).drop("record").write.parquet(f"{base}/raw")
    profile = jobs.inspect(spark, f"{base}/raw", f"{base}/profile")
    assert {"null_counts", "value_counts", "text_lengths", "passages", "selection", "no_answer", "sample", "files", "repeated_query_ids"} <= set(profile)
    report = jobs.ingest(spark, f"{base}/raw", f"{base}/out").first()
    assert report.input_rows_total_in_file == 20 and report.validation_warnings_total > 0 and report.processing_time_seconds > 0
    assert report.input_rows_examined == 20 and report.malformed_records + report.normalized_records == 20
    assert jobs.ingest(spark, f"{base}/raw", f"{base}/few", limit=7).first().input_rows_examined == 7
    merged = jobs.chunk(spark, f"{base}/out/normalized", f"{base}/chunks", normalization_report=f"{base}/out/normalization_report").first()
    assert merged.input_rows_examined == 20 and merged.output_chunks > 0
    with pytest.warns(UserWarning, match="no ingestion report"):
        few = jobs.chunk(spark, f"{base}/out/normalized", f"{base}/first", limit=2).first()
    first = {r.query_id for r in tables.first_rows(tables.with_place(spark.read.parquet(f"{base}/out/normalized"), "p"), 2, "p").collect()}
    assert few.malformed_records is None and {r.query_id for r in spark.read.parquet(f"{base}/first").select("query_id").distinct().collect()} == first
    dropped = jobs.chunk(spark, f"{base}/out/normalized", f"{base}/fewer", drop_duplicates=True, drop_short=True, strategies=["passage", "sentence"]).first()
    assert 0 < dropped.output_chunks < merged.output_chunks
    assert not jobs.validate(spark, f"{base}/chunks")  # one record's marks run from 0 to 9: a warning before, critical here
    odd = spark.read.json(f"{base}/chunks_validation").where("not passed").collect()
    assert all(r.invalid_is_selected > 0 and r.empty_text == r.orphan_parent == r.duplicate_chunk_id == 0 for r in odd)
    assert jobs.compare(spark, f"{base}/chunks")["corpus"].first().total_chunks == merged.output_chunks
    asked = jobs.make_benchmark(spark, f"{base}/out/normalized", f"{base}/bench", size=6, chunks=f"{base}/chunks")
    assert 0 < asked.count() <= 6
    run = spark.read.json(f"{base}/bench_run").first()
    assert (run.seed, run.requested_size, run.actual_size, run.require_answer_only) == (42, 6, asked.count(), False) and run.eligible_pool_size >= run.actual_size
    corpus = jobs.make_corpus(spark, f"{base}/bench", f"{base}/chunks", f"{base}/corpus", size=500)
    assert corpus.count() >= 500 and spark.read.parquet(f"{base}/corpus_missing").count() == 0
    metrics = jobs.run_benchmark(spark, f"{base}/corpus", f"{base}/bench", f"{base}/run", models=["TEST_ONLY:dim64"])["TEST_ONLY:dim64"].collect()
    whole = {r["mode"]: r for r in metrics if r.asDict().get("query_type") is None}
    assert set(whole) == {"dense", "hybrid_rrf"} and all(r.num_queries == asked.count() and 0 <= r.ndcg_10 <= 1 for r in whole.values())
    run = spark.read.json(f"{base}/corpus_run").first()
    assert run.target_corpus_size == 500 and run.actual_corpus_size == corpus.count() == run.positive_chunks + run.hard_negative_chunks + run.random_negative_chunks
    assert run.missing_ground_truth_count == 0 and run.missing_ground_truth_passage_ids == []
    latency = {r.stage: r for r in spark.read.json(f"{base}/run/TEST_ONLY_dim64/latency").collect()}
    assert set(latency) == {"embedding_ms", "dense_ms", "sparse_ms", "fusion_ms", "total_dense_ms", "total_hybrid_ms"}
    assert all(r.n == 3 and 0 <= r.p50_ms <= r.p99_ms <= r.p100_ms for r in latency.values())
    run = spark.read.json(f"{base}/run/run").first()
    assert run.corpus_size == corpus.count() and run.queries_evaluated == asked.count() and run.dimension == 64 and run.is_test_only_proxy and json.loads(run.config_used)["rrf_k"] == 60
    points = jobs.index(spark, f"{base}/corpus", f"{base}/points", f"{base}/progress", "TEST_ONLY:dim64")
    assert points == corpus.count()
    hit = jobs.retrieve(spark, "the", f"{base}/points", f"{base}/corpus", "TEST_ONLY:dim64", 3, language="english")
    assert hit["guardrail_preparation"] == {"top_k_requested": 3, "results_returned": 3, "filters_applied": {"language": "english"}}
    with pytest.raises(Exception):  # noqa: B017
        jobs.inspect(spark, f"{base}/nothing", f"{base}/failed")
    assert "FAILED" in spark.read.text(f"{base}/failed/failure").first().value


def test_ingestion_reads_its_input_once(spark, tiny, tmp_path):
    """Beside the count of rows, which reads no column, one scan of the raw table."""
    raw_records(spark, tiny, broken=True).drop("record").repartition(3).write.parquet(f"{tmp_path}/raw")
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: [kept.apply(i) for kept in [store.executionsList()] for i in range(kept.size())]
    before = max(x.executionId() for x in listed())
    jobs.ingest(spark, f"{tmp_path}/raw", f"{tmp_path}/out")
    plans = [x.physicalPlanDescription() for x in listed() if x.executionId() > before]
    reads = [p for p in plans if f"InMemoryFileIndex [file:{tmp_path}/raw]" in p and "ReadSchema: struct<>" not in p]
    assert len(reads) == 1 and "passages" in reads[0]
    assert spark.read.parquet(f"{tmp_path}/out/warning_counts").count() > 0 and spark.read.parquet(f"{tmp_path}/out/corrupt_examples").count() > 0


def test_ingestion_of_a_table_without_a_field(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, query string").write.parquet(f"{tmp_path}/raw")
    report = jobs.ingest(spark, f"{tmp_path}/raw", f"{tmp_path}/out").first()
    assert (report.input_rows_examined, report.malformed_records, report.normalized_records, report.exact_duplicates_dropped) == (2, 2, 0, 0)


def test_first_in_files(spark, tmp_path):
    spark.range(100).repartitionByRange(7, "id").write.parquet(f"{tmp_path}/t")
    frame = spark.read.parquet(f"{tmp_path}/t")
    for n in (0, 1, 37, 100, 500):
        got = tables.first_in_files(frame, n)
        want = tables.first_rows(tables.with_place(frame), n, "place")
        assert {(r.id, r.place) for r in got.collect()} == {(r.id, r.place) for r in want.collect()} and got.columns == ["id", "place"]
    assert "TakeOrderedAndProject" not in got._jdf.queryExecution().executedPlan().toString()
