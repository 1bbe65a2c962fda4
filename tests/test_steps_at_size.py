"""What steps do on long texts and large tables, seen in their plans, files and time."""

import glob
import time

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import benchmark, chunking, ingest, reports
from corpusloom.plans import catalog
from jobs import chunk_corpus


def chunks(spark):
    row = (7, (["One here. Two there! " * 40], [""], [1]))
    schema = "query_id long, passages struct<English_passages:array<string>,Translated_passages:array<string>,is_selected:array<int>>"
    frame = spark.createDataFrame([row], schema).withColumns({c: F.lit("") for c in ingest.REQUIRED_FIELDS if c not in ("query_id", "passages")})
    return chunking.flagged_views(ingest.normalize(ingest.validate(frame)))


def test_a_mark_at_the_end_of_a_long_text(spark):
    """NFC takes time in proportion to the text, and little of it."""
    for times in (1, 1_000_000):  # the first starts a worker
        began = time.time()
        rows = spark.range(1).select(F.concat(F.repeat(F.lit("some plain words "), times), F.lit("e\u0301")).alias("t"))
        assert rows.select(F.right(X.nfc("t"), F.lit(1)).alias("t")).first()["t"] == "\u00e9"
    assert time.time() - began < 6


def test_a_filter_on_metadata_reads_no_text(spark):
    found = chunks(spark).select("chunk_id", "metadata").where(F.get_json_object("metadata", "$.contributing_strategies").isNotNull())
    filters = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line and "contributing_strategies" in line]
    assert filters and not any("RLIKE" in line or "split(" in line for line in filters)
    assert found.count() > 0


def test_validation_groups_ids_by_counts_alone(spark):
    """Lists by id make Spark sort what it groups."""
    report = reports.validation_report(chunks(spark).withColumn("query_type", F.lit("ODD")))
    plan = report._jdf.queryExecution().executedPlan().toString()
    lists = [line for line in plan.splitlines() if "ObjectHashAggregate(" in line]
    assert lists and not any("id#" in line.split("functions=")[0] for line in lists)
    found = report.first()
    assert found["unknown_values"] == "ODD" and found["unknown_query_type"] == found["rows"] and found["duplicate_chunk_id"] == 0


def test_the_job_sorts_nothing_to_write(spark, tmp_path):
    """A task writes all folders at once, and files hold a repeated text once."""
    spark.createDataFrame([(i, "de", f"Wort {i}. " * 9000) for i in range(3)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels")
    before = spark.conf.get(chunk_corpus.WRITERS)
    counts = chunk_corpus.run(spark, f"{tmp_path}/docs", f"{tmp_path}/labels", f"{tmp_path}/out")
    assert spark.conf.get(chunk_corpus.WRITERS) == before and counts["chunks"] > 100
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/out/chunks/*/*/*.parquet")]
    columns = [m.row_group(g).column(c) for m in files for g in range(m.num_row_groups) for c in range(m.num_columns)]
    assert {c.compression for c in columns} == {"ZSTD"}
    assert sum(c.total_uncompressed_size for c in columns if c.path_in_schema == "text_target") < 3 * 4 * 300_000


def test_the_job_has_room_for_all_folders(spark, tmp_path, monkeypatch):
    """Spark sorts a task's rows once as many files are open as the setting says, so it has to say more than there are folders."""
    spark.createDataFrame([(i, lang, "One two. Three.") for i, lang in enumerate(("de", "en"))], "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels")
    report, most = reports.strategy_report, []
    monkeypatch.setattr(reports, "strategy_report", lambda rows: (most.append(int(spark.conf.get(chunk_corpus.WRITERS))), report(rows))[1])
    chunk_corpus.run(spark, f"{tmp_path}/docs", f"{tmp_path}/labels", f"{tmp_path}/out")
    assert most[0] > len(glob.glob(f"{tmp_path}/out/chunks/*/*")) == 8


def test_a_document_moves_once(spark, tmp_path):
    """Copies are found by digests; a text then goes to its own id, where its label and the first of equal ones are."""
    texts = ["One.", "One.", "", None, "Deux. Été.", "One."]
    docs = spark.createDataFrame([(i, "de" if i == 5 else "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    for name, frame in (("docs", docs), ("labels", labels)):
        frame.write.parquet(f"{tmp_path}/{name}")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found, _ = chunk_corpus.records(*[spark.read.parquet(f"{tmp_path}/{name}") for name in ("docs", "labels")], chunk_corpus.DEFAULTS)
        nodes, moved = [found._jdf.queryExecution().executedPlan()], []
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange":
                moved.append({node.output().apply(i).name() for i in range(node.output().size())})
        assert len(moved) > 2 and sum(bool(names & {"text", "passages"}) for names in moved) == 1
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sorted((r.query_id, r.passages[0].text_english + r.passages[0].text_target, r.passages[0].is_selected) for r in found.collect()) == [("0", "One.", 0), ("1", "One.", 1), ("2", "", 0), ("4", "Deux. Été.", 0), ("5", "One.", 0)]


def written(monkeypatch, name):
    """Runs of ``catalog`` note the plans of what they write."""
    plans, write = [], getattr(catalog, name)

    def noted(frame, *rest):
        plans.append((set(frame.columns), frame._jdf.queryExecution().optimizedPlan().toString()))
        return write(frame, *rest)

    monkeypatch.setattr(catalog, name, noted)
    return plans


def test_stored_chunks_have_what_is_read_of_them(spark, tiny, monkeypatch):
    """All four strategies are written, but no text is hashed or grouped where neither flags nor hashes are read."""
    plans = written(monkeypatch, "write_chunks")
    rows = catalog.QUERIES["chunk_some_strategies"](spark, tiny)
    assert "PartitionFilters: [strategy" in rows._jdf.queryExecution().executedPlan().toString()
    assert plans[0][0] == {"chunk_strategy", "language", "char_count"} and "sha2(" not in plans[0][1]


def test_a_benchmark_is_drawn_without_texts(spark, tiny, monkeypatch):
    """Neither records' nor chunks' hashes are made, and the sample reads no text."""
    chunks, frames = written(monkeypatch, "write_chunks"), written(monkeypatch, "stored")
    assert catalog.QUERIES["bench_relevance"](spark, tiny).count() > 0
    assert not any("sha2(" in plan for _, plan in [*chunks, *frames])
    assert [columns for columns, _ in frames if "passages" in columns] == [columns for columns, _ in frames[:2]]
    narrow = spark.createDataFrame([([(0, "a", "b", 1)],)], "passages array<struct<passage_index:int,text_english:string,text_target:string,is_selected:int>>")
    assert narrow.select(benchmark.marks().alias("p")).schema["p"].dataType.elementType.names == ["passage_index", "is_selected"]


def test_marks_are_those_of_flagged_chunks(spark, tiny):
    """Without texts the same columns come out, and neither words nor texts are in what becomes rows."""
    records = catalog._records(spark, tiny)
    marks, whole = chunking.flagged_marks(records), chunking.flagged_views(records).select(*chunking.MARKS)
    assert marks.schema.names == whole.schema.names and marks.dtypes == whole.dtypes
    assert marks.count() > 1000 and marks.exceptAll(whole).isEmpty() and whole.exceptAll(marks).isEmpty()
    made = [line for line in marks._jdf.queryExecution().optimizedPlan().toString().splitlines() if "explode(" in line]
    assert made and not any("text_" in line or "_sentences" in line for line in made)


def test_marks_of_one_strategy(spark, tiny):
    records = catalog._records(spark, tiny)
    marks = chunking.flagged_marks(records, ["passage"])
    assert marks.exceptAll(chunking.flagged_views(records, ["passage"]).select(*chunking.MARKS)).isEmpty() and marks.count() > 0
