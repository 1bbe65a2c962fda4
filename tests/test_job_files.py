"""The runnable jobs: reruns, growing input, odd rows, the command line; their queries against SQL."""

import glob
import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import bm25_topk
from jobs import chunk_corpus, common, queries, term_index

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x.item() if hasattr(x, "item") else x) for x in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, tiny, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{tiny}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.queries()[name](spark, tiny).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def files(path):
    """Names and times of data files."""
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/**/*.parquet", recursive=True)}


@pytest.mark.parametrize("per_batch", [None, 1])
def test_index_takes_only_what_is_new(spark, tiny, tmp_path, per_batch):
    whole = spark.read.parquet(f"{tiny}/documents.parquet").withColumn("text", F.when(F.col("doc_id") != 17, F.col("text")))
    source, output, config = f"{tmp_path}/documents", f"{tmp_path}/out", f"{tmp_path}/config.json"
    with open(config, "w") as out:
        json.dump({"files_per_batch": per_batch, "top_k": 7}, out)
    run = lambda: term_index.run(spark, source, f"{tiny}/benchmark.parquet", output, config)
    whole.where("doc_id % 3 = 0").repartition(3).write.parquet(source)
    first = run()
    assert first["new_documents"] == first["documents"] == whole.where("doc_id % 3 = 0").count()
    old = files(f"{output}/index")
    assert run() == first | {"new_documents": 0} and files(f"{output}/index") == old
    before = {tuple(r) for r in spark.read.parquet(f"{output}/hits").collect()}
    whole.where("doc_id % 3 > 0").repartition(2).write.mode("append").parquet(source)
    second = run()
    assert second["documents"] == whole.count() and second["new_documents"] == whole.count() - first["documents"]
    now = files(f"{output}/index")
    assert old.items() <= now.items() and len(now) > len(old)
    found = {(r.query_id, r["rank"], r.doc_id) for r in spark.read.parquet(f"{output}/hits").collect()}
    want = bm25_topk(spark.read.parquet(f"{tiny}/benchmark.parquet"), whole, 7, query_key="item_id", corpus_key="doc_id")
    assert found == {(r.query_id, r["rank"], r.chunk_id) for r in want.collect()} and len(before) == first["hits"]
    assert {p.rpartition("=")[2] for p in glob.glob(f"{output}/hits/lang=*")} == {r.lang for r in whole.select("lang").distinct().collect()} & {p.rpartition("=")[2] for p in glob.glob(f"{output}/hits/lang=*")}


def test_index_after_a_failed_batch(spark, tiny, tmp_path, monkeypatch):
    """A run that fails after it wrote a segment is taken up again, and nothing counts twice."""
    source, output = f"{tmp_path}/documents", f"{tmp_path}/out"
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    docs.repartition(2).write.parquet(source)
    add = term_index.TermIndex.add

    def broken(self, *args, **options):
        add(self, *args, **options)
        raise RuntimeError("lost")

    monkeypatch.setattr(term_index.TermIndex, "add", broken)
    with pytest.raises(Exception, match="lost"):
        term_index.run(spark, source, f"{tiny}/benchmark.parquet", output)
    monkeypatch.undo()
    assert term_index.run(spark, source, f"{tiny}/benchmark.parquet", output)["documents"] == docs.count()


def test_corpus_of_odd_documents(spark, tmp_path):
    docs = [(1, "en", "One. Two."), (2, "en", "One. Two."), (3, "de", "One. Two."), (4, None, "Drei."), (5, "en", None), (6, "de", ""), (None, "en", "lost"), (8, "en", "x"), (9, "en", "One. Two.")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(9, 1), (9, 0), (3, None), (77, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/l")
    outputs = []
    for _ in range(2):
        counts = chunk_corpus.run(spark, f"{tmp_path}/d", f"{tmp_path}/l", f"{tmp_path}/out")
        outputs.append(sorted(map(str, spark.read.parquet(f"{tmp_path}/out/chunks").collect())))
    assert outputs[0] == outputs[1] and counts["rejected"] == 1 and counts["documents"] == 9
    written = spark.read.parquet(f"{tmp_path}/out/chunks").collect()
    assert {r.query_id for r in written} == {"1", "3", "4", "8", "9"}
    assert {r.query_id for r in written if r.is_selected == 1} == {"9"}
    assert {(r.chunk_strategy, r.total_chunks) for r in spark.read.json(f"{tmp_path}/out/report").collect()} == {(s, 5) for s in ("passage", "paragraph", "sentence", "adaptive")}
    with open(f"{tmp_path}/c.json", "w") as out:
        json.dump({"strategies": ["sentence"], "drop_duplicates": True, "drop_short": True, "least_chars": 6}, out)
    chunk_corpus.run(spark, f"{tmp_path}/d", f"{tmp_path}/l", f"{tmp_path}/out", f"{tmp_path}/c.json")
    left = spark.read.parquet(f"{tmp_path}/out/chunks").collect()
    assert {(r.query_id, r.chunk_strategy) for r in left} == {("1", "sentence"), ("3", "sentence"), ("9", "sentence")}


def test_empty_tables(spark, tmp_path):
    for name, schema in (("d", "doc_id long, lang string, source string, text string"), ("l", "doc_id long, quality int"), ("q", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    assert chunk_corpus.run(spark, f"{tmp_path}/d", f"{tmp_path}/l", f"{tmp_path}/out")["chunks"] == 0
    assert term_index.run(spark, f"{tmp_path}/d", f"{tmp_path}/q", f"{tmp_path}/out2") == {"new_documents": 0, "documents": 0, "queries": 0, "hits": 0}


def test_settings_and_configuration(spark, tmp_path):
    name = common.CHANGED[0]
    before = spark.conf.get(name, None)
    with pytest.raises(RuntimeError), common.settings_kept(spark):
        spark.conf.set(name, "false" if before != "false" else "true")
        raise RuntimeError
    assert spark.conf.get(name, None) == before
    with open(f"{tmp_path}/c.json", "w") as out:
        json.dump({"odd": 1}, out)
    with pytest.raises(ValueError, match="odd"):
        common.read_config(spark, f"{tmp_path}/c.json", {"top_k": 1})
    for job, module in (("chunk_corpus", chunk_corpus), ("term_index", term_index)):
        assert common.read_config(spark, f"{ROOT}/jobs/{job}.json", module.DEFAULTS) == module.DEFAULTS


def test_command_line(tiny, tmp_path):
    paths = ["--documents", f"{tiny}/documents.parquet", "--queries", f"{tiny}/benchmark.parquet", "--output", f"{tmp_path}/out", "--config", f"{ROOT}/jobs/term_index.json"]
    done = subprocess.run([sys.executable, "-m", "jobs.term_index", *paths], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True)
    assert "read 200 new documents" in done.stderr and glob.glob(f"{tmp_path}/out/hits/lang=*/*.parquet")


def test_no_training_data_code():
    for path in glob.glob(f"{ROOT}/jobs/*.py"):
        with open(path) as text:
            assert "llm" not in text.read()
