"""Samples, blocks and what is sent to the tasks: bounds that lose nothing."""

import os
import random
import subprocess
import sys

import pytest

from corpusloom.llm import common, decontamination, spotsigs, toxicity

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def labelled(spark, extra=()):
    rows = [(i, f"you are a {'vile horrid' if i % 2 else 'kind gentle'} thing number{i % 7} here and there", i % 2) for i in range(300)]
    rows += list(extra)
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_a_long_text_ends_no_teaching(spark):
    """Wherever a text that is longer than the whole sample comes in the draw, all others teach."""
    long = [(1000 + i, "word " * 30_000, i % 2) for i in range(4)]
    docs, labels = labelled(spark, long)
    texts, _, y = toxicity.sample(docs, labels, 6000, 20_000, 1 << 10, "toxic", "doc_id", "text")
    assert len(texts) == len(y) == 300 and y.sum() == 150
    scored = {r.doc_id: r.predicted for r in toxicity.classify(docs, labels, most_words=20_000, buckets=1 << 10).collect()}
    assert all(scored[i] == i % 2 for i in range(300)) and len(scored) == 304


def test_a_class_that_cannot_teach_is_an_error(spark):
    docs, labels = labelled(spark)
    docs = docs.union(spark.createDataFrame([(2000, "word " * 9000)], docs.schema))
    with pytest.raises(ValueError, match="class 1"):
        toxicity.sample(docs, labels.where("toxic = 0").union(spark.createDataFrame([(2000, 1)], labels.schema)), 6000, 6000, 1 << 10, "toxic", "doc_id", "text")


def test_each_class_has_its_share_of_words(spark):
    docs, labels = labelled(spark)
    _, _, y = toxicity.sample(docs, labels, 6000, 990, 1 << 10, "toxic", "doc_id", "text")
    assert 0.25 < y.mean() < 0.4 and len(y) <= 99


def test_near_copies_give_links_in_proportion(spark, monkeypatch):
    """Different sets of one class: pairs that are compared grow with the copies, not with their square."""
    compared = {}
    alike = spotsigs._alike

    def counting(pairs, sets, least):
        compared[n] = compared.get(n, 0) + pairs.distinct().count()
        return alike(pairs, sets, least)

    monkeypatch.setattr(spotsigs, "_alike", counting)
    base = [f"the word{i} term{i}" for i in range(40)]
    for n in (40, 160):
        rows = [(i, " ".join(x if j != i % 40 else f"the odd{i} one{i}" for j, x in enumerate(base))) for i in range(n)] + [(1000 + i, f"the word0 term0 of any{i} kind{i} is all{i} here{i}") for i in range(5)]
        found = {r.doc_id: r.component for r in spotsigs.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all(found[i] == 0 for i in range(n)) and all(found[1000 + i] == 1000 + i for i in range(5))
    assert compared[160] < 6 * compared[40] and compared[160] < 160 * 159 / 2


@pytest.mark.parametrize("most_words", [150, 10_000])
def test_a_long_item_is_cut_into_pieces(spark, most_words):
    """Each automaton keeps its bound, and every window is found."""
    item = " ".join(f"w{i % 37}x{i}" for i in range(400))
    items = spark.createDataFrame([(1, item), (2, "short one here"), (3, "w0x0 " * 25)], "item_id long, text string")
    words = item.split()
    docs = spark.createDataFrame([(i, " ".join(["zz", *words[i : i + 10], "yy"])) for i in range(0, 391, 13)] + [(1000, "a short one here b"), (1001, " ".join(words[5:14])), (1002, item)], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontamination.contamination(docs, items, most_words=most_words).collect()}
    want = {i: (10, ["1"]) for i in range(0, 391, 13)} | {1000: (3, ["2"]), 1001: (0, []), 1002: (400, ["1"])}
    assert got == want


def test_automata_keep_their_bound(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i % 37}x{i}" for i in range(400))), (2, "short one here"), (3, "w0x0 " * 25)], "item_id long, text string")
    for most_words in (3, 10, 17, 60, 10_000):
        found = list(decontamination.automata(items, 10, most_words, "item_id", "text"))
        assert max(len(a.step) for a in found) <= 2 * max(most_words, 10) + 2
        assert set().union(*(x for a in found for x in a.items.values())) == {"1", "3"}


def test_workers_need_no_copy_of_the_library(tmp_path):
    """The library is on the driver's path alone; executors import nothing of it."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "checkpoints").getOrCreate()
from corpusloom.llm import decontamination, private_data, source_audit, toxicity
from corpusloom.operators.retrieval import bm25_topk
from corpusloom.sources.vector_cells import VectorCells
docs = spark.createDataFrame([(i, "you are a thing number and one two three four five six", "en", "s") for i in range(40)], "doc_id long, text string, lang string, source string")
labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
assert toxicity.classify(docs, labels, buckets=64).count() == 40
for most in (10, 1000):
    assert decontamination.contamination(docs, docs.selectExpr("doc_id as item_id", "text"), most_words=most).where("n_hit > 0").count() == 40
assert source_audit.audit(docs, 1).count() >= 0 and private_data.find_private(docs).count() == 40
assert bm25_topk(docs.selectExpr("doc_id as query_id", "text").limit(2), docs.selectExpr("doc_id as chunk_id", "text"), 3).count() == 6
store = VectorCells(spark, "cells")
store.build(docs.selectExpr("doc_id as chunk_id", "array(cast(doc_id as double), 1D) as embedding"))
assert store.search(docs.selectExpr("doc_id as query_id", "array(cast(doc_id as double), 1D) as embedding"), 2).count() == 80
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "done" in done.stdout, done.stderr[-2000:]


def smallest(links):
    """The smallest node that each node reaches."""
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_few_links_take_few_tasks(spark):
    """Each task leaves files of every shuffle and a log entry: a small graph's rounds don't take all partitions' tasks for each."""
    links = [(i, i + 1) for i in range(60)]
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    frame, context = spark.createDataFrame(links, "a long, b long").repartition(64), spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("few links", "components")
        assert {r.node: r.root for r in common.connected_components(frame).collect()} == smallest(links)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few links") for s in tracker.getJobInfo(j).stageIds}
    assert sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s))) < 2000


@pytest.mark.parametrize("size", [4, 1 << 16])
def test_components_are_the_same_however_links_are_dealt(spark, monkeypatch, size):
    """More links than a task takes are shuffled, fewer are sent; roots are equal."""
    monkeypatch.setattr(common, "LINKS", size)
    rng = random.Random(9)
    links = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(70)] + [(500, x) for x in range(501, 540)] + [(7, 7), (900, 900), (7, 7)]
    dirty = links + [(None, 1), (2, None)]
    got = [(r.node, r.root) for r in common.connected_components(spark.createDataFrame(dirty, "a long, b long")).collect()]
    assert sorted(got) == sorted(smallest(links).items())
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
