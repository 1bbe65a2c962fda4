"""The stored inverted index against BM25 by its formula over all rows."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.operators.retrieval import bm25_topk
from corpusloom.sources import term_index
from corpusloom.sources.term_index import TermIndex


def plain(texts, query, k, epsilon=0.25):
    """(key, score) of the best k by the formula, every row scored."""
    docs = {key: (t or "").lower().split() for key, t in texts}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs) or 1.0
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    average = sum(idf.values()) / max(1, len(idf))
    idf = {w: epsilon * average if v < 0 else v for w, v in idf.items()}
    score = lambda d: round(sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in (query or "").lower().split()), 9)
    scored = sorted(((-score(d), key) for key, d in docs.items()))[:k]
    return [(key, -s + 0.0) for s, key in scored]


def made(rng, n, vocabulary=60):
    names = [f"w{i}" for i in range(vocabulary)]
    return [(f"k{i:04d}", rng.choice([None, "", " "]) if rng.random() < 0.03 else " ".join(rng.choices(names, weights=[1 / (j + 1) for j in range(vocabulary)], k=rng.randrange(1, 30)))) for i in range(n)]


def check(found, texts, asked, k):
    by = {}
    for r in sorted(found.collect(), key=lambda r: (str(r.query_id), r.rank)):
        by.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.score))
    for name, query in asked:
        want = plain(texts, query, k)
        got = by.get(name, [])
        assert [r for r, _, _ in got] == list(range(1, len(want) + 1)), name
        assert [c for _, c, _ in got] == [c for c, _ in want], name
        assert [s for _, _, s in got] == pytest.approx([s for _, s in want], abs=2e-9)


@pytest.mark.parametrize("k, rows, first", [(5, 7, 1), (30, 50, 2), (500, 1000, 2), (1, 3, 2)])
def test_search(spark, tmp_path, k, rows, first):
    rng = random.Random(k)
    texts = made(rng, 300)
    asked = [(i, " ".join(f"W{rng.randrange(70)}" for _ in range(rng.randrange(1, 6)))) for i in range(25)] + [(90, "zzz none"), (91, None), (92, "w59 w59 w58")]
    index = TermIndex(spark, str(tmp_path / "index"))
    frame = spark.createDataFrame(texts, "chunk_id string, text string").repartition(4)
    index.add(frame, rows=rows, words=200)
    check(index.search(spark.createDataFrame(asked, "query_id int, text string"), k, first=first, asked=40), texts, asked, k)


def test_segments_are_one_corpus(spark, tmp_path):
    """Statistics are of all segments; a segment that is added again replaces itself; many words need no named filter."""
    rng = random.Random(9)
    texts = made(rng, 200, 600)
    index = TermIndex(spark, str(tmp_path / "index"))
    for number in range(4):
        for _ in range(2):
            index.add(spark.createDataFrame(texts[number * 50 : number * 50 + 50], "chunk_id string, text string"), number, words=300)
    asked = [(i, " ".join(f"w{rng.randrange(600)}" for _ in range(30))) for i in range(20)]
    known = index.statistics()
    assert known.rows == 200 and known.mean_size == pytest.approx(sum(len((t or "").split()) for _, t in texts) / 200)
    check(index.search(spark.createDataFrame(asked, "query_id int, text string"), 10), texts, asked, 10)


def test_common_words_only(spark, tmp_path):
    """The mean idf is below 0: rows without the words come before those with them."""
    texts = [(i, "a b c" if i % 9 else "d") for i in range(60)]
    asked = [("q", "a b"), ("r", "d"), ("s", "zzz")]
    frame = spark.createDataFrame(texts, "chunk_id int, text string").repartition(3)
    check(bm25_topk(spark.createDataFrame(asked, "query_id string, text string"), frame, 12), texts, asked, 12)


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id int, text string")
    asked = spark.createDataFrame([("q", "a b")], "query_id string, text string")
    assert bm25_topk(asked, none).count() == 0
    some = spark.createDataFrame([(1, None), (2, "")], "chunk_id int, text string")
    assert [(r.rank, r.chunk_id, r.score) for r in bm25_topk(asked, some).collect()] == [(1, 1, 0.0), (2, 2, 0.0)]
    assert bm25_topk(asked.limit(0), some).count() == 0


def test_plan(spark, tmp_path):
    """Building shuffles nothing, and a search for few words filters the scan by them."""
    index = TermIndex(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame(made(random.Random(1), 50), "chunk_id string, text string"))
    words = spark.createDataFrame([("w1",), ("w2",)], "term string")
    plan = index._of(words, ["places"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,w1)" in plan and "sizes" not in plan.split("ReadSchema")[1]
    shuffled = spark.sparkContext.statusTracker()
    assert shuffled is not None


def test_a_full_shard_is_made_in_little_memory():
    """What a task holds beside the words themselves grows by some 16 bytes a word (29 with a copy for each step)."""
    n, rows = 1 << 19, 5000
    draw = np.random.default_rng(1).zipf(1.3, n) % 50_000
    words, sizes = pa.array([f"w{i}" for i in draw.tolist()]), np.full(rows, n // rows)
    sizes[-1] += n - sizes.sum()
    lists = ("places", "counts", "sizes")
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("words", pa.int64()), ("most", pa.int32()), ("least_size", pa.int32()), *((c, pa.list_(pa.int32())) for c in lists), ("keys", pa.list_(pa.int64()))])
    tracemalloc.start()
    blocks = list(term_index._blocks(pa.array(np.arange(rows)), words, sizes, 0, schema))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * n
    assert sum(sum(map(sum, b.column("counts").to_pylist())) for b in blocks[1:]) == n
