"""Dense search with odd vectors, exact search by cells, collections with several versions."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.sources.vector_cells import VectorCells, fit_centres, upper_bounds
from corpusloom.sources.vector_store import STEP, VectorCollection, as_points
from corpusloom.streaming.index_build import build_index

ODD = [[None, 1.0, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0], [], None]


def plain(queries, corpus, k, distance, places=None):
    """(query, rank, key) by scoring every pair."""
    found = []
    for q, v in queries:
        if v is None or len(v) != 4 or not all(x is not None and np.isfinite(x) for x in v):
            continue
        scored = []
        for key, w in corpus:
            if key is not None and w is not None and len(w) == 4 and all(x is not None and np.isfinite(x) for x in w):
                a, b = np.array(v), np.array(w)
                norms = (np.linalg.norm(a) or 1.0) * (np.linalg.norm(b) or 1.0)
                score = {"cosine": a @ b / norms, "dot": a @ b, "euclid": -np.linalg.norm(a - b)}[distance]
                scored.append((-round(score, 9 if places is None else places), key))
        found += [(q, rank, key) for rank, (_, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found)


def vectors(rng, n):
    """Clusters, many copies of one vector, zeros, and odd ones."""
    rows = []
    for i in range(n):
        kind = rng.random()
        centre = [rng.choice([-3.0, 0.0, 4.0]) for _ in range(4)]
        rows.append((i, [1.0, 0.0, 2.0, -1.0] if kind < 0.33 else [0.0] * 4 if kind < 0.35 else rng.choice(ODD) if kind < 0.45 else [round(c + rng.gauss(0, 0.3), 2) for c in centre]))
    return [*rows, (None, [1.0, 0.0, 2.0, -1.0])]


@pytest.mark.parametrize("distance", retrieval.DISTANCES)
def test_odd_vectors_lose_nothing(spark, distance):
    rng = random.Random(4)
    rows = vectors(rng, 200)
    asked = [(1, [1.0, 0.5, 2.0, -1.0]), (2, [0.0] * 4), (3, [float("nan")] * 4), (4, None), (5, [-3.0, 4.0, 0.0, 0.2])]
    corpus = spark.createDataFrame(rows, "chunk_id int, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame(asked, "query_id int, embedding array<double>")
    for block in (4, 1 << 20):
        got = retrieval.dense_topk(queries, corpus, 7, distance, block=block, places=9)
        assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got.collect()) == plain(asked, rows, 7, distance)
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "query_id int, embedding array<double>")
    with pytest.raises(ValueError, match="vectors of"):
        retrieval.dense_topk(mixed, corpus)


@pytest.mark.parametrize("distance", retrieval.DISTANCES)
@pytest.mark.parametrize("cells, k, places", [(12, 3, 9), (40, 400, 2)])
def test_cells(spark, tmp_path, distance, cells, k, places):
    rng = random.Random(cells)
    rows = vectors(rng, 300)
    asked = [(i, [rng.gauss(0, 3) for _ in range(4)]) for i in range(12)] + [(90, [0.0] * 4), (91, [1.0, 0.0, 2.0, -1.0]), (92, None), (93, [float("nan")] * 4)]
    store = VectorCells(spark, str(tmp_path / "cells"))
    store.build(spark.createDataFrame(rows, "chunk_id int, embedding array<double>").repartition(3), distance, cells, 4)
    queries = spark.createDataFrame(asked, "query_id int, embedding array<double>")
    for block in (8, 1 << 20):
        got = store.search(queries, k, places=places, block=block).collect()
        assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got) == plain(asked, rows, k, distance, places)
    with pytest.raises(ValueError, match="dimensions"):
        store.search(spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, embedding array<double>"))


@pytest.mark.parametrize("distance", retrieval.DISTANCES)
def test_a_first_round_changes_no_hit(spark, monkeypatch, distance):
    """With a round over part of the rows tasks give fewer hits, and the best are the same, ties by key."""
    monkeypatch.setattr(retrieval, "TASKS", 3)
    monkeypatch.setattr(retrieval, "SHARE", 4)
    rng = random.Random(8)
    rows = vectors(rng, 400)
    asked = [(i, [rng.gauss(0, 3) for _ in range(4)]) for i in range(9)] + [(9, [1.0, 0.0, 2.0, -1.0])]
    corpus = spark.createDataFrame(rows, "chunk_id int, embedding array<double>").repartition(8)
    for k in (1, 5, 300):
        got = retrieval.dense_topk(spark.createDataFrame(asked, "query_id int, embedding array<double>"), corpus, k, distance, places=6)
        assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got.collect()) == plain(asked, rows, k, distance, 6)


def test_cells_skip_what_cannot_win(spark, tmp_path):
    """Clustered vectors: few cells are read, and fewer blocks scored; the hits are those of the whole search."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 10
    rows = [(f"k{i}", (centres[i % 40] + rng.normal(size=16)).tolist()) for i in range(4000)]
    corpus = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(i, (centres[i] + rng.normal(size=16)).tolist()) for i in range(3)], "query_id int, embedding array<double>")
    for distance in retrieval.DISTANCES:
        store = VectorCells(spark, str(tmp_path / distance))
        store.build(corpus, distance, 60)
        hits = lambda f: sorted((r.query_id, r["rank"], r.chunk_id) for r in f.collect())
        assert hits(store.search(asked, 10, places=6)) == hits(retrieval.dense_topk(asked, corpus, 10, distance, places=6))
        assert 0 < store.read.cells < store.read.of_cells / 2 and 0 < store.read.pairs < store.read.of_pairs / 4


def test_cells_empty(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id int, embedding array<double>")
    store = VectorCells(spark, str(tmp_path / "none"))
    store.build(none, dimension=4)
    assert store.search(spark.createDataFrame([(1, [1.0] * 4)], "query_id int, embedding array<double>")).count() == 0
    one = VectorCells(spark, str(tmp_path / "one"))
    one.build(spark.createDataFrame([(5, [1.0, 0.0])], "chunk_id int, embedding array<double>"))
    assert [r.chunk_id for r in one.search(spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, embedding array<double>")).collect()] == [5]
    assert one.search(spark.createDataFrame([], "query_id int, embedding array<double>")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(500, 5)) * 7
    queries = rng.normal(size=(30, 5)) * 5
    centres = fit_centres(points, 9)
    assert len(centres) == 9
    for distance in ("dot", "euclid"):
        for centre in centres:
            near = points[np.argsort(((points - centre) ** 2).sum(1))[:40]]
            radius = np.sqrt(((near - centre) ** 2).sum(1).max())
            most = upper_bounds(queries, centre[None, :], np.array([radius]), distance)[:, 0]
            assert (retrieval._scores(queries, near, distance).max(1) <= most).all()


def points(spark, rows):
    frame = spark.createDataFrame(rows, "chunk_id string, language string, query_type string, embedding array<float>")
    return as_points(frame)


def test_a_collection_keeps_its_settings(spark, tmp_path):
    path = f"{tmp_path}/c"
    VectorCollection(spark, path, "dot", create=True, dimension=2).upsert(points(spark, [("a", "target", "X", [9.0, 9.0]), ("b", "target", "X", [1.0, 0.0])]), 0)
    again = VectorCollection(spark, path)
    assert (again.distance, again.dimension, again.count()) == ("dot", 2, 2)
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert again.search(asked, 1).first().chunk_id == "a" and VectorCollection(spark, path, "dot").distance == "dot"
    with pytest.raises(ValueError, match="distance dot"):
        VectorCollection(spark, path, "euclid")
    with pytest.raises(Exception, match="vectors of 2"):
        again.upsert(points(spark, [("c", "target", "X", [1.0])]), 1)
    corpus = spark.createDataFrame([("a", "text a"), ("b", "text b")], "chunk_id string, text string")

    class Fixed:
        def embed(self, texts, is_query=False):
            return np.array([[1.0, 0.0]])

    assert [c["chunk_id"] for c in retrieval.retrieve(spark, "x", Fixed(), again.points({"query_type": "X"}), corpus, 2, distance=again.distance)["retrieved_chunks"]] == ["a", "b"]


def test_versions_without_moving_vectors(spark, tmp_path):
    """Any order of versions and of rewriting them: readers see the last of each point, and shuffle no vector."""
    rng, path = random.Random(3), f"{tmp_path}/c"
    store, held = VectorCollection(spark, path, create=True), {}
    for version in (4, 0, 2, 2, 7, 5, 0):
        rows = [(f"k{rng.randrange(30)}", rng.choice(["target", "english"]), rng.choice("XY"), [float(version), rng.random()]) for _ in range(12)]
        rows = list({r[0]: r for r in rows}.values())
        store.upsert(points(spark, rows), version)
        held[version] = {r[0]: r for r in rows}
        want = {}
        for v in sorted(held):
            want |= held[v]
        got = {r.chunk_id: (r.language, r.query_type, r.embedding[0]) for r in store.points().collect()}
        assert got == {k: (r[1], r[2], r[3][0]) for k, r in want.items()} and store.count() == len(want)
        assert {r.chunk_id for r in store.points({"query_type": "X", "language": "target"}).collect()} == {k for k, r in want.items() if r[1:3] == ("target", "X")}
    filtered = store.points({"query_type": "X"})
    filtered.collect()
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("FileScan")[1:] if "embedding" in x.split("\n")[0])
    assert "by_query_type" in scan.partition("PartitionFilters")[2].partition("]")[0]
    left = plan.partition("BroadcastHashJoin")[2].partition("BroadcastExchange")[0]
    assert "LeftAnti" in left and "Exchange hashpartitioning" not in left and "Window" not in plan
    store.compact(9)
    assert store.versions() == [9] and store.superseded() is None and store.count() == len(want)


def test_batches_leave_few_versions(spark, tmp_path, monkeypatch):
    """Merges by powers of two; a failure before, within or after a merge's deletes, and the batch run again, lose nothing."""
    store, want, fail = VectorCollection(spark, f"{tmp_path}/c", create=True), {}, {}
    delete, write = VectorCollection._note_superseded, VectorCollection._write

    def noting(self, version):
        fail["notes"] = fail.get("notes", 0) + 1
        if fail["notes"] == fail.get("at"):
            raise RuntimeError("lost")
        delete(self, version)

    def writing(self, rows, version):
        if fail.get("write") == version:
            fail["write"] = None
            write(self, rows.limit(1), version)
            self._folder()[1].delete(self._path(f"version={version}/_SUCCESS"), False)
            raise RuntimeError("lost")
        write(self, rows, version)

    monkeypatch.setattr(VectorCollection, "_note_superseded", noting)
    monkeypatch.setattr(VectorCollection, "_write", writing)
    for number in range(16):
        rows = [(f"k{(number * 3 + i) % 11}", "target", "X", [float(number)]) for i in range(4)]
        batch = points(spark, rows).coalesce(1)
        want |= {r[0]: float(number) for r in rows}
        fail |= {"notes": 0, "at": {3: 2, 7: 3, 11: 1}.get(number), "write": {5: 6 * STEP + 1, 15: 16 * STEP}.get(number)}
        if fail["at"] or fail["write"]:
            with pytest.raises(RuntimeError):
                store.upsert_batch(batch, number)
        fail |= {"at": None}
        store.upsert_batch(batch, number)
        assert {r.chunk_id: r.embedding[0] for r in store.points().collect()} == want
        assert len(store.versions()) == (number + 1).bit_count()
    assert store.versions() == [16 * STEP + 4] and store.count() == 11


def test_last_in_a_batch_wins(spark, tmp_path):
    """Of a chunk's rows in the files of one batch the last in file order is what is stored."""
    schema = "chunk_id string, language string, query_type string, text string"
    for name, rows in (("a", [("x", "target", "A", "one"), ("y", "target", "A", "one"), ("x", "target", "B", "two")]), ("b", [("y", "target", "C", "three")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
    first, second = (spark.read.parquet(f"{tmp_path}/{n}").inputFiles()[0].removeprefix("file://") for n in "ab")
    import shutil

    (tmp_path / "corpus").mkdir()
    shutil.copy(first, tmp_path / "corpus/part-0.parquet")
    shutil.copy(second, tmp_path / "corpus/part-1.parquet")
    assert build_index(spark, f"{tmp_path}/corpus", f"{tmp_path}/points", f"{tmp_path}/progress", "TEST_ONLY:dim8") == 2
    store = VectorCollection(spark, f"{tmp_path}/points")
    assert {r.chunk_id: r.query_type for r in store.points().collect()} == {"x": "B", "y": "C"} and "place" not in store.points().columns
    assert json.loads(spark.read.text(f"{tmp_path}/points/_settings").first()["value"]) == {"distance": "cosine", "dimension": 8}



def test_hits_are_asked_for_and_given_in_parts(spark, monkeypatch):
    """A task holds ``HITS`` hits at most and gives them ``PART`` queries at a time; the result is the same."""
    rows = [(i, [float(i % 7), float(i % 5), float(i % 3), 1.0]) for i in range(60)]
    frame = spark.createDataFrame(rows, "key long, embedding array<double>").repartition(3)
    monkeypatch.setattr(retrieval, "HITS", 40)
    assert [len(keys) for keys, _ in retrieval.query_blocks(frame, "key", "embedding", 1 << 24, retrieval.HITS // 5)] == [8] * 7 + [4]
    found = retrieval.dense_topk(frame, frame, 5, query_key="key", corpus_key="key", places=9)
    assert sorted(tuple(r[:3]) for r in found.collect()) == sorted(plain(rows, rows, 5, "cosine"))
    best = retrieval.Best(3 * retrieval.PART, 1)
    best.add(np.ones((3 * retrieval.PART, 1)), [7], np.arange(3 * retrieval.PART))
    kinds = [pa.int64(), pa.int64(), pa.float64()]
    assert [len(b) for b in best.batches(list(range(3 * retrieval.PART)), kinds)] == [retrieval.PART] * 3
