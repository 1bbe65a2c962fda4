"""Chunks flagged inside their passage, and overlaps of many pieces, against plain versions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chunking, ingest, quality
from corpusloom.plans import catalog


def records(spark, rng, n=40):
    """Records of several passages: short, long, blank, repeated and one-word ones, in both languages."""
    words = ["Alpha", "beta", "gamma", "delta", "x", "the", "of", "été", "zwei"]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 25))).capitalize() + rng.choice([". ", "! ", "? ", " "])

    def text():
        kind = rng.random()
        if kind < 0.2:
            return rng.choice([None, "", "  ", "x", "One.", "One. One. One."])
        if kind < 0.3:
            return "Same words here. " * rng.randrange(1, 60)
        return rng.choice(["", "\n\n", " "]).join("".join(sentence() for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 6)))

    rows = [(i, ([text() for _ in range(k)], [rng.choice([text(), ""]) for _ in range(k)], [rng.randrange(2) for _ in range(k)])) for i in range(n) for k in [rng.randrange(0, 5)]]
    schema = "query_id long, passages struct<English_passages:array<string>,Translated_passages:array<string>,is_selected:array<int>>"
    frame = spark.createDataFrame(rows, schema).withColumns({c: F.lit("") for c in ingest.REQUIRED_FIELDS if c not in ("query_id", "passages")})
    return ingest.normalize(ingest.validate(frame).where("corruption_reason is null"))


@pytest.mark.parametrize("strategies", [chunking.STRATEGIES, ("sentence",), ("passage", "adaptive")])
def test_flags_are_those_of_the_whole_table(spark, strategies):
    found = records(spark, random.Random(len(strategies)))
    want = chunking.dedup_chunks(chunking.chunk_views(found, strategies), 15)
    got = chunking.flagged_views(found, strategies, 15)
    assert got.columns == want.columns
    rows = lambda frame: sorted(map(str, frame.collect()))
    assert rows(got) == rows(want) and got.where("is_duplicate_chunk").count() > 0 or strategies == ("sentence",)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        chunking.flagged_views(found, ["other"])


def plain(sets):
    return [max([len(a & b) for j, b in enumerate(sets) if j != i], default=0) for i, a in enumerate(sets)]


@pytest.mark.parametrize("dense", [0, 1 << 22])
def test_overlaps(monkeypatch, dense):
    """Both ways give the largest overlap of all pairs."""
    monkeypatch.setattr(quality, "DENSE", dense)
    rng = random.Random(3)
    for _ in range(300):
        sets = [set(rng.choices(range(-20, 40), weights=[1 / (k + 1) for k in range(60)], k=rng.randrange(0, 15))) for _ in range(rng.randrange(0, 12))]
        flat = np.array([w for s in sets for w in s], dtype=np.int64)
        assert quality.largest_overlaps(flat, np.cumsum([len(s) for s in sets], dtype=np.int64)).tolist() == plain(sets)


@pytest.mark.parametrize("dense", [0, 200, 1 << 22])
def test_overlaps_of_a_passages_views(spark, monkeypatch, dense):
    """Different words and largest overlaps of runs of words in several views, by number and by text."""
    monkeypatch.setattr(quality, "DENSE", dense)
    rng = random.Random(4)
    for _ in range(200):
        words = np.array(rng.choices(range(-9, 30), k=rng.randrange(1, 60)), dtype=np.int64)
        at = [0, rng.randrange(len(words) + 1), len(words)]
        codes, tops = quality.passage_codes(words, at)
        for a, b, low, high in zip(at, at[1:], tops, tops[1:], strict=False):
            views = [sorted(sorted(rng.choices(range(b - a + 1), k=2)) for _ in range(rng.randrange(1, 7))) for _ in range(3)]
            flat, ends = np.array([run for view in views for run in view]), np.cumsum([0, *map(len, views)]).tolist()
            got = quality.passage_overlaps(codes[a:b] - low, high - low, flat[:, 0], flat[:, 1], ends)
            sets = [[set(words[a:b][x:y].tolist()) for x, y in view] for view in views]
            assert got.tolist() == [[len(s) for view in sets for s in view], [n for view in sets for n in plain(view)]]


def test_one_pass_over_numbers(spark):
    """Python sees sentences and words as numbers, once, and sets of words are never made for each piece."""
    plan = chunking.flagged_views(records(spark, random.Random(1)).localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "array_distinct(flatten(" not in plan and "substring(lambda" not in plan


def test_plain_texts(spark):
    """Tidy texts, which aren't split, and others give the same words; lengths are counted in characters."""
    blanks = [" ", "\n", "  ", "\n ", "\t", "\u3000", "\x85", " \u200a"]
    texts = ["Été", "x", ""] + [f"A{b}ΣΑΣ{c}ß.{b}İ" for b in blanks for c in blanks]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(X.plain("t", X.is_tidy("t")).alias("fast"), F.array_join(X.lower_words("t"), " ").alias("slow"), X.is_tidy("t").alias("tidy"))
    found = found.select("*", X.plain_count("fast").alias("n"), X.plain_words("fast").alias("words")).collect()
    assert all(r.fast == r.slow and r.n == len(r.words) == len(r.slow.split()) for r in found)
    assert [t for t, r in zip(texts, found, strict=True) if r.tidy] == texts[:3] + [f"A{b}ΣΑΣ{c}ß.{b}İ" for b in " \n" for c in " \n"]


def test_a_passage_of_thousands_of_pieces():
    """Windows of a long text: common words in all of them, neighbours that overlap."""
    rng = np.random.default_rng(1)
    sets = [np.unique(np.r_[rng.zipf(1.3, 60) % 50_000, 100_000 + np.arange(i, i + 12)]) for i in range(8_000)]
    began = time.time()
    found = quality.largest_overlaps(np.concatenate(sets), np.cumsum([len(s) for s in sets]))
    assert time.time() - began < 300 and len(found) == 8_000
    for i in rng.integers(0, 8_000, 5).tolist():
        assert found[i] == max(len(np.intersect1d(sets[i], s, assume_unique=True)) for j, s in enumerate(sets) if j != i)


def test_counts_ask_for_no_hash(spark):
    """Reports that look at no flag neither hash nor sort the pieces."""
    for name in ("report_chunk_counts", "report_chunks", "report_histogram", "chunk_text_views"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "sha2(" not in plan and "array_sort(filter" not in plan
