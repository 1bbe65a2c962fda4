"""The audit of sources against a plain version with whole numbers, and its edge rows."""

import random
import re
import string
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import source_audit

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows, least, top=10, smooth=2):
    """(lang, source, text) rows to the audit's rows, with Python's integers."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, words = lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    found = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: counts[lang, s] for x, s in groups if x == lang}
        own[None] = sum(own.values(), Counter())
        sizes = {s: sum(c[t] for t in kept) + smooth * len(kept) for s, c in own.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + smooth) // sizes[s] for t in kept} for s, c in own.items()}
        far = lambda a, b, t: (p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t])
        for s in own:
            if s is not None:
                pairs = [(o, sum(far(s, o, t) for t in kept)) for o in own if o not in (s, None)]
                terms = [(t, far(s, None, t)) for t in kept if own[s][t] and p[s][t] > p[None][t]]
                for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                    items.sort(key=lambda x: (-x[1], x[0].encode()))
                    found += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(items[:most], 1)]
    return sorted(found)


def made(rng, n):
    names, words = ["a", "b", "ä", "zz", "", None], ["one", "Two", "drei", "été", "日本", "X", "x", "q1q"]
    return [(rng.choice(["en", "de", None]), rng.choice(names), rng.choice([None, "", " ".join(rng.choices(words, weights=range(1, 9), k=rng.randrange(30)))])) for _ in range(n)]


@pytest.mark.parametrize("least, seed", [(1, 1), (10, 2), (40, 3), (10**6, 4)])
def test_against_whole_numbers(spark, least, seed):
    rows = made(random.Random(seed), 400)
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    got = source_audit.audit(frame, least).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, least)


def test_edge_rows(spark, docs, none):
    """Clashing columns, a language that is a number, one source: no pairs; an empty table: nothing."""
    named = docs.drop("source").withColumn("source", F.lit("s"))
    got = source_audit.audit(named, least=2).collect()
    rows = [("1", "s", r.text) for r in docs.select("text").collect()]
    assert sorted(tuple(r) for r in got) == plain(rows, 2)
    assert source_audit.audit(none.withColumn("source", F.lit("s"))).count() == 0


def test_small_sums_and_batches(spark):
    """Sums that are sent after every few terms, and runs that go on over many batches, change nothing."""
    rows = made(random.Random(5), 300)
    frame = spark.createDataFrame([(x or "", s or "", t) for x, s, t in rows], "lang string, source string, text string").repartition(7)
    whole = {(r.lang, r.term, r.source): (r["count"], r.total) for r in source_audit.term_counts(frame, 5).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        cut = {(r.lang, r.term, r.source): (r["count"], r.total) for r in source_audit.term_counts(frame, 5, most=4).collect()}
        found = sorted(tuple(r) for r in source_audit.audit(frame, 5).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cut == whole and found == plain(rows, 5)


def test_many_sources_and_large_counts(spark):
    """Shares stay exact where a product would overflow."""
    frame = spark.createDataFrame([(10**12, 3 * 10**14, 5 * 10**5), (0, 0, 1), (0, 0, 0), (7, 9, 3)], "c long, n long, v long")
    got = [r[0] for r in frame.select(source_audit.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (10**12 + 2) // (3 * 10**14 + 10**6), 1 + 10**9, None, 1 + 10**9 * 9 // 15]


def test_pieces_are_whole():
    text = ("Ab cD-eé " * 999).encode()
    whole = [w for p in source_audit.term_pieces(text) for w in p]
    assert [w for p in source_audit.term_pieces(text, 7) for w in p] == whole == [b"ab", b"cd", "eé".encode()] * 999


def test_runs_are_whole():
    batch = pa.record_batch({"k": [1, 1, 2, 2, 2, 3]})
    cut = source_audit.whole_runs(iter([batch.slice(i, 1) for i in range(6)]), 1)
    assert [b.column(0).to_pylist() for b in cut] == [[1, 1], [2, 2, 2], [3]]
