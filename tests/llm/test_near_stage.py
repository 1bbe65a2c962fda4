"""The pipeline's near-dedup stage goes through op1's deletion variants."""

import random

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import near_copies, simhash
from corpusloom.llm.common import connected_components


def _texts(rng, groups=8, copies=6, size=4000):
    """Groups of long texts that differ in a word or two, and the group of each."""
    rows, group = [], {}
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(copies):
            copy = base[:]
            copy[rng.randrange(size)] = f"x{rng.randrange(5000)}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    return rows, group


def test_stage_finds_near_copies_by_variants(spark, monkeypatch):
    """Without the prefixes, which serve beyond the radius, all near copies inside it are still found."""
    rows, group = _texts(random.Random(4))
    prints = {i: near_copies.simhash(near_copies.shingles(t.encode())) for i, t in rows}
    assert all(((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= near_copies.BITS for i in prints for j in prints if group[i] == group[j])
    monkeypatch.setattr(near_copies, "_candidates", lambda sets, least, small: spark.createDataFrame([], "a long, b long"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()) == [g * 6 for g in range(8)]


def test_variants_only_propose(spark):
    """Texts inside the radius that aren't at Jaccard 0.8 both stay: the exact comparison decides."""
    base = [f"w{n}" for n in range(12)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:9] + ["other", "ending", "here"]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()} == {1, 3}


@pytest.mark.parametrize("most", [4, 1 << 13])
def test_links_at_seven_bits(spark, most):
    """Four segments lose no link at 7 bits, in heavy keys or light ones."""
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(5)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9))) for b in base for _ in range(25)})
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    roots = {r.node: r.root for r in connected_components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 7, most)).collect()}
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 7:
                assert roots[signed[i]] == roots[signed[j]]
    with pytest.raises(ValueError, match="7 differing bits"):
        simhash.links(spark.createDataFrame([], "fp long"), 8)


def test_variants_link_sets_in_one_search_for_components(spark, monkeypatch):
    """Sets of one SimHash and sets of SimHashes within the radius are connected, as by all pairs; the links are few."""
    rng = random.Random(8)
    prints = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(4))) for b in (rng.getrandbits(63) for _ in range(6)) for _ in range(9)]
    rows = [(n * 1000 + 7, int(np.uint64(p).view(np.int64))) for n, p in enumerate(prints + prints[::3])]
    monkeypatch.setattr(near_copies, "connected_components", lambda edges: pytest.fail("components are searched once, for all candidates"), raising=True)
    links = near_copies._by_variants(spark.createDataFrame(rows + rows[:4], "node long, fp long"), 7)
    found = [(r.a, r.b) for r in links.collect()]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(found, "a long, b long")).collect()}
    for node, fp in rows:
        for other, print_ in rows:
            if node < other and ((fp ^ print_) & (2**64 - 1)).bit_count() <= 7:
                assert roots[node] == roots[other]
    assert all(((dict(rows)[a] ^ dict(rows)[b]) & (2**64 - 1)).bit_count() <= 7 for a, b in found)
