"""Each operator on nulls, empty, blank and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontamination, line_dedup, near_copies, packing, quality, secret_scan, sharding, simhash, spotsigs, token_counts, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
KEYS = Counter([1, 2, 3, 4, 5, 6, 7, 8, 8, None, None, 11])


def test_all_queries_are_registered():
    """The entry leaves these queries out where they can't be imported; here they can."""
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names


def keys(rows):
    return Counter(r["doc_id"] for r in rows)


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert keys(rows) == KEYS
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].component == by[6].component == 1
    assert by[2].fp == by[3].fp == by[4].fp == 0 and by[2].component == by[3].component == by[4].component == 2
    assert {r.component for r in rows if r.doc_id is None} <= {None, 2}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert keys(kept.collect())[8] == 2 and 6 not in keys(kept.collect())


def test_secrets(docs, none):
    rows = secret_scan.find_secrets(docs).collect()
    assert keys(rows) == KEYS
    assert all(r.n_assign == r.n_access == r.n_hex == 0 and r.spans == [] for r in rows)
    assert secret_scan.find_secrets(none).count() == 0


def test_quality(docs, none, labels, spark):
    rows = quality.classify(docs, labels).collect()
    assert keys(rows) == KEYS
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert quality.classify(none, labels).count() == 0
    assert keys(quality.classify(docs, labels.limit(0)).collect()) == KEYS
    kept = quality.reject(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns and keys(kept.collect()) == KEYS
    assert quality.reject(docs, labels, threshold=1.1).count() == 0


def test_spotsigs(docs, none):
    rows = spotsigs.compare_with_edits(docs).collect()
    assert keys(rows) == KEYS
    assert spotsigs.compare_with_edits(none).count() == 0
    alone = spotsigs.compare_with_edits(docs.where("doc_id = 7")).first()
    assert alone.signatures == alone.next_signatures and len(alone.edited) == len(alone.text)
    clashing = spotsigs.with_signatures(docs.select("doc_id", "text", *[F.lit(c).alias(c) for c in ("_words", "_content", "_chains")]), "text", "s")
    assert clashing.columns == ["doc_id", "text", "_words", "_content", "_chains", "s"]
    found = {r.doc_id: r.component for r in spotsigs.similar_documents(docs).collect() if r.doc_id is not None}
    assert found[1] == found[6] == 1 and found[2] == found[3] == found[4] and found[7] == 7
    assert spotsigs.similar_documents(none).count() == 0


def test_decontamination(docs, none, items):
    rows = decontamination.contamination(docs, items).collect()
    assert keys(rows) == KEYS
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].n_hit == 11 and list(by[1]["items"]) == ["1"]
    assert by[7].n_hit == 3 and list(by[7]["items"]) == ["4"]
    assert by[2].n_words == by[3].n_words == by[4].n_words == 0
    assert decontamination.contamination(none, items).count() == 0
    assert all(r.n_hit == 0 for r in decontamination.contamination(docs, items.limit(0)).collect())
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect() if r.doc_id is not None}
    assert 1 not in texts and texts[7].startswith(" of text\nshared") and texts[2] is None and texts[3] == ""


def test_packing(docs, none):
    rows = packing.pack(docs, TOKENIZER).collect()
    assert {None, 2, 3, 5} <= set(keys(rows))
    assert {(r.length, r.ids[0]) for r in rows if r.doc_id in (2, 3)} == {(1, 1)}
    assert packing.pack(none, TOKENIZER).count() == 0
    assert set(keys(packing.pack(docs, TOKENIZER, end=None).collect())) == {1, 4, 5, 6, 7, 8, None, 11}


def test_sharding(docs, none):
    rows = sharding.shards(docs, 1000).collect()
    assert keys(rows) == KEYS
    assert sum({r.shard: r.shard_bytes for r in rows}.values()) == sum(len((t or "").encode()) for _, t in [tuple(x) for x in docs.select("doc_id", "text").collect()])
    assert [r.oversized for r in rows if r.doc_id == 5] == [True]
    assert all(not r.oversized for r in rows if r.doc_id != 5)
    assert len({r.shard for r in rows if r.doc_id == 8}) == 1
    assert sharding.shards(none, 1000).count() == 0
    deep = sharding.shards(docs, 1).collect()
    assert keys(deep) == KEYS and len({r.doc_id for r in deep if r.shard == [x.shard for x in deep if x.doc_id == 8][0]} - {8, 2, 3}) == 0


def test_toxicity(docs, none, labels):
    rows = toxicity.classify(docs, labels, most_docs=60).collect()
    assert keys(rows) == KEYS and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert toxicity.classify(none, labels, most_docs=60).count() == 0
    assert keys(toxicity.classify(docs, labels.limit(0), most_docs=60).collect()) == KEYS


def test_token_counts(docs, none, spark):
    rows = token_counts.count_tokens(docs, TOKENIZER).collect()
    assert set(keys(rows)) == set(KEYS)
    assert {(r.section, r.start, r.n_tokens) for r in rows if r.doc_id in (2, 3)} == {(-1, None, 0)}
    assert sum(r.n_tokens for r in rows if r.doc_id == 5) == [r.doc_tokens for r in rows if r.doc_id == 5][0]
    assert token_counts.count_tokens(none, TOKENIZER).count() == 0
    given = spark.createDataFrame([(1, "one two three", [(4, 7), (0, 3), (2, 5), (9, 9), (12, 8)]), (2, "abc", None)], "doc_id long, text string, s array<struct<start:long,end:long>>")
    found = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens) for r in token_counts.count_tokens(given, TOKENIZER, "s").collect()}
    assert found[(1, 0)] == (0, 3, 1) and found[(1, 1)][:2] == (3, 5) and found[(2, -1)] == (None, None, 1)
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, TOKENIZER, rule="any")


def test_line_dedup(docs, none):
    rows = line_dedup.dedup_lines(docs, counts="counted")
    assert rows.columns == [*docs.columns, "counted"]
    got = [(r.doc_id, r.text, r.counted.n_lines, r.counted.n_dropped) for r in rows.collect()]
    assert Counter(g[0] for g in got) == KEYS
    by = {g[0]: g for g in got if g[0] is not None}
    assert by[6][1:] == ("", 1, 1) and by[1][3] == 0
    assert by[7][3] == 0 and by[8][1:] == ("another unique ending here", 2, 1)
    assert by[2][1:] == (None, 1, 0) and by[3][1:] == ("", 1, 0)
    assert {g[1:] for g in got if g[0] is None} == {("shared line that many have", 1, 0), (None, 1, 0)}
    assert line_dedup.dedup_lines(none).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, docs, none, labels, items, tmp_path, empty):
    """Every stage takes the rows that the stage before could leave, and keeps the columns."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = (none if empty else docs).withColumn("n_chars", F.lit(0).cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        if name != "packing":
            assert out.columns == frame.columns
            if not empty:
                assert all(r.n_chars == len(r.text or "") for r in out.select("text", "n_chars").collect()) or name in ("quality", "near_dedup")
        assert (out.count() == 0) == empty


def test_string_keys(spark, docs, labels, items):
    """Every operator takes keys of another type, and gives them back; smallest then means first by bytes."""
    named = docs.select(F.concat(F.lit("u"), F.lpad(F.col("doc_id").cast("string"), 3, "0")).alias("doc_id"), *[c for c in docs.columns if c != "doc_id"])
    marks = labels.select(F.concat(F.lit("u"), F.lpad(F.col("doc_id").cast("string"), 3, "0")).alias("doc_id"), "quality", "toxic")
    want = Counter(None if k is None else f"u{k:03d}" for k in KEYS.elements())
    near = {r.doc_id: r.component for r in simhash.near_duplicates(named).collect() if r.doc_id}
    assert near["u006"] == near["u001"] == "u001" and near["u004"] == "u002"
    assert {r.doc_id: r.component for r in near_copies.near_duplicates(named).collect() if r.doc_id}["u006"] == "u001"
    assert {r.doc_id: r.component for r in spotsigs.similar_documents(named).collect() if r.doc_id}["u006"] == "u001"
    lines = line_dedup.dedup_lines(named, counts="counted")
    assert {r.doc_id: r.counted.n_dropped for r in lines.collect()}["u008"] == 1
    whole = (near_copies.near_duplicates(named), secret_scan.find_secrets(named), quality.classify(named, marks), spotsigs.compare_with_edits(named), decontamination.contamination(named, items), sharding.shards(named, 1000), toxicity.classify(named, marks, most_docs=60), lines)
    assert all(keys(frame.collect()) == want for frame in whole)
    for frame in (packing.pack(named, TOKENIZER), token_counts.count_tokens(named, TOKENIZER)):
        assert set(keys(frame.collect())) <= set(want) and dict(frame.dtypes)["doc_id"] == "string"


def test_long_text_is_whole(docs):
    """The very long text's end counts: its last word changes what is found."""
    text = [r.text for r in docs.where("doc_id = 5").collect()][0]
    changed = docs.where("doc_id = 5").withColumn("text", F.concat("text", F.lit(" token=" + "Q" * 20)))
    assert secret_scan.find_secrets(changed).first().n_assign == 1
    pieces = packing.pack(changed, TOKENIZER).collect()
    whole = [i for p in sorted(pieces, key=lambda p: p.start) for i in p.ids]
    encoder = packing.Encoder(TOKENIZER)
    assert whole == [*encoder.ids(text + " token=" + "Q" * 20).tolist(), 1]
    assert hashlib.sha256(text.encode()).hexdigest()
