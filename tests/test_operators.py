"""Golden rows, invariants and failure cases of the library's operators."""

import hashlib
import json
import math
import pickle
import random
import unicodedata
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import frames
from corpusloom.functions import text as X
from corpusloom.functions.frames import union_all
from corpusloom.operators import benchmark, chunking, evaluation, ingest, profile, quality, reports, retrieval
from corpusloom.operators.windows import AdaptiveRule, BudgetRule, WindowRule, adaptive_bounds, budget_bounds, halved_bounds, window_bounds
from corpusloom.sources import tables
from corpusloom.sources.vector_store import VectorCollection, as_points
from corpusloom.streaming.index_build import build_index, compatible

RAW = "source_lang string, target_lang string, meta string, Answer string, query_id long, query_type string, passages struct<English_passages:array<string>,Translated_passages:array<string>,is_selected:array<int>>, Eng_Query string, Eng_Answer string, query string, place int"


def raw(spark, *records):
    """Records given as (query_id, passages, English answer)."""
    return spark.createDataFrame([("en", "kn", None, "a", q, "ENTITY", p, "eq", a, "q", n) for n, (q, p, a) in enumerate(records)], RAW)


def column(spark, values, make, kind="string"):
    frame = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r.x for r in frame.select("n", make("v").alias("x")).orderBy("n").collect()]


# ---- text ----


def test_marks_that_are_no_integers(spark):
    """A blank mark is a warning and counts as 0; any other that isn't an integer can't be normalised."""
    kind = RAW.replace("is_selected:array<int>", "is_selected:array<string>")
    rows = [("en", "kn", None, "a", q, "ENTITY", (["a", "b"], ["c", "d"], marks), "eq", "a", "q", q) for q, marks in enumerate([["1", " "], ["1", "x"], ["0", None], ["0", "5"]])]
    got = ingest.validate(spark.createDataFrame(rows, kind)).orderBy("place").collect()
    assert [r.corruption_reason for r in got] == [None, "is_selected is not an integer", "is_selected is not an integer", None]
    assert [list(r.validation_warnings) for r in got] == [["non_integer_is_selected:index=1:value= "], [], [], ["unexpected_is_selected_value:index=1:value=5"]]
    kept = ingest.normalize(ingest.split_corrupt(ingest.validate(spark.createDataFrame(rows, kind)))[0]).orderBy("raw_query_id").collect()
    assert [[p.is_selected for p in r.passages] for r in kept] == [[1, 0], [0, 5]]


def test_answer_markers(spark):
    values = [" No Answer Present ", None, "", "　no answer present.\n", "Paris"]
    assert column(spark, values, X.has_answer) == [False, False, False, False, True]
    assert column(spark, values, X.answer_status)[-2:] == ["NO_ANSWER", "ANSWER_PRESENT"]


def test_nfc(spark):
    assert column(spark, ["é", None, "abc"], X.nfc) == ["é", "", "abc"]
    assert column(spark, [["é", None, "a"], [], ["b"]], X.nfc_all, "array<string>") == [["é", "", "a"], [], ["b"]]


def test_few_texts_reach_python(spark):
    """What the pattern passes over is in NFC; Kannada and Hindi text as it is written is passed over."""
    rng, block = random.Random(6), [chr(c) for c in range(0x900, 0xE00)]
    marks = [c for c in block if unicodedata.combining(c)]
    some = ["".join(rng.choices(rng.choice([block, marks + block[:200], [chr(c) for c in range(0x20, 0x300)] + block, ["e", "\u0301", "한", "ᄒ", "ᅡ"]]), k=rng.randrange(1, 6))) for _ in range(4000)]
    written = [unicodedata.normalize("NFC", t) for t in ("ಕನ್ನಡ ಭಾಷೆಯು ದಕ್ಷಿಣ ಭಾರತದ ಒಂದು ದ್ರಾವಿಡ ಭಾಷೆ. ಕೊಡುಗೆ — “ಹೌದು”", "हिन्दी में क़लम ज़रूर", "Ünïcödé çà et là", "plain")]
    assert column(spark, some + written, X.nfc) == [unicodedata.normalize("NFC", t) for t in some + written]
    looked = column(spark, some + written, lambda t: X._other(F.col(t) if isinstance(t, str) else t))
    assert not any(looked[-4:]) and all(seen or unicodedata.is_normalized("NFC", t) for t, seen in zip(some, looked[:-4], strict=True))


def test_unicode_blanks(spark):
    assert column(spark, ["a b　c\x1cd e", "   ", None], X.token_count) == [5, 0, 0]
    assert column(spark, ["  x \x1f"], X.strip) == ["x"]


def test_sentences_and_paragraphs(spark):
    assert column(spark, ["A b. C d!  E। F", "no end", " ", "x.y z"], X.sentences) == [["A b.", "C d!", "E।", "F"], ["no end"], [], ["x.y z"]]
    assert column(spark, ["a \n \n b\n\n\n c", "a\nb", ""], X.paragraphs) == [["a", "b", "c"], ["a\nb"], []]


def test_hash_ignores_case_and_blanks(spark):
    a, b, c = column(spark, ["Ab  c\n", " ab C", "abc"], X.text_hash)
    assert a == b != c


def test_buckets_and_classes(spark):
    assert column(spark, [0, 9, 10, 499, 500, 1000, -1], X.length_bucket, "int") == ["0-9", "0-9", "10-49", "200-499", "500-999", "1000+", "1000+"]
    assert column(spark, [40, 41, 120, 121, 250, 251], X.length_class, "int") == ["SHORT", "MEDIUM", "MEDIUM", "LONG", "LONG", "VERY_LONG"]


def test_json_and_uuid(spark):
    assert column(spark, [None, "", "{}", "[1", "{'a"], X.json_valid) == [True, True, True, False, False]
    ids = ["7_p0_sentence_3", "ü", ""]
    assert column(spark, ids, X.uuid5_url) == [str(uuid.uuid5(uuid.NAMESPACE_URL, i)) for i in ids]


# ---- ingestion ----


def test_validation_order_and_warnings(spark):
    rows = raw(
        spark,
        (None, None, ""),
        (1, None, ""),
        (2, (["a"], None, [0]), ""),
        (3, (["a", "b"], ["c"], [0, 1]), ""),
        (4, ([], [], []), ""),
        (5, (["a", "b"], ["c", "d"], [2, 1]), ""),
        (6, (["a"], ["c"], [None]), ""),
    )
    got = [(r.corruption_reason, list(r.validation_warnings)) for r in ingest.validate(rows).orderBy("place").collect()]
    assert [g[0] for g in got] == ["query_id is null", "passages is null", "One or more passage sub-fields is null", "Mismatched passage list lengths: English_passages=2, Translated_passages=1, is_selected=2", None, None, "is_selected is not an integer"]
    assert got[4][1] == ["empty_passages: both English_passages and Translated_passages are empty"] and got[5][1] == ["unexpected_is_selected_value:index=0:value=2"]
    assert [r.place for r in ingest.corrupt_examples(ingest.validate(rows), "place", 2).collect()] == [0, 1]


def test_schema_problems(spark):
    rows = raw(spark, (1, (["a"], ["b"], [1]), "x"))
    assert ingest.validate(rows.drop("query")).first().corruption_reason == "Missing required top-level field: 'query'"
    assert "not a dict" in ingest.validate(rows.withColumn("passages", F.lit("x"))).first().corruption_reason
    assert "is_selected" in ingest.validate(rows.withColumn("passages", F.col("passages").dropFields("is_selected"))).first().corruption_reason


def test_dedup_keeps_first_and_suffixes(spark):
    same = (["a"], ["b"], [1])
    rows = raw(spark, (7, same, "x"), (8, same, "x"), (7, (["c"], ["b"], [1]), "x"), (7, (["d"], ["b"], [0]), " x "), (7, (["d"], ["b"], [0]), "x"))
    records = ingest.normalize(ingest.split_corrupt(ingest.validate(rows))[0], "place")
    kept = ingest.dedup(records, "place").orderBy("place").collect()
    assert [(r.query_id, r.is_duplicate_query_id) for r in kept] == [("7", False), ("7__dup1", True), ("7__dup2", True)]
    assert tuple(ingest.dedup_stats(records, "place").first()) == (3, 2, 2, 1)
    assert ingest.dedup(records.limit(0), "place").count() == 0


def test_normalise_round_trip(spark):
    rows = raw(spark, (1, ([None, "é"], ["b", None], [1, 0]), None)).withColumn("meta", F.lit("m"))
    records = ingest.normalize(ingest.validate(rows).drop("corruption_reason"))
    got = records.first()
    assert [tuple(p) for p in got.passages] == [(0, "", "b", 1), (1, "é", "", 0)]
    assert json.loads(got.meta) == {"raw": "m"} and got.answer_status == "NO_ANSWER"
    assert ingest.reconstruct(ingest.flatten(records)).first() == got
    broken = ingest.flatten(records).withColumn("passages", F.lit(None).cast("string"))
    assert ingest.reconstruct(broken).first().passages == []


# ---- windows: closed forms against the walk they stand for ----


def walked(tokens, rule):
    """Windows made one sentence at a time."""
    out, at, n = [], 0, len(tokens)
    while at < n:
        end, total = at, tokens[at]
        while total < rule.target and end + 1 < n and total + tokens[end + 1] <= rule.most:
            end += 1
            total += tokens[end]
        while total < rule.least and end + 1 < n:
            end += 1
            total += tokens[end]
        out.append((at, end))
        if end == n - 1:
            break
        at = max(at + 1, end + 1 - rule.overlap)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=40), st.integers(0, 3))
def test_window_bounds(tokens, overlap):
    rule = WindowRule(overlap=overlap)
    assert window_bounds(np.array(tokens), rule) == walked(tokens, rule)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 200), min_size=1, max_size=40))
def test_budget_and_halves(tokens):
    array = np.array(tokens)
    groups = budget_bounds(array, BudgetRule())
    assert sorted({i for a, b in groups for i in range(a, b + 1)}) == list(range(len(tokens)))
    for (a, b), (c, _) in zip(groups, groups[1:], strict=False):
        assert a <= c <= b + 1 and sum(tokens[c : b + 1]) <= 20 and (c == a or sum(tokens[c - 1 : b + 1]) > 20)
        assert sum(tokens[a : b + 1]) + tokens[b + 1] > 150
    halves = halved_bounds(array, 250)
    assert [i for a, b in halves for i in range(a, b + 1)] == list(range(len(tokens)))
    assert all(sum(tokens[a : b + 1]) <= 250 or a == b for a, b in halves)


def test_window_cases():
    rule = WindowRule()
    assert window_bounds(np.array([5, 100, 50]), rule) == [(0, 1), (1, 1), (2, 2)]
    assert window_bounds(np.array([400]), rule) == [(0, 0)] and window_bounds(np.array([], dtype=int), rule) == []
    assert adaptive_bounds(np.array([60, 60]), AdaptiveRule()) == [(0, 1)] and halved_bounds(np.array([], dtype=int), 9) == []


# ---- chunks ----


def records(spark, *passages, query_id="9"):
    """One record of (English, target, selected) passages."""
    rows = [(query_id, "en", "kn", "ENTITY", True, "ANSWER_PRESENT", "h", [(n, e, t, s) for n, (e, t, s) in enumerate(passages)])]
    return spark.createDataFrame(rows, f"query_id string, source_lang string, target_lang string, query_type string, has_answer boolean, answer_status string, source_record_hash string, passages {ingest.PASSAGES}")


def test_quality_terms(spark):
    words = " ".join(f"S{i}." for i in range(19))
    texts = ["Abc.", "abc", "éa", words, " ", "a A b"]
    assert column(spark, texts, quality.boundary) == [1.0, 0.3, 0.6, 1.0, 0.0, 0.3]
    assert column(spark, [" ".join(["S."] * n) for n in (6, 7, 18, 19, 0)], quality.coherence) == [1.0, 0.92, 0.04, 0.0, 0.0]
    assert column(spark, ["a A b", ""], quality.density) == [0.667, 0.0]
    frame = spark.createDataFrame([(["a b", "b c"],), (["x"],)], "p array<string>")
    assert [r.q for r in frame.select(F.transform("p", lambda t: F.array_distinct(X.lower_words(t))).alias("s")).select(quality.penalties("s").alias("q")).collect()] == [[0.25, 0.25], [0.0]]


def test_blank_target_is_english(spark):
    rows = records(spark, ("Hi.", "  ", 1), ("", " ", 0), (" x ", "", 0))
    got = {r.chunk_id: r for r in chunking.chunk_views(rows).collect()}
    assert got["9_p0_passage_0"].text == "Hi." and got["9_p0_passage_0"].quality_score == 0.0 and got["9_p0_passage_0"].language == "english"
    assert not any("_p1_" in k for k in got)
    assert got["9_p2_passage_0"].text == " x " and got["9_p2_sentence_0"].text == "x"


def test_literal_paragraphs_and_views(spark):
    text = " ".join(["word"] * 30) + "\n\n" + " ".join(["other"] * 20)
    got = chunking.paragraph_chunks(records(spark, ("eng", text, 1))).orderBy("chunk_index").collect()
    assert [r.token_count_estimate for r in got] == [30, 20] and json.loads(got[0].metadata)["split_reason"] == "literal_paragraph_boundaries"
    assert got[0].text_english == "eng" and got[0].text_target == text
    long = " ".join(["w"] * 400)
    assert chunking.chunk_views(records(spark, (long, "", 0))).count() == 4
    with pytest.raises(ValueError):
        chunking.chunk_views(records(spark), ["semantic"])


def test_chunk_dedup(spark):
    text = "Same text here."
    chunks = chunking.dedup_chunks(chunking.chunk_views(records(spark, ("", text, 1), ("", text, 0), ("", "tiny", 0))))
    got = {r.chunk_id: r for r in chunks.collect()}
    for p in (0, 1):
        assert not got[f"9_p{p}_passage_0"].is_duplicate_chunk and got[f"9_p{p}_adaptive_0"].duplicate_of_chunk_id == f"9_p{p}_passage_0"
    about = json.loads(got["9_p0_passage_0"].metadata)
    assert about["duplicate_chunk_ids"] == ["9_p0_paragraph_0", "9_p0_sentence_0", "9_p0_adaptive_0"] and about["contributing_strategies"] == ["adaptive", "paragraph", "passage", "sentence"]
    total = chunking.dedup_summary(chunks).first()
    assert total.canonical_chunks + total.duplicate_chunks == total.total_chunks == 12 and total.below_min_length_chunks == 4
    assert tuple(chunking.drop_counts(chunks).first()) == (9, 1)
    order = chunks.limit(1).drop("chunk_id", "chunk_strategy", "chunk_text_hash").crossJoin(spark.createDataFrame([(f"9_p0_sentence_{n}", "sentence", "h") for n in (10, 2)], "chunk_id string, chunk_strategy string, chunk_text_hash string"))
    assert {r.chunk_id: r.is_duplicate_chunk for r in chunking.dedup_chunks(order.select(*chunks.columns)).collect()} == {"9_p0_sentence_10": False, "9_p0_sentence_2": True}


def test_min_length_edge(spark):
    chunks = chunking.dedup_chunks(chunking.passage_chunks(records(spark, ("a" * 9, "", 0), ("a" * 10, "", 0))))
    assert [r.below_min_length for r in chunks.orderBy("passage_index").collect()] == [True, False]


def test_reports_need_columns(spark):
    with pytest.raises(ValueError):
        reports.strategy_report(spark.range(1).withColumnRenamed("id", "chunk_strategy"))
    chunks = chunking.dedup_chunks(chunking.chunk_views(records(spark, ("", "Fine text here.", 1))))
    report = reports.validation_report(chunks)
    assert reports.passed(report) and not reports.passed(reports.validation_report(chunks.withColumn("parent_passage_id", F.lit("x"))))
    assert reports.merged_report(chunks, None).first().malformed_records is None


# ---- evaluation and fusion ----


def ranked(spark, *lists):
    return spark.createDataFrame([(q, n, c, 0.0) for q, ids in lists for n, c in enumerate(ids, 1)], "query_id string, rank int, chunk_id string, score double")


def test_metrics(spark):
    relevant = spark.createDataFrame([("q", "b"), ("q", "z"), ("none", "y")], "query_id string, chunk_id string")
    got = {r.query_id: r for r in evaluation.per_query(ranked(spark, ("q", "abc")), relevant, (1, 3)).collect()}
    q = got["q"]
    assert (q.recall_1, q.recall_3, q.hit_3, q.mrr_10) == (0.0, 0.5, 1.0, 0.5)
    assert q.ndcg_3 == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert all(v == 0 for k, v in got["none"].asDict().items() if k not in ("query_id", "n_relevant"))


def test_fusion(spark):
    fused = retrieval.rrf([ranked(spark, ("q", "ab")), ranked(spark, ("q", "bc"))]).orderBy("rank").collect()
    assert [r.chunk_id for r in fused] == ["b", "a", "c"] and fused[0].score == pytest.approx(1 / 62 + 1 / 61)
    assert fused[1].score > fused[2].score or fused[1].chunk_id == "a"
    with pytest.raises(ValueError):
        retrieval.rrf([])
    with pytest.raises(ValueError):
        retrieval.retrieval_modes(fused, fused, ["sparse"])


def test_unions_of_partitioned_inputs_group_right(spark):
    """Inputs that are laid out by the key already must still be grouped across them."""
    a = spark.range(200).selectExpr("id % 7 as k", "id as v").groupBy("k").agg(F.max("v").alias("v"))
    b = spark.range(300).selectExpr("id % 7 as k", "id as v").repartition(3, "k").groupBy("k").agg(F.max("v").alias("v"))
    got = union_all([a, b]).groupBy("k").agg(F.count("*").alias("n")).collect()
    assert sorted((r.k, r.n) for r in got) == [(k, 2) for k in range(7)]


def test_percentiles(spark):
    values = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],)], "v array<double>")
    assert [r.p for r in values.select(evaluation.nearest_rank("v", 50).alias("p")).collect()] == [3.0, 0.0]
    rows = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0, None)], "v double")
    got = evaluation.latency_summary(rows, "v").first()
    assert (got.p50_ms, got.p100_ms, got.mean_ms, got.n) == (3.0, 4.0, 2.5, 4)


# ---- search ----


def test_dense_blocks_and_filters(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "target" if i % 2 else "english") for i in range(80)] + [(99, None, "target")]
    corpus = spark.createDataFrame(rows, "chunk_id int, embedding array<double>, language string").repartition(5)
    asked = corpus.where("chunk_id < 7").select(F.col("chunk_id").alias("query_id"), "embedding")
    hits = lambda frame: sorted((r.query_id, r.rank, r.chunk_id) for r in frame.collect())
    assert hits(retrieval.dense_topk(asked, corpus, 4)) == hits(retrieval.dense_topk(asked, corpus, 4, block=2))
    assert all(r.chunk_id == r.query_id for r in retrieval.dense_topk(asked, corpus, 1, "euclid").collect())
    odd = retrieval.dense_topk(asked, corpus, 4, query_filter={"language": "target"}).collect()
    assert {r.chunk_id % 2 for r in odd} == {1} and 99 not in {r.chunk_id for r in odd}
    assert retrieval.dense_topk(asked.limit(0), corpus).count() == 0
    for bad in ({"is_selected": "1"}, {"answer": "x"}):
        with pytest.raises(ValueError):
            retrieval.dense_topk(asked, corpus, query_filter=bad)
    with pytest.raises(ValueError):
        retrieval.dense_topk(asked, corpus, distance="manhattan")


def test_bm25_against_formula(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("a b c d e f the the the".split(), k=rng.randrange(1, 12))) for _ in range(40)] + ["", None]
    corpus = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string").repartition(3)
    asked = spark.createDataFrame([("q", "a THE a zzz"), ("none", "zzz"), ("empty", None)], "query_id string, text string")
    docs = [(t or "").lower().split() for t in texts]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    average = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * average if v < 0 else v for w, v in idf.items()}
    score = lambda d, q: sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in q)
    for block in (1, 1024):
        got = retrieval.bm25_topk(asked, corpus, 10, block=block).orderBy("query_id", "rank").collect()
        for name, query in (("q", ["a", "the", "a", "zzz"]), ("none", ["zzz"]), ("empty", [])):
            want = sorted(range(n), key=lambda i: (-round(score(docs[i], query), 9), i))[:10]
            assert [r.chunk_id for r in got if r.query_id == name] == want


def test_embedder(spark):
    embedder = retrieval.get_embedder("TEST_ONLY:dim32")
    vectors = embedder.embed(["ab cd", "", None])
    assert vectors.shape == (3, 32) and np.linalg.norm(vectors[0]) == pytest.approx(1) and not vectors[1:].any()
    assert retrieval.warm_up(embedder, 2) >= 0 and isinstance(retrieval.get_embedder("intfloat/e5"), retrieval.TransformerEmbedder)
    with pytest.raises(ValueError):
        retrieval.get_embedder("any", device="tpu")
    got = retrieval.embed(spark.createDataFrame([("ab cd",), (None,)], "text string"), embedder).collect()
    assert np.allclose(sorted(r.embedding for r in got)[1], vectors[0])


# ---- benchmark, sources, index ----


def test_quotas():
    assert benchmark.quotas({"a": 7, "b": 7, "c": 7, "d": 7, "e": 1}, 6) == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 1}
    assert benchmark.quotas({"a": 3}, 10) == {"a": 3} and sum(benchmark.quotas({"a": 50, "b": 30, "c": 20}, 10).values()) == 10


def test_subset_never_trims(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"{i // 3}_p{i % 3}", str(i // 3), 1, "passage", 0) for i in range(12)], "chunk_id string, parent_passage_id string, query_id string, is_selected int, chunk_strategy string, chunk_index int")
    bench = spark.createDataFrame([("0", ["0_p1", "9_p9"])], "query_id string, ground_truth_parent_passage_ids array<string>")
    small = benchmark.corpus_subset(chunks, bench, 1)
    assert {r.origin for r in small.collect()} == {"positive", "hard_negative"} and small.count() == 3
    assert benchmark.corpus_subset(chunks, bench, 8).count() == 8 and benchmark.corpus_subset(chunks, bench, 99).count() == 12
    assert [r[0] for r in benchmark.missing_ground_truth(bench, small).collect()] == ["9_p9"]


def test_files(spark, tmp_path):
    chunks = chunking.dedup_chunks(chunking.chunk_views(records(spark, ("", "Fine text here.", 1))))
    tables.write_chunks(chunks, f"{tmp_path}/chunks")
    back = tables.read_chunks(spark, f"{tmp_path}/chunks", ["sentence"])
    assert sorted(back.columns) == sorted(chunks.columns) and [r.chunk_strategy for r in back.collect()] == ["sentence"]
    assert not tables.write_table(chunks.limit(0), f"{tmp_path}/none", skip_empty=True) and tables.read_report(spark, f"{tmp_path}/nothing") is None
    tables.write_report(reports.chunk_report(chunks), f"{tmp_path}/report")
    assert tables.read_report(spark, f"{tmp_path}/report").first().output_chunks == 4
    (tmp_path / "c.json").write_text('{"top_k": 5, "embedding_models": [{"name": "m"}], "reranker": {"enabled": false}}')
    config = tables.read_config(spark, f"{tmp_path}/c.json")
    assert config.top_k == 5 and config.embedding_models == ("m",) and config.extra == {"reranker": {"enabled": False}}
    assert tables.first_rows(chunks, 0, "chunk_id").count() == 0 and tables.row_count(spark, f"{tmp_path}/chunks") == 4
    placed = tables.with_place(spark.read.parquet(f"{tmp_path}/chunks")).select("place").collect()
    assert len({r.place for r in placed}) == 4


def test_benchmark_lines(spark, tmp_path):
    rows = records(spark, ("", "Fine text here.", 1), ("other", "", 0)).withColumns({"query_target": F.lit("ಪ"), "query_english": F.lit("e")})
    chunks = chunking.chunk_views(rows)
    bench = benchmark.ground_truth(benchmark.stratified_sample(benchmark.eligible(rows), 5), chunks)
    assert not {"answer_target", "answer_english", "is_selected"} & set(bench.columns)
    tables.write_json_lines(bench.drop("sample_place"), f"{tmp_path}/b")
    back = tables.read_benchmark(spark, f"{tmp_path}/b")
    assert back.first().query == "ಪ" and sorted(r.chunk_id for r in evaluation.relevance(back).collect()) == [f"9_p0_{s}_0" for s in sorted(chunking.STRATEGIES)]
    assert evaluation.relevance(back, "sentence").count() == 1 and evaluation.relevance(back, "missing").count() == 0


def test_collection_and_resume(spark, tmp_path):
    rows = records(spark, *[("", f"Text number {i} of many.", 1) for i in range(30)])
    chunks = chunking.passage_chunks(rows)
    chunks.where("passage_index < 20").repartition(4).write.parquet(f"{tmp_path}/corpus")
    args = (spark, f"{tmp_path}/corpus", f"{tmp_path}/points", f"{tmp_path}/progress", "TEST_ONLY:dim32")
    assert build_index(*args, batch_files=2) == 20
    chunks.where("passage_index >= 15").coalesce(1).write.mode("append").parquet(f"{tmp_path}/corpus")
    assert build_index(*args, batch_files=2) == 30
    store = VectorCollection(spark, f"{tmp_path}/points")
    asked = retrieval.embed(spark.createDataFrame([("q", "text number 7 of many.")], "query_id string, text string"), retrieval.HashingEmbedder(32))
    assert store.search(asked, 1).first().chunk_id == "9_p7_passage_0"
    found = retrieval.retrieve(spark, "text number 7 of many.", retrieval.HashingEmbedder(32), store.points(), chunks, 2, {"language": "target"})
    assert found["retrieved_chunks"][0]["text"] == "Text number 7 of many." and "text" not in json.loads(found["retrieved_chunks"][0]["metadata"])
    store.upsert(as_points(retrieval.embed(chunks.where("passage_index = 0"), retrieval.HashingEmbedder(32))), 99)
    assert store.count() == 30
    with pytest.raises(ValueError, match="newer"):
        store.compact(99)
    store.compact(100)
    assert store.count() == 30 and store.versions() == [100]
    hits = store.points({"language": "target"})
    assert hits.count() == 30 and "by_language" not in hits.columns and store.points({"language": "english"}).count() == 0
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "by_language" in plan.partition("PartitionFilters")[2].partition("]")[0]
    both = store.points().limit(1).select("*", F.lit(1).alias("at")).union(store.points().limit(1).select(*[F.lit("old").alias(c) if c == "query_type" else c for c in store.points().columns], F.lit(0).alias("at")))
    store.upsert(both, 101, order="at")
    assert store.count() == 30 and store.points({"query_type": "old"}).count() == 0
    narrow = VectorCollection(spark, f"{tmp_path}/points", dimension=16)
    with pytest.raises(Exception, match="vectors of 16"):
        narrow.upsert(store.points().limit(1), 102)
    assert build_index(*args, batch_files=3) == 30  # another batch size can't resume: made anew
    with pytest.raises(ValueError):
        VectorCollection(spark, f"{tmp_path}/nowhere")


def test_resume_terms():
    run = {"corpus": "c", "model": "m", "collection": "k", "batch_size": 1, "device": "cuda"}
    assert compatible(run | {"device": "mps", "files": ["a:1:1"]}, run | {"files": ["a:1:1", "b:2:2"]}) and not compatible(run | {"device": "cpu", "files": ["a:1:1"]}, run | {"files": ["a:9:2"]})
    assert compatible(run | {"device": "mps"}, run) and not compatible(run, run) and not compatible(run | {"device": "cpu", "model": "n"}, run)


def test_profile(spark):
    frame = spark.createDataFrame([(1, None, (["a"], "x")), (1, "b", ([], "y")), (None, "b", None)], "k int, t string, s struct<l:array<string>,z:string>")
    assert {r["column"]: r.n_null for r in profile.null_counts(frame).collect()} == {"k": 1, "t": 1, "s": 1}
    assert profile.repeated_keys(frame, "k").first()[0] == 1 and profile.nested_types(frame, "s")["z"] == "string" and profile.nested_types(frame, "k") == {}
    assert tuple(profile.nested_lengths(frame, "s").first()) == ("l", 0, 1, "0,1")
    assert json.loads(profile.failure_report(ValueError("no"), "read"))["error_type"] == "ValueError"
    assert profile.any_null(frame, ["k", "t"]).count() == 2 and len(profile.sample_records(frame, "t", 2).collect()) == 2
    with pytest.raises(ValueError):
        profile.nested_lengths(frame, "k")


def test_models_are_not_sent_with_tasks():
    """A loaded model stays where it was loaded, and only named models take prefixes."""
    embedder = retrieval.get_embedder("intfloat/multilingual-e5-small")
    embedder._model = lambda: None
    assert pickle.loads(pickle.dumps(embedder.__getstate__()))["_model"] is None
    assert embedder.name in retrieval.PREFIXED and "my/e5000" not in retrieval.PREFIXED


@pytest.mark.parametrize("most", [3, 10_000])
def test_seeded_draw_is_the_first_of_the_order(spark, most):
    rows = spark.createDataFrame([(f"k{n}", "abc"[n % 3]) for n in range(900)], "key string, kind string")
    got = {r.key for r in benchmark.seeded_draw(rows, {"a": 17, "b": 300, "c": 0, "d": 4}, 7, "key", F.col("kind"), most).collect()}
    order = sorted((hashlib.md5(f"7:k{n}".encode()).hexdigest(), f"k{n}", "abc"[n % 3]) for n in range(900))
    assert got == {k for _, k, kind in [x for x in order if x[2] == "a"][:17]} | {k for _, k, kind in order if kind == "b"}


def test_running_total_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "x", "x", "x", "y"]), n, rng.randrange(5)) for n in range(500)]
    got = frames.running_total(spark.createDataFrame(rows, "g string, n long, w int"), ["g"], ["n"], F.col("w"), "t").collect()
    assert len(got) == 500 and all(r.t == sum(w for g, n, w in rows if g == r.g and n < r.n) for r in got)
    assert {r.t for r in frames.running_total(spark.range(40), [], ["id"], F.lit(1), "t").collect()} == set(range(40))


def test_dense_ties_of_rounded_scores(spark):
    """Of many rows whose scores differ in the last digits only, the smallest ids are kept, however many there are."""
    corpus = spark.createDataFrame([(n, [1.0, n * 1e-9]) for n in range(400)], "chunk_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], "query_id long, embedding array<double>")
    got = retrieval.dense_topk(asked, corpus, 30, places=5).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in got] == [*range(30)] * 2
