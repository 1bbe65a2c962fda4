"""Personal data: patterns against the contract's own expressions, disclosure against a plain count."""

import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.llm import private_data as P
from corpusloom.llm import queries

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_spans(text):
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in string.digits]
        checked = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and checked % 10 == 0:
            found.append((2, *m.span()))
    return found + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c in string.digits for c in m[0]) <= 15]


def test_patterns_on_odd_texts():
    rng = random.Random(1)
    parts = ["a", "Z", ".", "@", "-", "1", "22", "255", "256", "0007", "+1", "+", " ", "(", ")", "é", "\n", "%", "4000 0000 0000 0002", "4111111111111111", "a@b.c", "1.2.3.4"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert P.base_spans(text) == plain_spans(text), text


def test_patterns_stay_linear():
    for part in ("1", "1.", "1-", "a", "@", "a@", "a@b", "+1(", "a.b@c.", "+"):
        P.base_spans(part * 300_000)


def test_query(spark, tiny):
    texts = pd.read_parquet(f"{tiny}/documents.parquet").set_index("doc_id").text.to_dict()
    got = queries.op12_private_data(spark, tiny).toPandas().set_index("doc_id")
    assert set(got.index) == set(texts)
    for key, text in texts.items():
        base, row = plain_spans(text), got.loc[key]
        named = ",".join(f"{P.BASE[k]}:{a}:{b}" for k, a, b in base)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == n for k, _, _ in base) for n in range(4)]
        assert row.base_sha256 == hashlib.sha256(named.encode()).hexdigest() and row.spans.startswith(named)


def plain_terms(texts, threshold, contexts, window):
    """term: shown text, by counting everything; in the unmasked terms' order."""
    totals, near, seen = Counter(), defaultdict(Counter), defaultdict(set)
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    for text in texts:
        text = text or ""
        spans, cover = plain_spans(text), list(text)
        for _, a, b in spans:
            cover[a:b] = " " * (b - a)
        words = [(m.start(), m[0].translate(LOWER)) for m in word.finditer("".join(cover))]
        totals.update(w for _, w in words)
        held = set()
        for kind, a, b in spans:
            value = text[a:b].translate(LOWER) if kind < 2 else re.sub("[^0-9]", "", text[a:b])
            before, after = [x for x in words if x[0] < a][-window:], [x for x in words if x[0] >= b][:window]
            edges = " ".join(w for _, w in [*before[-4:], *after[:4]])
            for place, w in (*before, *after):
                if (kind, value, place) not in held:
                    held.add((kind, value, place))
                    near[kind, value][w] += 1
                    seen[kind, value, w].add(edges)
    every = sum(totals.values())

    def disclosure(entity, n, total):
        size = sum(near[entity].values())
        return 1 + math.log(min(1, n / total)) / math.log(every / size) if every > size else 0

    shown = {}
    for entity, own in near.items():
        for w, n in own.items():
            if len(seen[(*entity, w)]) >= contexts and disclosure(entity, n, totals[w]) >= threshold:
                begins = w[: max(1, len(w) // 2)]
                alike = disclosure(entity, sum(m for v, m in own.items() if v[: max(1, len(v) // 2)] == begins), sum(m for v, m in totals.items() if v[: max(1, len(v) // 2)] == begins))
                shown[w] = max(shown.get(w, -9), alike)
    return {w: "[removed]" if worst >= threshold else w[: max(1, len(w) // 2)] + "*" for w, worst in shown.items()}


def corpus(rng):
    common = ["the", "of", "report", "team", "zebra", "zebrafish", "blue", "blunt", "é", "2024"]
    words = lambda n: " ".join(rng.choices(common, weights=range(30, 10, -2), k=n))
    texts = [words(rng.randrange(5, 40)) for _ in range(300)]
    for n in range(12):
        texts.append(f"{words(6)} Zorblax Quux {words(3)} at {'zor' if n % 2 else 'Zor'}@mail.example.com {words(7)} Bluebird {words(rng.randrange(9))}")
        texts.append(f"{words(8)} call +1 (212) 555-0199 {words(4)} kestrel {words(5)}")
    texts += [f"{words(5)} quux {words(3)}" for _ in range(9)] + ["blueberry " + words(4) for _ in range(40)]
    return [*texts, *["one copied line with hapaxword near copy@x.example.com and more words of it"] * 30, None, "", "Zorblax alone"]


def test_terms_against_counting(spark):
    texts = corpus(random.Random(2))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for threshold, contexts, window in ((0.95, 3, 64), (0.8, 2, 5), (0.9, 1, 64), (0.5, 3, 8)):
        got = {r.term: r.shown for r in P.revealing_terms(frame, threshold, contexts, window, most=50).collect()}
        assert got == plain_terms(texts, threshold, contexts, window)


def test_what_is_found_and_replaced(spark):
    texts = corpus(random.Random(2))
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    rows = {r.doc_id: r for r in P.find_private(frame).collect()}
    assert len(rows) == len(texts)
    alone = rows[len(texts) - 1].spans
    assert [(s.kind, s.start, s.end, s.shown) for s in alone] == [("removed", 0, 7, "[removed]")]
    assert any(s.kind == "general" and s.shown == "blue*" for r in rows.values() for s in r.spans)
    for r in rows.values():
        assert [(P.KINDS.index(s.kind), s.start) for s in r.spans] == sorted((P.KINDS.index(s.kind), s.start) for s in r.spans)
    clean = {r.doc_id: r for r in P.sanitise(frame).collect()}
    assert clean[0].spans == 0 and len(clean) == len(texts)
    assert all("zorblax" not in (r.text or "").lower() and "@" not in (r.text or "") for r in clean.values())
    copied = [r.text for r in clean.values() if "copied line" in (r.text or "")]
    assert copied == ["one copied line with hapaxword near [email] and more words of it"] * 30
    assert clean[len(texts) - 3].text is None and clean[len(texts) - 2].text == ""
    untouched = [i for i, t in enumerate(texts[:300]) if clean[i].text == t]
    assert len(untouched) == 300


def test_edge_rows(spark, docs, none):
    rows = P.find_private(docs).collect()
    assert len(rows) == docs.count() and all(r.spans == [] and r.n_email == 0 for r in rows)
    assert P.find_private(none).count() == 0 and P.sanitise(none).count() == 0
    same = P.sanitise(docs)
    assert same.columns == docs.columns
    assert sorted(map(str, same.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    one = docs.where("doc_id = 5").withColumn("text", F.concat("text", F.lit(" x.y@z.example 4111-1111-1111-1111")))
    found = P.find_private(one).first()
    assert (found.n_email, found.n_card) == (1, 1)
    assert P.sanitise(one).first().text.endswith("[email] [card]")
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert dict(P.find_private(named).dtypes)["doc_id"] == "string"


def test_windows_are_whole_words():
    text = "a " * 50 + "b" * 5000 + " c d @ e " + "f" * 5000 + " g " + "h " * 50
    at = text.index("@")
    before, after = P.nearby(text, at, at + 1, 4)
    assert [w[:1] for _, w in before] == ["a", "b", "c", "d"] and [w[:1] for _, w in after] == ["e", "f", "g", "h"]
    assert len(before[1][1]) == len(after[1][1]) == 5000
