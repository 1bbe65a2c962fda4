"""Queries without SQL against brute-force versions, exact round trips and held-out accuracy."""

import base64
import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import decontamination, near_copies, packing, quality, queries, secret_scan, sharding, simhash, spotsigs, token_counts, toxicity
from corpusloom.llm.common import connected_components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def corpus(tiny):
    return pd.read_parquet(f"{tiny}/documents.parquet").set_index("doc_id")


def classes(keys, linked):
    """The smallest key of each key's component, by comparing all pairs."""
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, tiny, corpus):
    got = queries.op1_simhash(spark, tiny).toPandas().set_index("doc_id")
    prints = {i: plain_fingerprint(t) for i, t in corpus.text.items()}
    assert {i: f"{f:016x}" for i, f in prints.items()} == got.fingerprint.to_dict()
    assert classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4) == got.component_id.to_dict()


@pytest.mark.parametrize("most", [4, 1 << 13])
def test_simhash_links_in_heavy_segments(spark, most):
    """Many near values, so that every variant is heavy at the small limit; no link between components is lost."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) for b in base for _ in range(40)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(frame, 4, most)).collect()}
    want = classes(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    groups = {}
    for p in signed:
        groups.setdefault(want[p], set()).add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_long_run_gives_a_forest():
    values = np.arange(16, dtype=np.uint64).repeat(1)
    keys = np.zeros(16, dtype=np.int64)
    found = np.concatenate(list(simhash.link_runs(iter([(keys[:5], values[:5]), (keys[5:], values[5:])]), 4, small=4)))
    assert len(found) == 15


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 200), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_secrets_base_spans(spark, tiny, corpus):
    got = queries.op2_secrets(spark, tiny).toPandas().set_index("doc_id")
    kinds = {"assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "(AKIA[A-Z0-9]+)", "hex": "([0-9a-f]+)"}
    least = {"assign": 12, "access": 18, "hex": 16}
    for i, text in corpus.text.items():
        found = [(m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(kinds.items()) for m in re.finditer(p, text) if len(m[1]) >= least[kind]]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
        assert got.base_sha256[i] == hashlib.sha256(joined.encode()).hexdigest()
        assert list(got.loc[i, ["n_assign", "n_access", "n_hex"]]) == [sum(f[2] == k for f in found) for k in kinds]


def test_secret_edge_spans():
    spans = lambda t: [(secret_scan.KINDS[k], s, e) for k, s, e in secret_scan.base_spans(t)]
    assert spans("secret:token:abcdefghijklmn") == []
    assert spans("ſecret=abcdefghijklmn to\u212aen=abcdefghijklmn") == [] and len(spans("toKen=abcdefghijklmn")) == 1
    assert spans("é Api_Key' = \"abcdefABCDEF") == [("assign", 2, 26)]
    assert spans("AKIA" + "Z" * 13) == [] and spans("xAKIA" + "Z" * 14) == [("access", 1, 19)]
    assert spans("0123456789abcdefG") == [("hex", 0, 16)]


def test_battery_tells_random_from_written():
    rng = random.Random(5)
    letters = string.ascii_letters + string.digits + "+/"
    drawn = ["".join(rng.choices(letters, k=44)) for _ in range(200)]
    written = ["".join(rng.choices(["the", "tion", "ing", "er", "and", "st", "ou", "ble", "re", "en"], k=14)) for _ in range(200)]
    p = lambda t: secret_scan.written_p(*secret_scan.infer(t), t)
    assert sum(p(t) < 1e-4 for t in drawn) > 180 and sum(p(t) < 1e-2 for t in written) == 0
    assert secret_scan.infer("deadbeef0123")[0] == secret_scan.HEXADECIMAL and secret_scan.infer("GEZDGNBV")[0] == secret_scan.BASE32


WORDS = "the of and language model time people government system number report school company question history heit keit lich ung schen zusammen verbindung".split()


def written_token(rng, n):
    """Words in one of six styles: joined, CamelCase, snake_case, with dashes and numbers, paths, upper case."""
    style, token = rng.randrange(6), ""
    while len(token) < n:
        word, joint = rng.choice(WORDS), "_-/"[style - 2] if 2 <= style <= 4 and token else ""
        if style in (3, 4) and rng.random() < 0.25:
            word = str(rng.randrange(1, 2100))
        token += joint + (word.capitalize() if style == 1 else word.upper() if style == 5 else word)
    return token[:n]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_false_discoveries_among_encoded_text(seed):
    """Random tokens among written ones, encoded phrases and pod-style names: the found ones are random, at the query's rate."""
    rng = random.Random(seed)
    phrase = lambda: " ".join(rng.choices(WORDS, k=rng.randrange(3, 7))).encode()
    tail = lambda n: "".join(rng.choices("bcdfghjklmnpqrstvwxz2456789", k=n))
    drawn = ["".join(rng.choices(string.ascii_letters + string.digits, k=rng.randrange(20, 41))) for _ in range(100)]
    others = [written_token(rng, rng.randrange(20, 41)) for _ in range(3000)]
    others += [base64.b64encode(phrase()).decode() for _ in range(400)] + [base64.urlsafe_b64encode(phrase()).decode().rstrip("=") for _ in range(100)]
    others += ["-".join([rng.choice(WORDS), rng.choice(WORDS), tail(10), tail(5)]) for _ in range(400)]
    others += [base64.b32encode(phrase()).decode() for _ in range(200)] + [phrase().hex().upper() for _ in range(200)]
    cells = [[c for _, _, c in secret_scan.candidates(t, [])] for t in (*drawn, *others)]
    floor = secret_scan.thresholds(Counter(c for found in cells for c in found), 0.01)
    passed = [any(c % secret_scan.BINS >= floor.get(c // secret_scan.BINS, secret_scan.BINS) for c in found) for found in cells]
    assert sum(passed[:100]) >= 95 and sum(passed[100:]) <= 0.05 * sum(passed)


def test_bytes_of_encoded_text():
    """Binomial tails of high bits, against counting them in the decoded bytes."""
    rng = random.Random(4)
    for n in (9, 30, 300):
        raw = bytes(rng.randrange(256) for _ in range(n))
        for token, encoding in ((base64.b64encode(raw).decode(), secret_scan.BASE64), (raw.hex(), secret_scan.HEXADECIMAL)):
            codes = np.array([secret_scan.ALPHABETS[encoding].index(c) for c in token.rstrip("=")])
            high = sum(b >> 7 for b in raw)
            assert secret_scan.high_bits_p(encoding, codes) == pytest.approx(sum(math.comb(n, i) for i in range(high + 1)) / 2**n, abs=1e-12)
    assert secret_scan.kinds_p(secret_scan.ALPHANUMERIC, "a" * 40) < 1e-9 < 0.5 < secret_scan.kinds_p(secret_scan.ALPHANUMERIC, "abcdefghijklmABCDEFGHIJKLM01234")


@pytest.mark.parametrize(
    ("letters", "least"),
    [
        (string.ascii_letters + string.digits, {20: 0.93, 24: 0.95, 32: 0.95, 40: 0.95}),
        (string.ascii_letters + string.digits + "+/", {20: 0.93, 24: 0.95, 32: 0.95, 40: 0.95}),
        (string.ascii_uppercase + "234567", {20: 0.5, 24: 0.6, 32: 0.75, 40: 0.88, 64: 0.95}),
        ("0123456789ABCDEF", {20: 0.65, 24: 0.85, 32: 0.93, 40: 0.95}),
    ],
)
def test_recall_by_encoding_and_length(letters, least):
    """300 drawn among 3,000 written tokens, at the production rate; no more false ones than it allows twice over."""
    rng = random.Random(21)
    for n, recall in least.items():
        drawn = ["".join(rng.choices(letters, k=n)) for _ in range(300)]
        tokens = [*drawn, *(written_token(rng, n) for _ in range(3000))]
        cells = [c for t in tokens for _, _, c in secret_scan.candidates(t, [])]
        assert len(cells) == len(tokens)
        counts = {c: cells.count(c) for c in set(cells)}
        floor = secret_scan.thresholds(counts, 0.01)
        passed = [c % secret_scan.BINS >= floor.get(c // secret_scan.BINS, secret_scan.BINS) for c in cells]
        assert np.mean(passed[:300]) >= recall, n
        assert sum(passed[300:]) <= 6, n


def test_candidates_never_touch_base_spans():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["token=abcdefghijklmnop", " ", "Z" * 22, "0123456789abcdef", "/", "-", "QmFzZTY0IGVuY29kZWQgdGV4dA", "password: "]) for _ in range(12))
        base = secret_scan.base_spans(text)
        want = [m.span() for m in secret_scan.CANDIDATE.finditer(text) if not any(m.start() < e and s < m.end() for _, s, e in base)]
        assert [c[:2] for c in secret_scan.candidates(text, base)] == want


def test_random_tokens_are_found_under_control(spark):
    rng = random.Random(9)
    words = ["thblereanedsh" * 2, "onthtionwhonattionnd", "enkeitlichenzuversch"]
    rows = [(i, f"some text {rng.choice(words)} and more") for i in range(300)]
    secrets = {i: "".join(rng.choices(string.ascii_letters + string.digits, k=48)) for i in range(300, 310)}
    rows += [(i, f"some text {s} and more") for i, s in secrets.items()]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = {i for i, s in got.items() if s}
    assert hit <= set(secrets) and len(hit) >= 8
    assert all(got[i] == [("random", 10, 58)] for i in hit)


@pytest.mark.parametrize(("name", "label", "least"), [("op3_quality", "quality", 0.97), ("op8_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, small, name, label, least):
    got = getattr(queries, name)(spark, small).toPandas()
    modulus, rest = (3, 1) if label == "quality" else (5, 0)
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % modulus == rest for i in got.doc_id])
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out].merge(pd.read_parquet(f"{small}/labels.parquet"), on="doc_id")
    assert (held.predicted == held[label]).mean() >= least


def test_network_scores_alike():
    """The cached scorer gives what the layers give."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "bad", "worse", "fine"], size=n)) for n in rng.integers(0, 40, 60)]
    rows = [np.array([toxicity.hashed(w, 1 << 10) for w in toxicity.words(t)], dtype=np.int64).reshape(-1, 4) for t in texts]
    y = np.array(["bad" in t for t in texts], dtype=np.int64)
    net = toxicity.train(rows, [""] * 60, y, 1 << 10, epochs=2)
    scorer = toxicity.Scorer(net)
    for text, ids in zip(texts, rows, strict=True):
        assert scorer.logit(toxicity.words(text)) == pytest.approx(net.logit(net.rows[ids].sum(axis=1)) if len(ids) else net.intercept, abs=1e-4)


def test_network_gradients_are_those_of_the_loss():
    """Every gradient against a finite difference of the weighted log loss."""
    rng = np.random.default_rng(3)
    net = toxicity.Network(16, np.zeros((4, 5)), [rng.normal(0, 0.5, (w, 5, 3)) for w in (1, 2, 3)], rng.normal(0, 0.1, 18), rng.normal(0, 0.5, 18), 0.2, 3, {"": 0.0})
    for n, target, weight in ((9, 1, 1.5), (6, 0, 0.5), (2, 1, 1.0)):
        vectors = rng.normal(0, 1, (n, 5))

        def loss():
            return weight * float(np.logaddexp(0, net.logit(vectors)) - target * net.logit(vectors))  # noqa: B023

        error, by_bank, by_bias, by_output, by_place = net.gradients(vectors, target, weight)
        places = np.array([by_place.get(i, np.zeros(5)) for i in range(n)])
        for values, found in ((net.banks[0], by_bank[0]), (net.banks[1], by_bank[1]), (net.banks[2], by_bank[2]), (net.bias, by_bias), (net.output, by_output), (vectors, places)):
            for at in np.ndindex(values.shape):
                kept = values[at]
                values[at] = kept + 1e-6
                high = loss()
                values[at] = kept - 1e-6
                assert (high - loss()) / 2e-6 == pytest.approx(found[at], abs=1e-5)
                values[at] = kept
        net.intercept += 1e-6
        high = loss()
        net.intercept -= 2e-6
        assert (high - loss()) / 2e-6 == pytest.approx(error, abs=1e-5)
        net.intercept += 1e-6


def test_toxicity_sample_is_bounded_in_words(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    every = toxicity.sample(docs, labels, 6000, 6_000_000, 1 << 10, "toxic", "doc_id", "text")[0]
    some = toxicity.sample(docs, labels, 6000, 5_000, 1 << 10, "toxic", "doc_id", "text")[0]
    assert 0 < sum(map(len, some)) <= 5_000 < sum(map(len, every)) and len(every) == labels.count()


def test_quality_scores_against_a_plain_discriminant(spark, small):
    """The query's scores from class means, shrunk covariances and log densities written out over all documents."""
    got = queries.op3_quality(spark, small).toPandas().set_index("doc_id").score
    texts = pd.read_parquet(f"{small}/documents.parquet").set_index("doc_id").text
    labels = pd.read_parquet(f"{small}/labels.parquet").set_index("doc_id").quality
    labels = labels[[zlib.crc32(str(i).encode()) % 3 != 1 for i in labels.index]]
    raw = {i: np.array(quality.statistics(t.encode())) for i, t in texts.items()}
    known = np.stack([raw[i] for i in labels.index])
    shift, spread = known.mean(axis=0), np.sqrt(np.maximum(known.var(axis=0), 1e-6))
    scaled = {i: np.clip((x - shift) / spread, -6, 6) for i, x in raw.items()}
    own = [np.stack([scaled[i] for i in labels.index[labels == k]]) for k in range(2)]
    covariances = [np.cov(x, rowvar=False, bias=True) for x in own]
    pooled = sum(len(x) * c for x, c in zip(own, covariances, strict=True)) / len(labels)
    shrunk = [0.9 * (0.5 * c + 0.5 * pooled) + 0.1 * np.eye(len(pooled)) for c in covariances]

    def density(x, k):
        off = x - own[k].mean(axis=0)
        return np.log((len(own[k]) + 1) / (len(labels) + 2)) - 0.5 * np.linalg.slogdet(shrunk[k])[1] - 0.5 * off @ np.linalg.solve(shrunk[k], off)

    for i, x in scaled.items():
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(0.5 * (density(x, 1) - density(x, 0)), -700, 700))), abs=1e-6)


def test_quality_statistics_are_finite():
    for text in (None, b"", b" ", b"\n\n", b"a", b"!!!!", "é".encode(), b"x" * 3_000_000):
        assert np.isfinite(quality.statistics(text)).all() and len(quality.statistics(text)) == len(quality.NAMES)


def plain_signatures(text):
    anchors, words = set(spotsigs.ANCHORS), re.split(r"[\W_]+", text.lower())
    content = [(words[i], words[i - 1] if i else "") for i in range(len(words)) if words[i] and words[i] not in anchors]
    chains = {(content[j][1], content[j][0], content[j + 1][0]) for j in range(len(content) - 1) if content[j][1] in anchors}
    words = tuple(w for w in words if w)
    return chains or ({words} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spotsigs(spark, tiny, corpus):
    got = queries.op4_spotsigs(spark, tiny).toPandas().set_index("doc_id")
    ids = sorted(corpus.index, reverse=True)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        text, after = corpus.text[i], corpus.text[j]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got.n_chars[i] == len(text) and got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest()
        assert got.near_edited[i] == pytest.approx(jaccard(plain_signatures(text), plain_signatures(edited)))
        assert got.near_next[i] == pytest.approx(jaccard(plain_signatures(text), plain_signatures(after)))
        assert len(got.fingerprint[i]) == 8 * len(plain_signatures(text))
    assert got.groupby(corpus.text).fingerprint.nunique().max() == 1


@pytest.mark.parametrize("most", [2, 1 << 12])
def test_similar_documents(spark, tiny, corpus, most):
    """The classes of all pairs, with index entries in one block or in many."""
    got = {r.doc_id: r.component for r in spotsigs.similar_documents(spark.read.parquet(f"{tiny}/documents.parquet"), most=most).collect()}
    sets = {i: plain_signatures(t) for i, t in corpus.text.items()}
    assert got == classes(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize(("most", "small"), [(300, 4), (300, 20), (1 << 20, 1 << 12)])
def test_near_duplicate_stage(spark, most, small):
    """The pipeline's stage keeps what all pairs at five-word Jaccard 0.8 leave, in one block or many, in short runs or long."""
    import corpus_pipeline

    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, rows = [word() for _ in range(40)], [(900, None), (901, " \n"), (902, "two words"), (903, "TWO  words"), (904, "two other")]
    for size in (6, 20, 40, 90, 200, 200):
        base = [word() for _ in range(size)]
        for _ in range(25):
            copy = base[:]
            for _ in range(rng.randrange(1 + size // 12)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy[: len(copy) - rng.randrange(1 + size // 8)])))
    rows += [(len(rows) + n, " ".join([word() for _ in range(rng.randrange(60))] + passage)) for n in range(60)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: plain_shingles(t) for i, t in rows}
    want = classes(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    assert {r.doc_id: r.component for r in near_copies.near_duplicates(frame, most=most, small=small).collect()} == want
    assert len(set(want.values())) < len(want) - 60
    if most > 300:
        kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()}
        assert kept == {i for i, c in want.items() if i == c}


def test_sketches_estimate_jaccard():
    """Sketches of sets at the threshold stay under the bound; bits differ as often as the Jaccard says."""
    rng = np.random.default_rng(2)
    bound = near_copies.most_differ(Fraction(4, 5))
    assert 30 <= bound <= 40
    for n in (9, 90, 900):
        differ = []
        for _ in range(300):
            both, rest = np.split(rng.integers(0, 1 << 63, n + n // 8 * 2, dtype=np.uint64), [n])
            one, two = (np.unique(np.r_[both, part]) for part in np.split(rest, 2))
            differ.append(int(np.bitwise_count((near_copies.sketch(one) ^ near_copies.sketch(two)).view(np.uint64)).sum()))
        assert max(differ) <= bound and abs(np.mean(differ) / 128 - (1 - n / (n + n // 8 * 2)) / 2) < 0.01
    far = [int(np.bitwise_count((near_copies.sketch(rng.integers(0, 1 << 63, 50, dtype=np.uint64)) ^ near_copies.sketch(rng.integers(0, 1 << 63, 50, dtype=np.uint64))).view(np.uint64)).sum()) for _ in range(300)]
    assert min(far) > bound
    assert (near_copies.sketch(np.arange(1, 90_000, dtype=np.uint64)) == near_copies.sketch(np.arange(1, 90_000, dtype=np.uint64), block=1000)).all()


def test_decontamination_in_blocks(spark, tiny):
    """Many small automata give what one gives, and the spans are cut."""
    docs, items = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    one = {r.doc_id: (r.n_hit, tuple(r["items"])) for r in decontamination.contamination(docs, items).collect()}
    many = {r.doc_id: (r.n_hit, tuple(r["items"])) for r in decontamination.contamination(docs, items.limit(12), most_words=60).collect()}
    few = {r.doc_id: (r.n_hit, tuple(r["items"])) for r in decontamination.contamination(docs, items.limit(12)).collect()}
    assert many == few and any(n for n, _ in one.values())
    cut = [{tuple(r) for r in decontamination.decontaminate(docs, items.limit(12), most_words=w).collect()} for w in (60, 100_000)]
    assert cut[0] == cut[1]
    clean = decontamination.contamination(decontamination.decontaminate(docs, items), items).agg(F.max("n_hit")).first()[0]
    assert clean < 10


def test_automaton_against_all_windows():
    rng = random.Random(2)
    for _ in range(60):
        items = {str(n): [rng.choice("abc").encode() for _ in range(rng.randrange(1, 12))] for n in range(4)}
        automaton = decontamination.SuffixAutomaton(4)
        for name, own in items.items():
            automaton.add(name, own)
        automaton.finish()
        text = [rng.choice("abcd").encode() for _ in range(40)]
        hits, found = np.zeros(40, dtype=bool), set()
        automaton.feed(np.array([automaton.vocabulary.get(w, -1) for w in text]), hits, found)
        want, held = np.zeros(40, dtype=bool), set()
        for name, own in items.items():
            size = min(4, len(own))
            windows = [own[s : s + size] for s in range(len(own) - size + 1)]
            for at in range(40 - size + 1):
                if text[at : at + size] in windows:
                    want[at : at + size] = True
                    held.add(name)
        assert (hits == want).all() and found == held


#: Texts that hold a special token's string, whole, broken and repeated.
SPECIAL = {-1: "a <|endoftext|> b", -2: "<|endoftext|><|endoftext|>", -3: "<|endoftext|", -4: "x  <|endoftext|>\n\n é<|endoftext|>", -5: "line one <|endo\nftext|> <|endoftext|>\n"}


def test_packing_round_trip(spark, tiny, corpus):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    rows = packing.pack(docs.union(spark.createDataFrame(list(SPECIAL.items()), docs.schema)), TOKENIZER).toPandas()
    exact = Tokenizer.from_file(TOKENIZER)
    assert 50256 in exact.encode(SPECIAL[-1], add_special_tokens=False).ids
    for i, own in rows.sort_values("start").groupby("doc_id"):
        ids = [*exact.encode(SPECIAL.get(i) or corpus.text[i], add_special_tokens=False).ids, 1]
        assert [x for p in own.ids for x in p] == ids and set(own.doc_tokens) == {len(ids)}
        assert list(own.start) == [0, *np.cumsum(own.length)[:-1]]
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in rows.itertuples())
    sizes = rows.sort_values("offset").groupby("sequence_id").length
    assert all(list(own.offset) == [0, *np.cumsum(own.length)[:-1]] for _, own in rows.sort_values("offset").groupby("sequence_id"))
    totals = sizes.sum()
    padded = totals[[(t & (t - 1)) != 0 for t in totals]]
    assert totals.max() <= 2048 and (2048 - padded).sum() <= 0.01 * totals.sum()
    assert set(rows.doc_id) == set(corpus.index) | set(SPECIAL)


def test_special_tokens_as_text(spark):
    rows = packing.pack(spark.createDataFrame(list(SPECIAL.items()), "doc_id long, text string"), TOKENIZER, special_as_text=True).toPandas()
    exact = Tokenizer.from_file(TOKENIZER)
    exact.encode_special_tokens = True
    for i, own in rows.sort_values("start").groupby("doc_id"):
        assert [x for p in own.ids for x in p] == [*exact.encode(SPECIAL[i], add_special_tokens=False).ids, 1]


@pytest.mark.parametrize(("count", "most", "padding"), [(0, 9, 0.01), (1, 300, 0.01), (7, 2048, 0.01), (400, 2500, 0.01), (400, 2500, 0.0), (300, 30_000, 0.01), (300, 700, 1.0)])
def test_groups_are_packed_whole(count, most, padding):
    """Each token in one place, no sequence too long, padding within its bound."""
    rng = random.Random(count + most)
    sizes = [rng.randrange(1, most) for _ in range(count)]
    sequences = packing.pack_group(sizes, 2048, most_padding=padding)
    held = sorted(p for s in sequences for p in s)
    ends = {i: 0 for i in range(count)}
    for i, start, length in held:
        assert start == ends[i] and length > 0
        ends[i] += length
    assert ends == dict(enumerate(sizes))
    totals = [sum(p[2] for p in s) for s in sequences]
    assert all(0 < t <= 2048 for t in totals)
    assert sum(2048 - t for t in totals if t & (t - 1)) <= padding * sum(sizes)


def test_differencing_makes_the_windows(monkeypatch):
    """Dealing the documents out in turn, largest first, instead of differencing cuts far more of them."""
    rng = random.Random(12)
    sizes = [int(rng.lognormvariate(6.6, 0.9)) + 1 for _ in range(500)]
    windows = lambda: packing.pack_group(sizes, 2048)
    cut = lambda found: sum(map(len, found)) - sum(-(-s // 2048) for s in sizes)
    by_differencing = cut(windows())

    def in_turn(sizes, count):
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
        return [order[n::count] for n in range(count)]

    monkeypatch.setattr(packing, "difference", in_turn)
    assert by_differencing < 0.5 * cut(windows())


def test_differencing_balances():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 2000) for _ in range(300)]
    windows = packing.near_equal(sizes, 2048)
    assert sorted(i for w in windows for i in w) == list(range(300))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) <= 2048 and len(windows) <= 1.1 * sum(sizes) / 2048 + 1
    plain = packing.difference(sizes, 100)
    spread = [sum(sizes[i] for i in w) for w in plain]
    assert max(spread) - min(spread) < 0.25 * sum(sizes) / 100
    with pytest.raises(ValueError):
        packing.pack_group([5000], 2048, cut=False)
    assert packing.pack_group([], 2048) == [] and packing.near_equal([], 2048) == [[]]


def test_encoder_pieces_join():
    encoder = packing.Encoder(TOKENIZER)
    text = "It's  odd \n\n text, 12 words – ñandú 🙂!! " * 400
    assert encoder.quick is not None
    assert encoder.ids(text, piece=97).tolist() == encoder.exact.encode(text, add_special_tokens=False).ids


def test_shards_split_only_where_needed(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    limit = 40_000
    rows = sharding.shards(docs, limit).toPandas()
    assert len(rows) == docs.count() and rows.shard_bytes.max() <= limit
    sizes = rows.groupby("shard").shard_bytes.first()
    for shard, size in sizes.items():
        parent = sizes[[s.startswith(shard[:-1]) for s in sizes.index]].sum()
        assert not shard or parent > limit
    assert rows.groupby("shard").shard_bytes.nunique().max() == 1 and (rows.local_depth == rows.shard.str.len()).all()


def test_token_counts_by_majority(spark, tiny, corpus):
    """The query's own rule on every text: each token, by its bytes, to the line that has most of its characters."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    frame = token_counts.count_tokens(docs.union(spark.createDataFrame(list(SPECIAL.items()), docs.schema)), TOKENIZER).toPandas()
    exact = Tokenizer.from_file(TOKENIZER)
    sizes = {i: len(t.encode()) if t.startswith("<|") else len(t) for t, i in exact.get_vocab().items()}
    for i, own in frame.groupby("doc_id"):
        text = SPECIAL.get(i) or corpus.text[i]
        char_of = [n for n, c in enumerate(text) for _ in c.encode()]
        line_of = np.cumsum([0, *(c == "\n" for c in text)])
        counts, crossing, at = Counter(), Counter(), 0
        for number in exact.encode(text, add_special_tokens=False).ids:
            chars = range(char_of[at], char_of[at + sizes[number] - 1] + 1)
            at += sizes[number]
            tally = Counter(int(line_of[c]) for c in chars)
            line = min(tally, key=lambda x: (-tally[x], x))
            counts[line] += 1
            crossing[line] += len(tally) > 1
        assert at == len(text.encode())
        assert {r.section: (r.n_tokens, r.n_crossing) for r in own.itertuples()} == {n: (counts[n], crossing[n]) for n in range(len(own))}


def test_token_counts_against_offsets(spark, tiny, corpus):
    rows = token_counts.count_tokens(spark.read.parquet(f"{tiny}/documents.parquet"), TOKENIZER, rule="start").toPandas()
    exact = Tokenizer.from_file(TOKENIZER)
    for i, own in rows.groupby("doc_id"):
        text = corpus.text[i]
        assert own.n_tokens.sum() == own.doc_tokens.iloc[0] == len(exact.encode(text, add_special_tokens=False).ids)
        assert [(int(a), int(b)) for a, b in zip(own.start, own.end, strict=True)] == [(m.start(), m.end()) for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
        if text.isascii():
            # the pre-tokenizer trims offsets; a token's bytes are its length
            places = np.cumsum([0, *(len(exact.decode([t])) for t in exact.encode(text, add_special_tokens=False).ids)])[:-1]
            assert list(own.n_tokens) == [int(((places >= a) & (places < b)).sum()) for a, b in zip(own.start, own.end, strict=True)]


@pytest.mark.parametrize(("rule", "want"), [("start", [0, 0, 1]), ("end", [0, 1, 1]), ("majority", [0, 1, 1])])
def test_boundary_rules(rule, want):
    starts, ends = np.array([0, 3, 7]), np.array([3, 7, 8])
    section, crossing = token_counts.attribute(starts, ends, np.array([0, 4]), np.array([4, 8]), rule)
    assert section.tolist() == want and crossing.tolist() == [False, True, False]
    assert token_counts.attribute(starts, ends, np.array([0, 5]), np.array([5, 8]), "majority")[0].tolist() == [0, 0, 1]


def test_pipeline_decisions(spark, small):
    """Each stage against what its operator's definition asks of the rows that came in."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    start = docs.count()
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        out[name] = docs.toPandas()
        docs = spark.createDataFrame(out[name], docs.schema)
    labels = pd.read_parquet(f"{small}/labels.parquet").set_index("doc_id").quality
    kept = labels[labels.index.isin(out["quality"].doc_id)]
    assert (kept == 1).mean() > 0.98 and len(kept) >= 0.97 * (labels == 1).sum() and len(out["quality"]) < start
    seen = {}
    for r in out["line_dedup"].sort_values("doc_id").itertuples():
        for line in r.text.split("\n"):
            key = line.strip(" \t\n\v\f\r").translate(LOWER)
            assert len(key) < 10 or seen.setdefault(key, r.doc_id) == r.doc_id
    prints = [plain_fingerprint(t) for t in out["near_dedup"].text]
    assert len(set(prints)) == len(prints) and len(prints) < len(out["line_dedup"])
    assert set(out["decontamination"].doc_id) <= set(out["near_dedup"].doc_id)
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    assert decontamination.contamination(docs, items).agg(F.max("n_hit")).first()[0] < 10
