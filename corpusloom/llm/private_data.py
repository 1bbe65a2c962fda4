"""Personal data: fixed patterns, and terms that give the found entities away.

The patterns' matches are the entities to protect. How strongly a term reveals an entity is estimated from where
both stand in the corpus: of all words near any mention of the entity, and of all occurrences of the term. A
term's disclosure is the pointwise mutual information of the two, as a share of the entity's information
content: 1 if the term occurs near that entity only, 0 if they are independent. Terms of too high a disclosure
are generalised to the terms that begin alike, if those together disclose less, and removed otherwise.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import stored
from .common import checkpoint, key_type, row_slices, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "general", "removed")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits can't match from its middle if it didn't from its start.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of words, A-Z in lower case; all others part words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
GATHERED = pa.schema([("entity", pa.binary()), ("context", pa.int64()), ("term", pa.string()), ("n", pa.int64())])
SPAN = "struct<kind:int,start:long,end:long>"
SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
TERM_SPANS = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
#: Bits of the bitmap of revealing terms, at most (16 MiB).
MOST_BITS = 27


# ---- patterns ----


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + doubled) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ on: its domain is what can fail, and the local part reaches back to where it began."""
    found, reach, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > reach and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                reach = m.end()
                found.append((start, reach))
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns by kind, then start; linear in the text."""
    found = [(0, *x) for x in emails(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return found


def entity_of(kind: int, value: str) -> bytes:
    """What stands for an entity: 128 bits of its kind and its value without spelling."""
    plain = value.translate(LOWER) if kind == 0 else value if kind == 1 else only_digits(value)
    return xxhash.xxh3_128_digest(f"{kind}:{plain}".encode("utf-8", "replace"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with blanks for what the spans cover."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda x: x[1]):
        start = max(start, at)
        if end > start:
            out += [text[at:start], " " * (end - start)]
            at = end
    return "".join([*out, text[at:]])


def nearby(text: str, start: int, end: int, window: int) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(place, word) of the ``window`` words before a span and after it. Slices grow until they hold so many whole words."""
    size = 12 * window + 12
    while True:
        low = max(0, start - size)
        before = [(low + m.start(), m[0]) for m in WORD.finditer(text[low:start])]
        if low and before and before[0][0] == low:
            before = before[1:]
        if not low or len(before) >= window:
            break
        size *= 2
    size = 12 * window + 12
    while True:
        high = min(len(text), end + size)
        after = [(end + m.start(), m[0]) for m in WORD.finditer(text[end:high])]
        if high < len(text) and after and after[-1][0] + len(after[-1][1]) == high:
            after = after[:-1]
        if high == len(text) or len(after) >= window:
            return before[-window:] if window else [], after[:window]
        size *= 2


def near_entities(text: str, spans: list[tuple[int, int, int]], window: int, edge: int = 4) -> Iterator[tuple[bytes, int, str]]:
    """(entity, context, term) for every word near an entity, once an entity and place; ``text`` is masked by then.

    A context is a mention's ``edge`` nearest words on either side: copies of a passage have one context.
    """
    seen: dict[bytes, set[int]] = {}
    for kind, start, end, value in spans:
        entity = entity_of(kind, value)
        before, after = nearby(text, start, end, window)
        edges = " ".join(w.translate(LOWER) for _, w in [*before[-edge:], *after[:edge]])
        context = xxhash.xxh64_intdigest(edges.encode("utf-8", "replace"), 42) - (1 << 63)
        own = seen.setdefault(entity, set())
        for place, word in (*before, *after):
            if place not in own:
                own.add(place)
                yield entity, context, word.translate(LOWER)


def words_of(text: str, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """A text's words in lower case, about ``most`` bytes of text at a time."""
    plain, at = text.encode("utf-8", "replace").translate(WORD_BYTES), 0
    while at < len(plain):
        cut = plain.find(b" ", at + most)
        cut = len(plain) if cut < 0 else cut
        yield plain[at:cut].split()
        at = cut


# ---- what the corpus tells ----


def _gather(window: int, most: int):
    """Texts to sums: of each term (no entity), and of each term near an entity in one context."""

    def flush(terms: Counter, near: Counter) -> Iterator[pa.RecordBatch]:
        for keys, counts in ((list(terms), terms), (list(near), near)):
            for at in range(0, len(keys), 1 << 16):
                own = keys[at : at + (1 << 16)]
                n = pa.array([counts[k] for k in own], pa.int64())
                if counts is terms:
                    columns = [pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.int64()), pa.array(own, pa.binary()).cast(pa.string()), n]
                else:
                    columns = [*(pa.array(c, t) for c, t in zip(zip(*own, strict=True), GATHERED.types, strict=False)), n]
                yield pa.RecordBatch.from_arrays(columns, schema=GATHERED)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, near = Counter(), Counter()
        for whole in batches:
            for batch in row_slices(whole, 0):
                for value in texts(batch.column(0)):
                    text = value.decode("utf-8", "replace")
                    if spans := base_spans(text):
                        valued = [(*s, text[s[1] : s[2]]) for s in spans]
                        text = masked(text, spans)
                        near.update(near_entities(text, valued, window))
                    for words in words_of(text):
                        terms.update(words)
                    if len(terms) + len(near) > most:
                        yield from flush(terms, near)
                        terms.clear()
                        near.clear()
        yield from flush(terms, near)

    return scan


def _plain(docs: DataFrame, text: str):
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def beginning(term):
    """What a term is generalised to: the terms that share its first half, rounded down, of one letter at least."""
    return F.substring(term, F.lit(1), F.greatest(F.floor(F.char_length(term) / 2), F.lit(1)).cast("int"))


def _disclosure(near, total, size, words: float):
    """PMI over information content: 1 + ln p(entity | term) / -ln p(entity); 0 for an entity that is near every word."""
    content = F.log(F.lit(words) / size)
    return F.when(content > 0, 1 + F.log(F.least(near / total, F.lit(1.0))) / content).otherwise(0.0)


def revealing_terms(docs: DataFrame, threshold: float = 0.95, contexts: int = 3, window: int = 64, text: str = "text", most: int = 1 << 18) -> DataFrame:
    """``term, kind, shown``: terms that disclose an entity by ``threshold`` or more, near it in ``contexts`` or more contexts.

    ``kind`` is 4 (generalised, ``shown`` its beginning with a star) where the terms of that beginning together stay
    under the threshold for every entity that the term reveals, else 5 (removed). Near means within ``window`` words
    of a mention, so what a mention gives has a bound, and no document's entities meet all its terms. Sums leave a
    task, not occurrences; one number comes to the driver.
    """
    gathered = stored(docs.select(_plain(docs, text).alias("text")).mapInArrow(_gather(window, most), "entity binary, context long, term string, n long"), "private-sums")
    totals = stored(gathered.where("entity is null").groupBy("term").agg(F.sum("n").alias("total")), "private-totals")
    near = gathered.where("entity is not null").groupBy("entity", "term", "context").agg(F.sum("n").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("near"), F.count("*").alias("contexts"))
    near = stored(near, "private-near")
    words = float(totals.agg(F.sum("total")).first()[0] or 0)
    sizes = near.groupBy("entity").agg(F.sum("near").alias("size"))
    known = near.where(F.col("contexts") >= contexts).join(totals, "term").join(sizes, "entity")
    strong = checkpoint(known.where(_disclosure(F.col("near"), F.col("total"), F.col("size"), words) >= threshold).select("entity", "term", "size", beginning(F.col("term")).alias("begins")))
    classes = strong.select("entity", "begins").distinct()
    class_totals = totals.withColumn("begins", beginning(F.col("term"))).join(classes.select("begins").distinct(), "begins").groupBy("begins").agg(F.sum("total").alias("class_total"))
    class_near = near.withColumn("begins", beginning(F.col("term"))).join(classes, ["entity", "begins"]).groupBy("entity", "begins").agg(F.sum("near").alias("class_near"))
    judged = strong.join(class_near, ["entity", "begins"]).join(class_totals, "begins")
    worst = judged.groupBy("term", "begins").agg(F.max(_disclosure(F.col("class_near"), F.col("class_total"), F.col("size"), words)).alias("worst"))
    removed = F.col("worst") >= threshold
    return checkpoint(worst.select("term", F.when(removed, 5).otherwise(4).alias("kind"), F.when(removed, "[removed]").otherwise(F.concat("begins", F.lit("*"))).alias("shown")))


# ---- spans ----


def term_bitmap(terms: DataFrame) -> np.ndarray:
    """Bits of the terms' hashes, 64 or more for each of them up to ``MOST_BITS``, so its size has a bound. It only turns
    words away; what passes is joined with the terms."""
    bits = min(MOST_BITS, max(16, (64 * terms.count()).bit_length()))
    slot = F.pmod(F.xxhash64("term"), F.lit(1 << bits))
    rows = terms.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(term), {1 << bits}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _spans(shared, kind: pa.DataType):
    schema = pa.schema([("key", kind), ("digest", pa.string()), *((f"n_{k}", pa.int64()) for k in BASE), ("base", SPANS), ("words", TERM_SPANS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        mask, any_term = len(bitmap) * 64 - 1, bool(bitmap.any())

        def may_be(word: bytes) -> bool:
            slot = xxhash.xxh64_intdigest(word, 42) & mask
            return bool(int(bitmap[slot >> 6]) >> (slot & 63) & 1)

        known: dict[bytes, bool] = {}
        for whole in batches:
            for batch in row_slices(whole, 2):
                rows = []
                for value in texts(batch.column(2)):
                    text = value.decode("utf-8", "replace")
                    base, words = base_spans(text), []
                    if any_term:
                        left = masked(text, base) if base else text
                        some = set()
                        for piece in words_of(left):
                            for word in set(piece):
                                if word not in known:
                                    if len(known) > 1 << 18:
                                        known.clear()
                                    known[word] = may_be(word)
                                if known[word]:
                                    some.add(word.decode("utf-8", "replace"))
                        if some:
                            words = [{"term": w, "start": m.start(), "end": m.end()} for m in WORD.finditer(left) if (w := m[0].translate(LOWER)) in some]
                    counts = Counter(k for k, _, _ in base)
                    rows.append((*(counts[k] for k in range(4)), [dict(zip(("kind", "start", "end"), x, strict=True)) for x in base], words))
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[2:], strict=True))], schema=schema)

    return scan


def _found(docs: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(term_bitmap(terms))
    kind, arrow = key_type(docs, key)
    schema = f"key {kind}, digest string, {', '.join(f'n_{k} long' for k in BASE)}, base array<{SPAN}>, words array<struct<term:string,start:long,end:long>>"
    plain = _plain(docs, text)
    seen = docs.select(F.col(key).alias("key"), F.md5(plain.cast("binary")).alias("digest"), plain.alias("text")).mapInArrow(_spans(shared, arrow), schema)
    rows = stored(seen.withColumn("place", F.monotonically_increasing_id()), "private-spans")
    words = rows.where(F.size("words") > 0).select("place", F.explode("words").alias("w")).select("place", "w.*")
    more = words.join(terms, "term").groupBy("place").agg(F.collect_list(F.struct("kind", "start", "end", "shown")).alias("more"))
    own = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit("["), F.array(*map(F.lit, BASE))[x["kind"]], F.lit("]")).alias("shown")))
    every = F.array_sort(F.when(F.col("more").isNull(), own).otherwise(F.concat(own, "more")))
    named = F.transform(every, lambda x: F.struct(F.array(*map(F.lit, KINDS))[x["kind"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["shown"].alias("shown")))
    return rows.join(more, "place", "left").select(F.col("key").alias(key), "digest", *(f"n_{k}" for k in BASE), named.alias("spans"))


def find_private(docs: DataFrame, threshold: float = 0.95, contexts: int = 3, window: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, spans``: one row for each row of ``docs``.

    ``spans`` (array of kind, start, end in code points, the end exclusive, and the text to show instead), by kind in
    the order of ``KINDS``, then start: the patterns' matches, and as kinds ``general`` and ``removed`` every
    occurrence of a revealing term outside them (see ``revealing_terms``), near an entity or not.

    Null texts are empty and have no spans; keys may repeat or be null; an empty table gives no rows. Very long texts
    are looked through whole, their words counted in pieces. Repeated rows count as often as they occur, but their
    contexts once.
    """
    return _found(docs, revealing_terms(docs, threshold, contexts, window, text), key, text).drop("digest")


def sanitise(docs: DataFrame, threshold: float = 0.95, contexts: int = 3, window: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what ``find_private`` finds replaced in ``text``; null texts stay null, other columns as they are.

    Spans follow from the text, so they are joined by its digest, each different text once. Of overlapping spans the
    first gives what is shown.
    """
    found = _found(docs, revealing_terms(docs, threshold, contexts, window, text), key, text)
    spans = found.where(F.size("spans") > 0).select("digest", "spans").dropDuplicates(["digest"])
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col(text).cast("string").alias("text"), F.md5(_plain(docs, text).cast("binary")).alias("digest"))
    joined = rows.join(spans, "digest", "left").select("rest", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, 1):
                found = [value if value is None or not spans else replaced(value.decode("utf-8", "replace"), spans).encode() for value, spans in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()).cast(pa.string())], names=["rest", "text"])

    done = joined.mapInArrow(cut, f"rest {joined.schema['rest'].dataType.simpleString()}, text string")
    return done.select(*[F.col("text").alias(text) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def replaced(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], s["shown"]]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])
