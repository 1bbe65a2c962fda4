"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is over words. A document streams through it; at every word the length of the longest match that
ends there is known, and a match of the window's length or more marks its words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import union_all
from .common import checkpoint, key_type, row_slices, send, texts

#: A-Z to a-z; what parts words to a blank.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPAN = re.compile(rb"[^ ]+")


@dataclass
class SuffixAutomaton:
    """Suffix automaton of many word sequences; ``feed`` gives hits and the items that hold them."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: dict[int, set[str]] = field(default_factory=dict)
    whole: dict[int, list[tuple[int, str]]] = field(default_factory=dict)
    sequences: list[tuple[str, list[int]]] = field(default_factory=list)
    shortest: int = 0

    def add(self, item: str, words: list[bytes]) -> None:
        sequence = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        last = 0
        for word in sequence:
            last = self._extend(last, word)
        self.sequences.append((item, sequence))

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """``q`` itself where it is one word longer than ``p``, else a copy of it that is."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.step[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, self.step[last][word], word)
        new, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.step[p][word], word)
        return new

    def finish(self) -> SuffixAutomaton:
        """Settle which items hold the windows of each state."""
        size = len(self.step)
        self.cut, self.hop = [-1] * size, [-1] * size
        order = sorted(range(1, size), key=self.length.__getitem__)
        for state in order:
            up = self.link[state]
            if self.length[state] >= self.window:
                self.cut[state] = state if self.length[up] < self.window else self.cut[up]
        for item, sequence in self.sequences:
            state = 0
            for n, word in enumerate(sequence, 1):
                state = self.step[state][word]
                if n >= self.window:
                    self.items.setdefault(self.cut[state], set()).add(item)
            if 0 < len(sequence) < self.window:
                self.whole.setdefault(state, []).append((len(sequence), item))
        for state in order:
            self.hop[state] = state if state in self.whole else self.hop[self.link[state]]
        self.shortest = min([self.window, *(n for found in self.whole.values() for n, _ in found)])
        self.sequences = []
        return self

    def feed(self, ids: np.ndarray, hits: np.ndarray, found: set[str]) -> None:
        """Mark in ``hits`` the words that lie in an occurrence of a window; -1 is a word no item has."""
        known = np.r_[False, ids >= 0, False]
        edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
        for start, end in edges[edges[:, 1] - edges[:, 0] >= self.shortest].tolist():
            state = matched = 0
            covered = start
            for at, word in enumerate(ids[start:end].tolist(), start + 1):
                while state and word not in self.step[state]:
                    state = self.link[state]
                    matched = self.length[state]
                state = self.step[state].get(word, 0)
                matched = matched + 1 if state else 0
                if matched >= self.window:
                    hits[max(covered, at - matched) : at] = True
                    covered = at
                    found |= self.items[self.cut[state]]
                up = self.hop[state] if matched else -1
                while up > 0:
                    for length, item in self.whole[up]:
                        if length <= matched:
                            hits[at - length : at] = True
                            found.add(item)
                    up = self.hop[self.link[up]]


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


def automata(items: DataFrame, window: int, most_words: int, item: str, text: str) -> Iterator[SuffixAutomaton]:
    """Automata over blocks of at most ``most_words`` words of items (a window at least), one at a time.

    Only one block is held on the driver, and its size bounds what is broadcast. A longer item is cut into pieces that
    share a window less a word, so that each of its windows lies in one of them.
    """
    most_words = max(most_words, window)
    rows = items.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("item is not null and text is not null")
    block, size = SuffixAutomaton(window), 0
    for row in rows.toLocalIterator():
        found = words(row.text.encode())
        for start in range(0, max(1, len(found) - window + 1), most_words - window + 1):
            piece = found[start : start + most_words]
            if size and size + len(piece) > most_words:
                yield block.finish()
                block, size = SuffixAutomaton(window), 0
            block.add(row.item, piece)
            size += len(piece)
    yield block.finish()


def _spans(text: bytes, hits: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans from the first to the last word of each run of hit words."""
    places = [m.span() for m in SPAN.finditer(text.translate(WORDS))]
    known = np.r_[False, hits, False]
    edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
    return [(places[a][0], places[b - 1][1]) for a, b in edges.tolist()]


def _fed(automaton: SuffixAutomaton, batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, set[str]]]:
    """Each text of a batch, its hit words, and the items that hold them."""
    look = automaton.vocabulary.get
    for text in texts(batch.column("text")):
        found = words(text)
        ids = np.fromiter((look(w, -1) for w in found), dtype=np.int64, count=len(found))
        hits, held = np.zeros(len(ids), dtype=bool), set()
        automaton.feed(ids, hits, held)
        yield text, hits, held


def _settled(rows: DataFrame, task: Callable[[], Callable[[pa.RecordBatch], Iterator[tuple[bytes, np.ndarray, set[str]]]]], cut: bool) -> DataFrame:
    """``rest, items, n_words, n_hit, spans`` of rows (``rest, text, ...``), and with ``cut`` the text without the spans.
    ``task`` gives a task what tells the hits of its batches."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fed = task()
        for whole in batches:
            for batch in row_slices(whole, "text"):
                columns: list[list] = [[], [], [], [], []]
                for text, hits, held in fed(batch):
                    spans = _spans(text, hits) if hits.any() else []
                    if cut and spans:
                        edges = [0, *(x for span in spans for x in span), len(text)]
                        text = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    for column, value in zip(columns, (text if cut else None, sorted(held), len(hits), int(hits.sum()), [{"start": a, "end": b} for a, b in spans]), strict=True):
                        column.append(value)
                out = {"rest": batch.column("rest")} | ({"text": pa.array(columns[0], type=pa.binary()).cast(pa.string())} if cut else {})
                out |= {"items": pa.array(columns[1], pa.list_(pa.string())), "n_words": pa.array(columns[2], pa.int64()), "n_hit": pa.array(columns[3], pa.int64()), "spans": pa.array(columns[4], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
                yield pa.RecordBatch.from_pydict(out)

    rest = f"rest {rows.schema['rest'].dataType.simpleString()}"
    return rows.mapInArrow(scan, f"{rest}, {'text string, ' if cut else ''}items array<string>, n_words long, n_hit long, spans array<struct<start:long,end:long>>")


def _hits(rows: DataFrame, take: Callable[[], SuffixAutomaton]) -> DataFrame:
    """``key, row, hits`` (packed bits) ``, items`` of the rows that one automaton hits; texts stay where they are."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = take()
        for whole in batches:
            for batch in row_slices(whole, "text"):
                at, bits, items = [], [], []
                for n, (_, hits, held) in enumerate(_fed(automaton, batch)):
                    if held:
                        at.append(n)
                        bits.append(np.packbits(hits).tobytes())
                        items.append(sorted(held))
                if at:
                    kept = batch.select(["key", "row"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["key", "row", "hits", "items"])

    return rows.mapInArrow(scan, f"key {key_type(rows, 'key')[0]}, row long, hits binary, items array<string>")


def _joined(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, set[str]]]:
    """As ``_fed``, from what the passes found of each text."""
    for text, bits, items in zip(texts(batch.column("text")), batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True):
        hits = np.zeros(len(words(text)), dtype=bool)
        for own in bits or ():
            hits |= np.unpackbits(np.frombuffer(own, dtype=np.uint8), count=len(hits)).astype(bool)
        yield text, hits, {x for own in items or () for x in own}


def _scan(docs: DataFrame, items: DataFrame, window: int, most_words: int, cut: bool, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """One automaton: one pass, no shuffle. Several: a pass each over the source, which gives hit bits of the few rows that
    it hits and no text; these then meet the rows once."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("rest")
    rows = docs.select(rest, F.col(text).cast("string").alias("text"))
    blocks = automata(items, window, most_words, item, item_text)
    block, after, found = next(blocks), next(blocks, None), []
    if after is None:
        take = send(docs.sparkSession, block)[1]

        def task() -> Callable:
            automaton = take()
            return lambda batch: _fed(automaton, batch)

        return _settled(rows, task, cut)
    keyed = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("row"), F.col(text).cast("string").alias("text"))
    while block is not None:
        shared, take = send(docs.sparkSession, block)
        # rows that repeat a key and text have the same hits
        once = _hits(keyed, take).groupBy("key", "row").agg(F.first("hits").alias("hits"), F.first("items").alias("items"))
        found.append(checkpoint(once))
        shared.destroy()
        block, after = after, next(blocks, None)
    gathered = union_all(found).groupBy("key", "row").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))
    gathered = gathered.select(F.col("key").alias("k"), F.col("row").alias("r"), "hits", "items").hint("shuffle_hash")
    whole = docs.select(rest, F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("row"), F.col(text).cast("string").alias("text"))
    joined = whole.join(gathered, F.col("key").eqNullSafe(F.col("k")) & (F.col("row") == F.col("r")), "left").select("rest", "text", "hits", "items")
    return _settled(joined, lambda: _joined, cut)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, most_words: int = 100_000, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, n_words, n_hit, items, spans`` for every row of ``docs``.

    Words are runs of digits, letters and non-ASCII, A-Z lower-cased. A window is ``window`` consecutive words
    of an item, or the whole of a shorter one; words in any occurrence are hit. ``items`` are the ids, as
    strings in order, of the items with occurring windows; ``spans`` are UTF-8 byte spans of hit runs. Null
    texts have no words; items with a null id or text, or without words, match nothing; repeated items count
    once; an empty benchmark hits nothing. A benchmark of more than ``most_words`` words is cut into blocks,
    each with its own automaton and pass, and the passes' hits are joined. Very long texts are read whole; an empty
    table gives no rows.
    """
    state = _scan(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), items, window, most_words, False, "key", "text", item, item_text)
    return state.select(F.col("rest.key").alias(key), "n_words", "n_hit", "items", "spans")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, most_coverage: float = 0.5, most_words: int = 100_000, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with hit spans cut from ``text``; documents with a larger share of hit words than
    ``most_coverage`` are left out. Columns stay as they are; rows without words stay, null and empty texts too. Very long
    texts are read whole, repeated rows are cut each, and an empty table gives no rows."""
    state = _scan(docs, items, window, most_words, True, key, text, item, item_text)
    kept = state.where(F.col("n_hit") <= F.lit(most_coverage) * F.col("n_words"))
    return kept.select(*[F.col("text").alias(text) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
