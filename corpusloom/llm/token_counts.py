"""Token counts attributed to sections by offset.

A document is encoded once, as a whole. Token character spans are then joined to section intervals, and a token
that crosses a boundary goes where an explicit rule says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_slices, utf8
from .encoding import Encoder

RULES = ("majority", "start", "end")


def char_spans(octets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code-point spans of tokens that end at the given bytes; a token of part of a character spans that character."""
    number = np.cumsum((octets & 0xC0) != 0x80)
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    return number[starts] - 1 if len(ends) else ends, number[ends - 1] if len(ends) else ends


def attribute(starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none), and whether it touches more than one. Sections are sorted and disjoint.

    Rules: ``majority``, the section with most of the token's characters, the earlier of equals; ``start``
    and ``end``, the first and the last that it touches.
    """
    if not len(lows):
        return np.full(len(starts), -1), np.zeros(len(starts), dtype=bool)
    first = np.searchsorted(highs, starts, side="right")
    last = np.searchsorted(lows, ends, side="left") - 1
    crossing = first < last
    section = np.where(first <= last, last if rule == "end" else first, -1)
    if rule == "majority":
        for at in np.flatnonzero(crossing):
            own = np.arange(first[at], last[at] + 1)
            section[at] = own[np.argmax(np.minimum(highs[own], ends[at]) - np.maximum(lows[own], starts[at]))]
    return section, crossing


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Each line with its line break; a text that ends in a break has an empty last line, which isn't a section."""
    sizes = np.array([len(x) + 1 for x in text.split("\n")], dtype=np.int64)
    highs = np.minimum(np.cumsum(sizes), len(text))
    lows = np.r_[0, highs[:-1]]
    return lows[lows < highs], highs[lows < highs]


def count_tokens(docs: DataFrame, tokenizer: str, sections: str | None = None, rule: str = "majority", special_as_text: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, section, start, end, n_tokens, n_crossing, doc_tokens``: one row for each section of each row.

    ``sections`` names a column of arrays of (start, end) in code points, as fields of a joined text have;
    None means lines. Intervals are sorted here; empty, reversed and null ones are left out, and one that
    overlaps an earlier one starts where that ends. ``section`` counts from 0 in that order; tokens outside
    all of them are section -1, with null start and end. ``n_tokens`` of a document add up to
    ``doc_tokens``. ``n_crossing`` are those of its tokens that touch another section too. A text without
    tokens, null included, has one row of section -1 with no tokens. Keys may repeat or be null. Very long texts
    are encoded whole. A special token's string in a text is that token, or with ``special_as_text`` ordinary
    text. An empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, special_as_text)
        for whole in batches:
            for batch in row_slices(whole, "text", 2 << 20):
                out: list[list] = [[], [], [], [], [], []]
                rows = []
                given = batch.column("sections").to_pylist()
                for at, (raw, own) in enumerate(zip(utf8(batch.column("text")), given, strict=True)):
                    value = (raw or b"").decode("utf-8", "replace")
                    if sections is None:
                        lows, highs = line_sections(value)
                    else:
                        lows, highs = _disjoint(own)
                    ids = encoder.ids(value)
                    starts, ends = char_spans(np.frombuffer(value.encode(), dtype=np.uint8), encoder.byte_ends(ids))
                    section, crossing = attribute(starts, ends, lows, highs, rule)
                    counts = np.bincount(section + 1, minlength=len(lows) + 1)
                    crossed = np.bincount(section + 1, weights=crossing, minlength=len(lows) + 1)
                    kept = np.arange(0 if counts[0] or not len(lows) else 1, len(lows) + 1)
                    rows.append(np.full(len(kept), at))
                    out[0].append(kept - 1)
                    out[1].append(np.r_[-1, lows][kept])
                    out[2].append(np.r_[-1, highs][kept])
                    out[3].append(counts[kept])
                    out[4].append(crossed[kept].astype(np.int64))
                    out[5].append(np.full(len(kept), len(ids)))
                if rows:
                    number, lows_, highs_, *rest = (np.concatenate(c).astype(np.int64) for c in out)
                    keys = batch.column("key").take(pa.array(np.concatenate(rows)))
                    none = number < 0
                    yield pa.RecordBatch.from_arrays([keys, pa.array(number, pa.int64()), pa.array(lows_, mask=none), pa.array(highs_, mask=none), *map(pa.array, rest)], names=["key", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    own = F.col(sections).cast("array<struct<start:long,end:long>>") if sections else F.lit(None).cast("array<struct<start:long,end:long>>")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), own.alias("sections"))
    found = rows.mapInArrow(scan, f"key {docs.schema[key].dataType.simpleString()}, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long")
    return found.withColumnRenamed("key", key)


def _disjoint(sections: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    lows, highs, reach = [], [], 0
    for low, high in sorted((s["start"], s["end"]) for s in sections or () if s and s["start"] is not None and s["end"] is not None):
        low = max(low, reach)
        if low < high:
            lows.append(low)
            highs.append(high)
            reach = high
    return np.array(lows, dtype=np.int64), np.array(highs, dtype=np.int64)
