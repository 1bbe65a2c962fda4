"""Packing into fixed windows by Karmarkar-Karp multiway differencing.

Documents are encoded and packed where they are read: a group of documents with about ``group_tokens`` tokens is
one problem, so nothing is shuffled and no task holds more than a group.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_type, records, row_slices
from .encoding import Encoder

PIECES = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])


@dataclass
class Partition:
    """A partial partition: sums of its windows in descending order, and the items in each; the other windows are empty."""

    sums: list[int]
    members: list[list[int]]


def _merge(one: Partition, two: Partition, windows: int) -> Partition:
    """Join with opposing imbalances: the fullest windows of one meet the emptiest of the other."""
    pairs = list(zip(one.sums, one.members, strict=True))
    rising = list(zip(two.sums, two.members, strict=True))[::-1]
    shared = max(0, len(pairs) + len(rising) - windows)
    for at, (total, members) in enumerate(rising[:shared], len(pairs) - shared):
        pairs[at] = (pairs[at][0] + total, pairs[at][1] + members)
    pairs += rising[shared:]
    pairs.sort(key=lambda x: -x[0])
    return Partition([x[0] for x in pairs], [x[1] for x in pairs])


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Items in ``windows`` groups of near-equal sums, by multiway differencing: the two partial partitions
    with the largest spread are merged until one is left."""
    spread = lambda p: p.sums[0] - (p.sums[-1] if len(p.sums) == windows else 0)
    heap = [(-size, n, Partition([size], [[n]])) for n, size in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        joined = _merge(heapq.heappop(heap)[2], heapq.heappop(heap)[2], windows)
        heapq.heappush(heap, (-spread(joined), number, joined))
        number += 1
    members = heap[0][2].members if heap else []
    return members + [[] for _ in range(windows - len(members))]


def near_equal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows by differencing; the count rises while any exceeds ``capacity``, by what all of them exceed it. No item is cut."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        members = difference(sizes, windows)
        over = sum(max(0, sum(sizes[i] for i in m) - capacity) for m in members)
        if not over:
            return members
        windows += -(-over // capacity)


def pack_group(sizes: list[int], capacity: int, cut: bool = True, most_padding: float = 0.01) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) that hold every token once.

    Items over ``capacity`` give whole windows first. The rests go whole into near-equal windows by
    differencing, one more whenever a window exceeds its capacity. What these windows leave empty is padding;
    where it is more than ``most_padding`` of all tokens, the emptiest windows are cut up to fill the others'
    largest gaps, and the last of them is cut at powers of two, whose sequences need no padding. So a rest
    is cut only to close a window. Without ``cut`` nothing is cut, and each item must fit in a window.
    """
    if not cut:
        if max(sizes, default=0) > capacity:
            raise ValueError("an item is larger than a window")
        return [[(i, 0, sizes[i]) for i in m] for m in near_equal(sizes, capacity) if m]
    sequences, start = [], [size // capacity * capacity for size in sizes]
    for i, size in enumerate(start):
        sequences += [[(i, at, capacity)] for at in range(0, size, capacity)]
    rest = [i for i, size in enumerate(sizes) if size > start[i]]
    left = [sizes[i] - start[i] for i in rest]
    windows = [[(rest[n], start[rest[n]], left[n]) for n in m] for m in near_equal(left, capacity) if m]
    windows.sort(key=lambda w: -sum(p[2] for p in w))
    rooms = [capacity - sum(p[2] for p in w) for w in windows]
    surplus = sum(rooms) - int(most_padding * sum(sizes))
    while surplus >= capacity:
        pieces, room = windows.pop(), rooms.pop()
        _pour(pieces, capacity - room, windows, rooms)
        surplus -= capacity
    if surplus > 0:
        pieces, room = windows.pop(), rooms.pop()
        _pour(pieces, max(0, surplus - room), windows, rooms)
        sequences += _powers(pieces)
    return sequences + windows


def _pour(pieces: list[tuple[int, int, int]], tokens: int, windows: list[list[tuple[int, int, int]]], rooms: list[int]) -> None:
    """Move ``tokens`` tokens from the end of ``pieces`` to the windows with most room; both lists are changed."""
    by_room = [(-room, at) for at, room in enumerate(rooms)]
    heapq.heapify(by_room)
    while tokens:
        at = heapq.heappop(by_room)[1]
        while tokens and rooms[at]:
            i, begin, length = pieces.pop()
            used = min(length, rooms[at], tokens)
            windows[at].append((i, begin + length - used, used))
            if used < length:
                pieces.append((i, begin, length - used))
            rooms[at] -= used
            tokens -= used


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Sequences of a power of two tokens each, largest first."""
    total, found, pieces = sum(p[2] for p in pieces), [], pieces[::-1]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        own = []
        while room:
            i, begin, length = pieces.pop()
            used = min(room, length)
            own.append((i, begin, used))
            if used < length:
                pieces.append((i, begin + used, length - used))
            room -= used
        found.append(own)
    return found


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int | None = 1, group_tokens: int = 1 << 19, cut: bool = True, most_padding: float = 0.01, special_as_text: bool = False, with_ids: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``: one row a piece.

    A document's tokens are its ids by the file ``tokenizer``, then ``end`` (None: nothing). A special token's
    string in a text is that token, or with ``special_as_text`` ordinary text. A null text is empty; a
    document without tokens has no piece; very long texts are encoded whole and fill windows of their own.
    Sequence ids are unique in the whole result, not consecutive; offsets are gapless. Padding (up to
    ``capacity``, but for totals that are powers of two) is at most ``most_padding`` of a group's tokens. The
    CRC is of little-endian unsigned 32-bit ids. Keys may repeat or be null: each row is a document of its
    own. An empty table has no pieces.
    """

    ddl, kind = key_type(docs, key)
    schema = pa.schema([("key", kind), *PIECES])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, special_as_text)
        tail = [] if end is None else [end]
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[object, np.ndarray]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = []
            for pieces in pack_group([len(ids) for _, ids in held], capacity, cut, most_padding):
                offset = 0
                for i, start, length in pieces:
                    own = held[i][1][start : start + length]
                    rows.append((held[i][0], start, length, zlib.crc32(own.astype("<u4").tobytes()), len(held[i][1]), sequence, offset, own.astype(np.int32) if with_ids else None))
                    offset += length
                sequence += 1
            if rows:
                yield records(schema, zip(*rows, strict=True))

        size = 0
        for whole in batches:
            for batch in row_slices(whole, "text", 1 << 20):
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held.append((name, np.append(encoder.ids(value or ""), np.array(tail, dtype=np.uint32))))
                    size += len(held[-1][1])
                    if size >= group_tokens:
                        yield from packed()
                        held, size = [], 0
        yield from packed()

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    pieces = rows.mapInArrow(scan, f"key {ddl}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")
    return pieces.withColumnRenamed("key", key)
