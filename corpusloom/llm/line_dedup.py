"""Line dedup over all documents, with keep bitmaps.

Every text is cut into lines once. A line's key is hashed to 128 bits; the hashes are range-partitioned with a
secondary sort by document, and one pass over each sorted partition streams every key's first document. What
comes out is a compressed keep bitmap for each document that loses a line, never text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import union_all
from .common import checkpoint, key_type, records, row_slices, texts

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLANK = b" \t\n\x0b\x0c\r"
HASH = [("hi", pa.int64()), ("lo", pa.int64())]
#: What follows a key: of a line, and of a document that loses lines.
PLACES = [("row", pa.int64()), ("n_lines", pa.int32()), ("places", pa.binary())]
BITMAP = [("row", pa.int64()), ("n_lines", pa.int32()), ("n_dropped", pa.int32()), ("keep", pa.binary())]


def line_keys(text: bytes, least: int) -> tuple[int, dict[bytes, list[int]]]:
    """The number of lines, and the places of each key (its 128-bit hash) of ``least`` or more code points."""
    lines, places = text.split(b"\n"), {}
    for at, line in enumerate(lines):
        line = line.strip(BLANK)
        if len(line) >= least and (len(line) >= 4 * least or len(line.decode("utf-8", "replace")) >= least):
            places.setdefault(xxhash.xxh3_128_digest(line.translate(LOWER)), []).append(at)
    return len(lines), places


def _extract(least: int, kind: pa.DataType, most: int = 1 << 17):
    schema = pa.schema([*HASH, ("key", kind), *PLACES, ("lost", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, int | str] = {}
        for whole in batches:
            for batch in row_slices(whole, 2):
                held = []
                if len(first) > most:
                    first.clear()
                for key, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                    if key is None or text is None:
                        continue
                    n_lines, places = line_keys(text, least)
                    for digest, at in places.items():
                        held.append((digest, key, row, n_lines, np.array(at, dtype="<u4").tobytes()))
                        if first.setdefault(digest, key) > key:
                            first[digest] = key
                if not held:
                    continue
                halves = np.frombuffer(b"".join(x[0] for x in held), dtype="<i8").reshape(-1, 2)
                keys, rows, counts, places = zip(*(x[1:] for x in held), strict=True)
                lost = [key > first[x[0]] for x, key in zip(held, keys, strict=True)]
                yield records(schema, (halves[:, 0], halves[:, 1], keys, rows, counts, places, lost))

    return scan


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by hash, then document: what isn't in its hash's first document is lost."""
    last_hi, last_lo, holder = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, key = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(3))
        new = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
        if last_hi is not None:
            new[0] = hi[0] != last_hi or lo[0] != last_lo
        group = np.cumsum(new)
        holders = np.concatenate([np.array([key[0] if holder is None else holder], dtype=key.dtype), key[new]])[group]
        last_hi, last_lo, holder = hi[-1], lo[-1], holders[-1]
        lost = pa.array(key != holders)
        yield batch.select([2, 3, 4, 5]).filter(lost)


def _bitmaps(kind: pa.DataType):
    schema = pa.schema([("key", kind), *BITMAP])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, row, n_lines, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keep = np.ones(n_lines, dtype=np.uint8)
                keep[np.frombuffer(b"".join(places), dtype="<u4")] = 0
                found.append((key, row, n_lines, n_lines - int(keep.sum()), zlib.compress(np.packbits(keep, bitorder="little").tobytes())))
            if found:
                yield records(schema, zip(*found, strict=True))

    return scan


def keep_bitmaps(docs: DataFrame, least: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, row, n_lines, n_dropped, keep``: a zlib-compressed little-endian bitmap of the lines that stay.

    A key (stripped of ASCII blanks, A-Z lower-cased) of ``least`` or more code points that two or more
    documents hold stays in the smallest document only, with all its lines there. Documents that lose
    nothing have no row, null and empty texts among them; ``row`` (xxhash64 of the text) tells rows of one
    key apart, which together count as one document. A row with a null key loses nothing and counts for
    nothing. Of what a task has seen only a key's smallest document goes on to the sorted stream, since the
    others have lost the line already (a task remembers about 131,072 keys): a line that a third of all
    documents hold sends a few rows a task.
    Very long texts are read whole. Keys are of any type with an order; strings go by their bytes.
    """
    kind, arrow = key_type(docs, key)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("row"), F.col(text).cast("string").alias("text"))
    found = checkpoint(rows.mapInArrow(_extract(least, arrow), f"hi long, lo long, key {kind}, row long, n_lines int, places binary, lost boolean"))
    ordered = found.where("not lost").drop("lost").repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo", "key")
    lost = ordered.mapInArrow(_stream, f"key {kind}, row long, n_lines int, places binary")
    lost = union_all([lost, found.where("lost").select("key", "row", "n_lines", "places")])
    gathered = lost.groupBy("key", "row").agg(F.first("n_lines").alias("n_lines"), F.collect_list("places").alias("places"))
    return gathered.mapInArrow(_bitmaps(arrow), f"key {kind}, row long, n_lines int, n_dropped int, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text", counts: str | None = None) -> DataFrame:
    """``docs`` with the dropped lines cut from ``text``; ``counts`` names a struct (n_lines, n_dropped) to add after its columns.

    A null text stays null and counts as one empty line. Other columns pass through as they are. The bitmaps
    of a partition are hashed and its texts stream past them, so no text is sorted.
    """
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("row"), F.col(text).cast("string").alias("text"))
    joined = rows.join(bitmaps.select("key", "row", "keep").hint("shuffle_hash"), ["key", "row"], "left").select("rest", "text", "keep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text"):
                kept, counts, dropped = [], [], []
                for value, keep in zip(texts(batch.column("text")), batch.column("keep").to_pylist(), strict=True):
                    n_lines = 1 if value is None else value.count(b"\n") + 1
                    if keep is None:
                        kept.append(value)
                        dropped.append(0)
                    else:
                        stays = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=n_lines, bitorder="little")
                        lines = value.split(b"\n")
                        kept.append(b"\n".join([lines[i] for i in np.flatnonzero(stays)]))
                        dropped.append(n_lines - int(stays.sum()))
                    counts.append(n_lines)
                cut_texts = pa.array(kept, type=pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("rest"), cut_texts, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=["rest", "text", "n_lines", "n_dropped"])

    schema = f"rest {joined.schema['rest'].dataType.simpleString()}, text string, n_lines long, n_dropped long"
    done = joined.mapInArrow(cut, schema)
    columns = [F.col("text").alias(text) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return done.select(*columns, *([F.struct("n_lines", "n_dropped").alias(counts)] if counts else []))


def dedup_lines(docs: DataFrame, least: int = 10, key: str = "doc_id", text: str = "text", counts: str | None = None) -> DataFrame:
    """``docs`` with repeated lines cut; see ``keep_bitmaps`` and ``apply_bitmaps``."""
    return apply_bitmaps(docs, keep_bitmaps(docs, least, key, text), key, text, counts)
