"""SimHash near-dedup over deletion-variant signatures.

A 64-bit fingerprint is cut into three segments (four for radii of 6 or 7 bits). Two fingerprints that differ in at
most four bits have a segment that differs in at most one, so they share an exact segment or a segment with one bit
wildcarded. Those variants are the keys of an equality match; a match is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import union_all
from .common import checkpoint, connected_components, key_type, records, row_slices, texts, without

LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
#: (first bit, width) of each segment, by the bits that they let differ at most.
SEGMENTS = {5: ((0, 22), (22, 21), (43, 21)), 7: ((0, 16), (16, 16), (32, 16), (48, 16))}
BLOCK = 1 << 15
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The SimHash of the shingles of ``words`` words; 0 where there is no word. Long texts go in blocks."""
    found = (text or b"").translate(LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    reach = min(words, len(found)) - 1
    starts, ends = starts[: len(found) - reach], ends[reach:]
    counts, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        pairs = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], 42) for s, e in pairs], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp`` (the fingerprint's bits as a long) for every row. Null and wordless texts get 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, 1):
                found = np.array([fingerprint(t, words) for t in texts(batch.column(1))], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(scan, f"key {key_type(docs, key)[0]}, fp long")


def segments(limit: int) -> tuple[tuple[int, int], ...]:
    """The fewest segments of which one differs in at most a bit where fingerprints differ in ``limit``."""
    for most, found in SEGMENTS.items():
        if limit <= most:
            return found
    raise ValueError(f"{len(found)} segments find up to {most} differing bits")


def variants(fp: str = "fp", limit: int = 4) -> list:
    """The index keys of a fingerprint: each segment as it is, then with each of its bits wildcarded."""
    keys, number = [], 0
    for first, width in segments(limit):
        segment = F.shiftrightunsigned(F.col(fp), first).bitwiseAND(F.lit((1 << width) - 1))
        for mask in [(1 << width) - 1, *((1 << width) - 1 - (1 << bit) for bit in range(width))]:
            keys.append(F.lit(number << 22).bitwiseOR(segment.bitwiseAND(F.lit(mask))).cast("int"))
            number += 1
    return keys


def _forest(values: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links that span what the values within ``limit`` bits of each other connect."""
    rest, links = values, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            top = queue.pop()
            near = np.bitwise_count(rest ^ top) <= limit
            if near.any():
                hit, rest = rest[near], rest[~near]
                links += [(top, x) for x in hit]
                queue += list(hit)
    return links


def link_runs(batches: Iterator[tuple[np.ndarray, np.ndarray]], limit: int, small: int = 12) -> Iterator[np.ndarray]:
    """Links (n x 2) among the values of each run of equal keys; the keys come sorted, a run may span batches.

    Short runs are compared pair by pair, all runs at once; long runs by a search that meets each value
    once, so that a run of n near copies gives n - 1 links and not all pairs.
    """
    keys, values = np.array([], dtype=np.int64), np.array([], dtype=np.uint64)

    def links(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        found = []
        short = np.repeat(sizes <= small, sizes)
        for offset in range(1, min(small, int(sizes.max(initial=0)))):
            left = np.flatnonzero((keys[offset:] == keys[:-offset]) & short[offset:])
            near = left[np.bitwise_count(values[left] ^ values[left + offset]) <= limit]
            found.append(np.stack([values[near], values[near + offset]], axis=1))
        for start, size in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            own = _forest(values[start : start + size], limit)
            found.append(np.array(own, dtype=np.uint64).reshape(-1, 2))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), dtype=np.uint64)

    for more_keys, more_values in batches:
        if not len(more_keys):
            continue
        keys, values = np.r_[keys, more_keys], np.r_[values, more_values]
        whole = int(np.searchsorted(keys, keys[-1]))
        if whole:
            yield links(keys[:whole], values[:whole])
            keys, values = keys[whole:], values[whole:]
    if len(keys):
        yield links(keys, values)


def _matched(keyed: DataFrame, limit: int) -> DataFrame:
    """Verified links among rows (``run, fp``) of the same run."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)) for b in batches)
        for found in link_runs(pairs, limit):
            yield records(EDGES, (found[:, 0].view(np.int64), found[:, 1].view(np.int64)))

    ordered = keyed.select(F.col("run").cast("long").alias("run"), "fp").repartition("run").sortWithinPartitions("run", "fp")
    return ordered.mapInArrow(scan, "a long, b long")


def links(prints: DataFrame, limit: int = 4, most: int = 1 << 13) -> DataFrame:
    """``a, b``: links that span the components of distinct fingerprints ``fp`` at ``limit`` or fewer bits.

    A segment value that more than ``most`` / 2 distinct fingerprints share is heavy: its variants' rows are
    cut into blocks, and each pair of blocks is a run of its own, so no task holds more than about twice
    ``most`` of one key and no pair is lost. Copies don't count, as fingerprints come distinct.
    """
    cut = segments(limit)
    values = F.array(*[F.lit(n << 22).bitwiseOR(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))) for n, (first, width) in enumerate(cut)])
    heavy = prints.select(F.explode(values).alias("value")).groupBy("value").count().where(F.col("count") > most // 2)
    heavy = checkpoint(heavy.select("value"))
    keyed = prints.select("fp", F.explode(F.array(*variants(limit=limit))).alias("run"))
    if heavy.isEmpty():
        return _matched(keyed, limit)
    runs, number = [], 0
    for n, (_, width) in enumerate(cut):
        full = (1 << width) - 1
        own = F.col("value").bitwiseAND(F.lit((1 << 22) - 1))
        masks = [full, *(full - (1 << bit) for bit in range(width))]
        keys = F.array(*[F.lit((number + i) << 22).bitwiseOR(own.bitwiseAND(F.lit(m))).cast("int") for i, m in enumerate(masks)])
        runs.append(heavy.where(F.shiftright("value", 22) == n).select(F.explode(keys).alias("run")))
        number += len(masks)
    large = union_all(runs).distinct()
    blocks = keyed.join(large, "run", "left_semi").groupBy("run").agg(F.ceil(F.count("*") / most).alias("n_blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("n_blocks"))
    other = F.explode(F.when(F.col("n_blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1), lambda x: x != F.col("block"))))
    split = keyed.join(checkpoint(blocks), "run").withColumn("block", block).withColumn("other", other)
    pair = F.least("block", "other") * F.lit(1 << 16) + F.greatest("block", "other")
    paired = split.select((F.col("run").cast("long").bitwiseOR(F.shiftleft(pair, 32))).alias("run"), "fp")
    light = keyed.join(large, "run", "left_anti").select("run", "fp")
    return union_all([_matched(light, limit), _matched(paired, limit)])


def near_duplicates(docs: DataFrame, words: int = 4, limit: int = 4, most: int = 1 << 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp, component``: one row for each row of ``docs``; component is the smallest key reachable.

    Copies meet in one distinct fingerprint before anything is indexed. Null texts count as empty, rows
    with the same key each return; a null key stays null and can't be the smallest of a component that has
    others. An empty table gives no rows. Columns other than the two named aren't read. Keys keep their type;
    strings go by their bytes.
    """
    prints = checkpoint(fingerprints(docs, words, key, text))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("key").alias("least")))
    roots = connected_components(links(distinct.select("fp"), limit, most))
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = checkpoint(known)
    smallest = known.groupBy("root").agg(F.min("least").alias("component"))
    named = known.join(smallest, "root").select("fp", "component")
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def keep_representatives(docs: DataFrame, words: int = 4, limit: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is their component's smallest; rows that repeat a kept key all stay."""
    return without(docs, near_duplicates(docs, words, limit, key=key, text=text), key)
