"""Near copies by the Jaccard of word shingles, exact at every similarity from the threshold up.

Candidates come from op1's index first: sets whose SimHashes differ in at most 7 of 64 bits meet in deletion variants of
four segments. Jaccard 0.8 gives about 10 differing bits and up to 17, for which variants would need nine segments of 7
bits, whose buckets hold a hundredth of all fingerprints each; so what the radius leaves out comes from the shingles
themselves, which is the exact way for the rest. Sets with Jaccard t or more share one of the first
n - ceil(t n) + 1 shingles of each in any fixed order (frequent ones go last), and neither is shorter than t times
the other. Where sets meet in a shingle, sketches of 128 one-bit minimum hashes tell near copies from texts that
only share a passage (of near copies they turn away one in 10^9). What is connected by either is compared exactly,
where whole sets meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import union_all
from .common import checkpoint, connected_components, key_type, records, row_slices, sent, utf8, without
from .simhash import EDGES, LOWER
from .simhash import links as links_by_variants

SETS = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("fp", pa.int64()), ("prefix", pa.list_(pa.int64()))])
#: Bits in which SimHashes differ at most where deletion variants link them.
BITS = 7
#: Odd multipliers: each orders a set's shingles anew, and gives a bit of the set's sketch.
ORDERS = np.random.default_rng(5).integers(0, 1 << 63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """The sorted set of 64-bit hashes of the shingles of ``words`` words; a shorter text is one shingle, a wordless one none."""
    found = (text or b"").translate(LOWER).split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    reach = min(words, len(found)) - 1
    starts, ends = (ends - sizes)[: len(found) - reach].tolist(), ends[reach:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e]) for s, e in zip(starts, ends, strict=True)], dtype=np.uint64))


def node(own: np.ndarray) -> int:
    """A set's name: a signed 64-bit hash of its members."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), 1)).view(np.int64))


def sketch(own: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """128 bits as two signed longs, one of the least shingle in each of 128 orders: two sets of Jaccard j differ in a bit with probability (1 - j) / 2."""
    least = np.full(len(ORDERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, block // max(1, len(own)))
    for at in range(0, len(ORDERS), step):
        for start in range(0, len(own), block):
            least[at : at + step] = np.minimum(least[at : at + step], (ORDERS[at : at + step, None] * own[None, start : start + block]).min(axis=1))
    mixed = (least ^ (least >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.packbits((mixed >> np.uint64(63)).astype(np.uint8)).view(np.int64)


def simhash(own: np.ndarray, block: int = 1 << 15) -> int:
    """The SimHash of a set: a bit is 1 if set in over half of its shingles; 0 for an empty set."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(own), block):
        counts += np.unpackbits(own[at : at + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(own)).astype(np.uint8), bitorder="little").view("<i8")[0])


@cache
def most_differ(least: Fraction, lost: float = 1e-9) -> int:
    """Bits in which the sketches of sets with Jaccard ``least`` differ at most, but for a share of ``lost`` of them."""
    p, n, tail = float(1 - least) / 2, len(ORDERS), 0.0
    for bits in range(n, 0, -1):
        tail += comb(n, bits) * p**bits * (1 - p) ** (n - bits)
        if tail > lost:
            return bits
    return 0


def prefix(own: np.ndarray, frequent: np.ndarray, least: Fraction) -> np.ndarray:
    """The first n - ceil(least n) + 1 members; those in the sorted ``frequent`` come after all others."""
    n = len(own)
    if not n:
        return own
    take = n + (-n * least.numerator // least.denominator) + 1
    if not len(frequent):
        return own[:take]
    at = np.searchsorted(frequent, own).clip(max=len(frequent) - 1)
    late = frequent[at] == own
    return np.concatenate([own[~late], own[late]])[:take]


def _frequent(rows: DataFrame, words: int, sampled: int, times: int, most: int) -> np.ndarray:
    """Shingles that ``times`` or more different texts of a sample of about ``sampled`` rows hold, ``most`` at most.

    They only order the shingles, and any order finds the same pairs; so the sample costs no result.
    """
    share = max(1, rows.count() // sampled)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text", 1 << 20):
                own = [shingles(t, words) for t in utf8(batch.column(1))]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["shingle"])

    texts = rows.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).groupBy(F.sha2("text", 256)).agg(F.first("key").alias("key"), F.first("text").alias("text")).select("key", "text")
    counted = texts.mapInArrow(scan, "shingle long").groupBy("shingle").count().where(F.col("count") >= times)
    found = counted.orderBy(F.desc("count"), "shingle").limit(most).select("shingle").toPandas().shingle.to_numpy(dtype=np.int64)
    return np.sort(found.view(np.uint64))


def _sets(rows: DataFrame, words: int, least: Fraction, frequent: np.ndarray) -> DataFrame:
    """``key, node, size, high, low, fp, prefix`` of each row (its sketch in two halves, its SimHash); of equal sets in a task only the first has its prefix."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in row_slices(whole, "text", 1 << 20):
                out = []
                for text in utf8(batch.column(1)):
                    own = shingles(text, words)
                    name = node(own)
                    out.append((name, len(own), *sketch(own).tolist(), simhash(own), [] if name in seen else prefix(own, shared.value, least).view(np.int64)))
                    seen.add(name)
                if out:
                    found = records(SETS, zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], names=["key", *SETS.names])

    return rows.mapInArrow(scan, f"key {key_type(rows, 'key')[0]}, node long, size long, high long, low long, fp long, prefix array<long>")


def _alike(size: np.ndarray, high: np.ndarray, low: np.ndarray, one: np.ndarray | int, two: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether sketches and sizes leave it open that sets ``one`` and ``two`` (places) reach ``least``."""
    differ = np.bitwise_count(high[one] ^ high[two]).astype(np.int64) + np.bitwise_count(low[one] ^ low[two])
    return (differ <= most_differ(least)) & (least.denominator * np.minimum(size[one], size[two]) >= least.numerator * np.maximum(size[one], size[two]))


def _spanned(places: np.ndarray, alike) -> list[tuple[int, int]]:
    """Links that span what ``alike`` connects among ``places``: n - 1 of them for n near copies, not all pairs."""
    rest, links = places, []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            top = queue.pop()
            near = alike(top, rest)
            if near.any():
                hit, rest = rest[near].tolist(), rest[~near]
                links += [(top, x) for x in hit]
                queue += hit
    return links


def _links(run: np.ndarray, size: np.ndarray, name: np.ndarray, high: np.ndarray, low: np.ndarray, least: Fraction, small: int, brief: int = 12) -> np.ndarray:
    """Links (2 x n) that connect what whole runs have alike. Rows come sorted by run, size and name."""
    fresh = np.r_[True, (run[1:] != run[:-1]) | (name[1:] != name[:-1])]
    run, size, name, high, low = (x[fresh] for x in (run, size, name, high.view(np.uint64), low.view(np.uint64)))
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    lengths = np.diff(np.r_[starts, len(run)])
    every = np.repeat(lengths, lengths)
    after = np.repeat(starts + lengths, lengths) - np.arange(len(run)) - 1
    found, going = [], np.flatnonzero((every <= brief) & (after > 0))
    for offset in range(1, min(brief, int(lengths.max()))):
        going = going[after[going] >= offset]
        near = going[_alike(size, high, low, going, going + offset, least)]
        found.append(np.stack([near, near + offset]))
    for start, length in zip(starts[lengths > brief].tolist(), lengths[lengths > brief].tolist(), strict=True):
        if length <= small:
            own = _spanned(np.arange(start, start + length), lambda top, rest: _alike(size, high, low, top, rest, least))
            found.append(np.array(own, dtype=np.int64).reshape(-1, 2).T)
    chain = np.flatnonzero((every > small) & (after > 0))
    chain = chain[least.denominator * size[chain] >= least.numerator * size[chain + 1]]
    found.append(np.stack([chain, chain + 1]))
    pairs = name[np.concatenate(found, axis=1)]
    return np.unique(np.sort(pairs, axis=0), axis=1)


def _candidates(sets: DataFrame, least: Fraction, small: int) -> DataFrame:
    """``a, b``: links that connect all sets with Jaccard ``least`` or more, and few others.

    In the run of a shingle, links span what sketches and sizes leave open: fewer than the run has sets. In a
    run of more than ``small`` sets, sorted by length, the next ones are linked unseen, which connects as much.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((5, 0), dtype=np.int64)

        def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = _links(*rows, least, small)
            if found.shape[1]:
                yield records(EDGES, found)

        for batch in batches:
            if batch.num_rows:
                held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
                whole = int(np.searchsorted(held[0], held[0, -1]))
                if whole:
                    yield from linked(held[:, :whole])
                    held = held[:, whole:]
        if held.shape[1]:
            yield from linked(held)

    keyed = sets.select(F.explode("prefix").alias("run"), "size", "node", "high", "low")
    return keyed.repartition("run").sortWithinPartitions("run", "size", "node").mapInArrow(scan, "a long, b long").distinct()


def _by_variants(sets: DataFrame, bits: int) -> DataFrame:
    """``a, b``: links that connect all sets whose SimHashes differ in at most ``bits``, found by op1's deletion variants.
    A SimHash's links are those of its first set, to which its other sets are linked."""
    nodes = checkpoint(sets.select("node", "fp").distinct())
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    found = links_by_variants(nodes.select("fp").distinct(), bits)
    for end in ("a", "b"):
        found = found.join(first, F.col(end) == F.col("fp")).drop(end, "fp").withColumnRenamed("first", end)
    equal = nodes.join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return union_all([found, equal])


def forest(sets: list[np.ndarray], least: Fraction) -> list[tuple[int, int]]:
    """Links (places in ``sets``) that span the components at Jaccard ``least``; each root is compared with all not yet met."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
    counts = np.bincount(codes)
    firsts = np.cumsum(counts) - counts
    rest, links = np.arange(len(sets)), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            top = queue.pop()
            own = codes[begins[top] : begins[top] + sizes[top]]
            held = counts[own]
            places = np.repeat(firsts[own] - np.cumsum(held) + held, held) + np.arange(held.sum())
            both = np.bincount(holders[places], minlength=len(sets))[rest]
            near = least.denominator * both >= least.numerator * (sizes[top] + sizes[rest] - both)
            if near.any():
                hit, rest = rest[near].tolist(), rest[~near]
                links += [(top, x) for x in hit]
                queue += hit
    return links


def _verified(members: DataFrame, words: int, least: Fraction) -> DataFrame:
    """``a, b``: links that span the exact components among rows (``root, pair, text``) of the same root and pair."""

    def linked(own: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(own) < 2:
            return
        names = np.array(list(own), dtype=np.int64)
        found = np.array(forest(list(own.values()), least), dtype=np.int64).reshape(-1, 2)
        if len(found):
            yield records(EDGES, (names[found[:, 0]], names[found[:, 1]]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, own = None, {}
        for whole in batches:
            for batch in row_slices(whole, "text", 1 << 20):
                for root, pair, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                    if (root, pair) != run:
                        yield from linked(own)
                        run, own = (root, pair), {}
                    found = shingles(text, words)
                    own[node(found)] = found
        yield from linked(own)

    return members.repartition("root", "pair").sortWithinPartitions("root", "pair").mapInArrow(scan, "a long, b long")


def _in_blocks(members: DataFrame, most: int) -> DataFrame:
    """``root, pair, text``: a group of more than ``most`` shingles is cut into blocks, and each pair of blocks meets."""
    block = F.pmod(F.xxhash64("key", "node"), F.col("n_blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)
    other = F.explode(F.when(F.col("n_blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(every, lambda x: x != F.col("block"))))
    split = members.withColumn("block", block).withColumn("other", other)
    return split.select("root", (F.least("block", "other") * F.lit(1 << 31) + F.greatest("block", "other")).alias("pair"), "text")


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, most: int = 1 << 20, small: int = 1 << 12, sampled: int = 1 << 14, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, node, component``: one row for each row of ``docs``; component is the smallest key reachable by
    steps of Jaccard ``least`` or more between sets of shingles of ``words`` words.

    Sets are of 64-bit hashes. Equal sets are one before anything is compared; texts without words are equal.
    Null texts count as empty, a null key can't be the smallest of a component that has others. Very long texts are read
    whole; an empty table gives no rows. Of the texts only those of groups move, where the groups' keys are few enough to be sent.
    """
    exact = Fraction(least).limit_denominator(1 << 10)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sets = checkpoint(_sets(rows, words, exact, _frequent(rows, words, sampled, 4, 1 << 18)))
    groups = connected_components(union_all([_by_variants(sets, BITS), _candidates(sets, exact, small)]))
    distinct = checkpoint(sets.groupBy("node").agg(F.min("key").alias("least"), F.first("size").alias("size")))
    grouped = checkpoint(distinct.join(groups, "node").select("node", "least", "size", "root"))
    blocks = grouped.groupBy("root").agg(F.ceil(F.sum("size") / most).alias("n_blocks"))
    asked = checkpoint(grouped.join(blocks, "root").select(F.col("least").alias("k"), "node", "root", "n_blocks"))
    members = rows.join(sent(asked), F.col("key").eqNullSafe(F.col("k")))
    roots = connected_components(_verified(_in_blocks(members, most), words, exact))
    known = distinct.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    known = checkpoint(known)
    smallest = known.groupBy("root").agg(F.min("least").alias("component"))
    return sets.select("key", "node").join(known.join(smallest, "root").select("node", "component"), "node").select(F.col("key").alias(key), "node", "component")


def keep_representatives(docs: DataFrame, words: int = 5, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is their component's smallest; rows that repeat a kept key all stay."""
    return without(docs, near_duplicates(docs, words, least, key=key, text=text), key)
