"""Divergence of a language's sources: which use the same words, and which words mark each.

Sort-based streaming in two scans. Tasks count terms where the texts lie, a row for each term with its sources; the
rows are repartitioned by language and term and sorted by term and language (terms first: a sort compares their first
bytes), so that a run-length scan sees a term's whole run: its document frequency, its total and its count in each
source. The terms that stay are rated (a group's share
needs the sums over all of them) and sorted once more; the second scan emits, run by run, partial sums of pairs
of sources and the terms that a source has more of than its language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import stored, union_all
from .common import row_slices, texts

#: Bytes of terms, A-Z in lower case; all others part terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SUMS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("count", pa.int64()), ("total", pa.int64()), ("head", pa.int64())])
PARTIAL = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    name = lambda t: f"array<{name(t.value_type)}>" if pa.types.is_list(t) else "long" if pa.types.is_integer(t) else "string"
    return ", ".join(f"`{f.name}` {name(f.type)}" for f in schema)


def term_pieces(text: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """A text's terms, about ``most`` bytes of text at a time; pieces end between terms."""
    if len(text) <= most:
        yield text.translate(TERM_BYTES).split()
        return
    at, plain = 0, text.translate(TERM_BYTES)
    while at < len(plain):
        cut = plain.find(b" ", at + most)
        cut = len(plain) if cut < 0 else cut
        yield plain[at:cut].split()
        at = cut


def _listed(lang: pa.Array, term: pa.Array, offsets: np.ndarray, sources: pa.Array, docs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each term, its sources between the offsets."""
    at = pa.array(offsets, pa.int32())
    return pa.RecordBatch.from_arrays([lang, term, *(pa.ListArray.from_arrays(at, pa.array(v)) for v in (sources, docs, counts))], schema=SUMS)


def _count_terms(most: int):
    """Documents to sums of about ``most`` terms of sources at a time, so that what a task holds is bounded."""

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for lang in dict.fromkeys(x for x, _ in held):
            own = [(source, *sums) for (x, source), sums in held.items() if x == lang]
            coded = pa.array([t for _, _, counts in own for t in counts], pa.binary()).dictionary_encode()
            source = np.repeat(np.arange(len(own)), [len(counts) for _, _, counts in own])
            docs = np.fromiter((seen[t] for _, seen, counts in own for t in counts), np.int64, len(source))
            numbers = np.fromiter((n for _, _, counts in own for n in counts.values()), np.int64, len(source))
            codes, names, terms = coded.indices.to_numpy(), pa.array([x[0] for x in own], pa.string()), coded.dictionary.cast(pa.string())
            order = np.argsort(codes, kind="stable")
            edges = np.r_[np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0]), len(order)] if len(order) else np.zeros(1, dtype=np.int64)
            for at in range(0, len(terms), 1 << 15):
                bounds = edges[at : at + (1 << 15) + 1]
                some = order[bounds[0] : bounds[-1]]
                yield _listed(pa.repeat(pa.scalar(lang), len(bounds) - 1), terms.slice(at, len(bounds) - 1), bounds - bounds[0], names.take(pa.array(source[some])), docs[some], numbers[some])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for whole in batches:
            for batch in row_slices(whole, 2):
                for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                    docs, counts = held.setdefault((lang, source), (Counter(), Counter()))
                    own, before = set(), len(counts)
                    for words in term_pieces(text):
                        counts.update(words)
                        own.update(words)
                    docs.update(own)
                    size += len(counts) - before
                    if size > most:
                        yield from flush(held)
                        held.clear()
                        size = 0
        yield from flush(held)

    return scan


def starts_of(columns: list[pa.Array]) -> np.ndarray:
    """Where runs of equal values of sorted columns begin."""
    rows = len(columns[0])
    new = np.zeros(rows, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int, fold=lambda batch: batch) -> Iterator[pa.RecordBatch]:
    """Batches cut so that no run of the first ``keys`` columns goes on in the next; ``fold`` shortens what waits for its end."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = fold(batch if held is None else pa.concat_batches([held, batch]))
        cut = int(starts_of(batch.columns[:keys])[-1])
        held = batch.slice(cut)
        if cut:
            yield batch.slice(0, cut)
    if held is not None:
        yield held


def _fold(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each term of sorted rows, its sources in the order of their bytes."""
    starts = starts_of(batch.columns[:2])
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, batch.num_rows]))
    sources = batch.column(2).flatten().dictionary_encode()
    by_name = pc.sort_indices(sources.dictionary).to_numpy()
    rank = np.empty(len(by_name), dtype=np.int64)
    rank[by_name] = np.arange(len(by_name))
    pair = np.repeat(run, pc.list_value_length(batch.column(2)).to_numpy()) * len(rank) + rank[sources.indices.to_numpy()]
    order = np.argsort(pair, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0])
    docs, counts = (np.add.reduceat(batch.column(n).flatten().to_numpy()[order], edges) for n in (3, 4))
    of, place = np.divmod(pair[order][edges], len(rank))
    offsets = np.searchsorted(of, np.arange(len(starts) + 1))
    lang, term = (c.take(pa.array(starts)) for c in batch.columns[:2])
    return _listed(lang, term, offsets, sources.dictionary.take(pa.array(by_name[place])), docs, counts)


def _frequent(least: int):
    """Runs of a term in ``least`` or more documents: a row for each of its sources, with the run's total."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, 2, _fold):
            lengths = pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            docs, counts = (batch.column(n).flatten().to_numpy() for n in (3, 4))
            total = np.add.reduceat(counts, starts)
            heads = np.zeros(len(counts), dtype=np.int64)
            heads[starts] = 1
            row = pa.array(np.repeat(np.arange(len(starts)), lengths))
            rows = [batch.column(0).take(row), batch.column(1).take(row), batch.column(2).flatten(), pa.array(counts), pa.array(np.repeat(total, lengths)), pa.array(heads)]
            stays = pa.array(np.repeat(np.add.reduceat(docs, starts) >= least, lengths))
            yield pa.RecordBatch.from_arrays(rows, schema=KEPT).filter(stays)

    return scan


def _distance(p, q):
    """floor((p - q)^2 / (p + q)); int64 holds it, since shares are at most 10^9 + 1."""
    return (p - q) * (p - q) // (p + q)


def _emit(most: int = 1 << 17):
    """Sorted rated rows to partial pairs (the smaller source first) and the terms a group has more of than its language.

    A pair's value sums what two counted shares add beyond what each adds against the other's share of no
    occurrence; ``audit`` adds that rest for all pairs at once, so that sources without a term cost nothing here.
    """

    def partial(sums: dict) -> Iterator[pa.RecordBatch]:
        if sums:
            lang, a, b = zip(*sums, strict=True)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar("pair"), len(a)), pa.array(lang, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(sums.values()), pa.int64())], schema=PARTIAL)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = {}
        for batch in whole_runs(batches, 2):
            p, zero, q = (c.to_numpy() for c in batch.columns[3:6])
            more = pa.array(p > q)
            rows = [pa.repeat(pa.scalar("term"), batch.num_rows), batch.column(0), batch.column(2), batch.column(1), pa.array(_distance(p, q))]
            yield pa.RecordBatch.from_arrays(rows, schema=PARTIAL).filter(more)
            starts = starts_of(batch.columns[:2])
            lengths = np.diff(np.r_[starts, batch.num_rows])
            run = np.repeat(np.arange(len(starts)), lengths)
            names = [batch.column(n).dictionary_encode() for n in (0, 2)]
            langs, sources = (n.dictionary.to_pylist() for n in names)
            lang, source = (n.indices.to_numpy().astype(np.int64) for n in names)
            for step in range(1, int(lengths.max())):
                a = np.flatnonzero(run[step:] == run[:-step])
                b = a + step
                value = _distance(p[a], p[b]) - _distance(p[a], zero[b]) - _distance(zero[a], p[b]) + _distance(zero[a], zero[b])
                pair = (lang[a] * len(sources) + source[a]) * len(sources) + source[b]
                order = np.argsort(pair, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0])
                for code, total in zip(pair[order][edges].tolist(), np.add.reduceat(value[order], edges).tolist(), strict=True):
                    rest, right = divmod(code, len(sources))
                    of, left = divmod(rest, len(sources))
                    key = (langs[of], sources[left], sources[right])
                    sums[key] = sums.get(key, 0) + total
                if len(sums) > most:
                    yield from partial(sums)
                    sums.clear()
        yield from partial(sums)

    return scan


def share(count: Column, size: Column, terms: Column, smooth: int = 2) -> Column:
    """1 + floor(10^9 (count + smooth) / (size + smooth * terms)), by long division in base 1000: exact while the
    divisor is under 9 * 10^15. Null where there is no term."""
    divisor = F.nullif(size + smooth * terms, F.lit(0).cast("long"))
    value = F.lit(0).cast("long")
    rest = (count + smooth).cast("long")
    for scale in (1, 1000, 1000, 1000):
        rest = rest * scale
        value, rest = value * scale + _div(rest, divisor), rest % divisor
    return value + 1


def _div(a: Column, b: Column) -> Column:
    """Whole division of numbers that aren't negative."""
    return F.call_function("div", a, b)


def _square(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def term_counts(docs: DataFrame, least: int = 10, text: str = "text", most: int = 1 << 18) -> DataFrame:
    """``lang, term, source, count, total, head`` of every term in ``least`` or more of its language's documents.

    ``count``: occurrences in the source; ``total``: in the language; ``head``: 1 in one row of each (lang, term).
    Terms are counted before they move, by some ``most`` terms of a task at a time, so a source with a third of
    all rows sends no more than others of as many words. Each row of ``docs`` is a document.
    """
    sums = docs.select("lang", "source", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(_count_terms(most), ddl(SUMS))
    return sums.repartition("lang", "term").sortWithinPartitions("term", "lang").mapInArrow(_frequent(least), ddl(KEPT))


def audit(docs: DataFrame, least: int = 10, smooth: int = 2, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language, and its marks.

    Shares are of the language's terms in ``least`` or more documents, smoothed by ``smooth``; a distance is
    (p - q)^2 / (p + q) of two shares. Part ``pair``: every other source of the language, all terms summed.
    Part ``term``: the ``top`` terms that the source has more of than the language. By value, largest first,
    then item; text, names and ties go by their bytes.

    Null texts, languages and sources are empty strings; every row is a document, repeated ones and those with
    a null key too. A language without a frequent term has pairs of value 0; an empty table gives no rows. Very
    long texts are counted in pieces. Languages and sources of other types are taken as strings.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))], F.col(text).cast("string").alias("text"))
    kept = stored(term_counts(plain, least), "audit-terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("size"))
    whole = kept.groupBy("lang").agg(F.sum("head").alias("terms"), F.sum("count").alias("lang_size"))
    none = F.lit(0).cast("long")
    named = plain.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(whole, "lang", "left")
    named = named.select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("size", "terms", "lang_size")])
    groups = stored(named.withColumn("zero", share(none, F.col("size"), F.col("terms"), smooth)), "audit-groups")

    rated = kept.join(groups, ["lang", "source"]).select("lang", "term", "source", share(F.col("count"), F.col("size"), F.col("terms"), smooth).alias("p"), "zero", share(F.col("total"), F.col("lang_size"), F.col("terms"), smooth).alias("q"))
    emitted = stored(rated.repartition("lang", "term").sortWithinPartitions("term", "lang", "source").mapInArrow(_emit(), ddl(PARTIAL)), "audit-partials")

    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    every = groups.join(other, "lang").where("source <> item")
    base = every.select("lang", "source", "item", F.coalesce(F.col("terms") * _square(F.col("zero"), F.col("item_zero")), none).alias("value"))
    shares = rated.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("times"))
    one = shares.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (_square(F.col("p"), F.col("item_zero")) - _square(F.col("zero"), F.col("item_zero")))).alias("value"))
    sums = union_all([one, emitted.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))])
    mirrored = union_all([sums, sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")])
    pairs = union_all([base, mirrored]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = emitted.where("part = 'term'").select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    ranked = [rows.withColumn("part", F.lit(part)) for rows, part in ((pairs, "pair"), (terms, "term"))]
    return union_all(ranked).select("lang", "source", "part", "item", "value", "rank")
