"""Structural quality of chunks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def coherence(text: str | Column) -> Column:
    """1 up to six sentences, then 0.08 less for each more; 0 without any."""
    return coherence_of(F.size(X.sentences(text)))


def coherence_of(n: Column) -> Column:
    """``coherence`` from the number of sentences."""
    return F.round(F.when(n == 0, 0.0).when(n <= 6, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (n - 6) * F.lit(0.08))), 3)


def density(text: str | Column) -> Column:
    """Different words over words, in lower case."""
    found = X.lower_words(text)
    return density_of(F.size(found), F.size(F.array_distinct(found)))


def density_of(words: Column, different: Column) -> Column:
    """``density`` from the two counts."""
    return F.round(F.when(words == 0, 0.0).otherwise(different / words), 3)


def boundary(text: str | Column) -> Column:
    """Half for ending like a sentence (else 0.1), half for starting like one (else 0.2)."""
    return stripped_boundary(X.strip(text))


def stripped_boundary(text: Column) -> Column:
    """``boundary`` of a text that is stripped. Comparisons of its first and last bytes: to take a character from a text is
    to count them all."""
    ends = reduce(lambda a, b: a | b, [text.endswith(c) for c in ".!?।\"'”"])
    starts = ((text >= "A") & (text < "[")) | (text >= F.lit(bytearray(b"\x80")).cast("string"))
    score = F.when(ends & starts, 1.0).when(ends, 0.7).when(starts, 0.6).otherwise(0.3)
    return F.when(text == "", 0.0).otherwise(score)


#: Cells of a passage's matrix of pieces and words up to which all pairs come from one product.
DENSE = 1 << 22
#: Words that are numbered together.
BLOCK = 1 << 17


def largest_overlaps(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each piece's different words (numbers; a piece's run ends at ``ends``), how many the piece that shares most has.

    A piece that shares more than the best so far has one of the words that are over that number, in any order; in the
    order of their rarity those are in few pieces. So a passage of many pieces meets few pairs.
    """
    n = len(ends)
    starts = np.r_[0, ends[:-1]] if n else ends
    sizes = ends - starts
    best = np.zeros(n, dtype=np.int64)
    if n < 2 or not len(words):
        return best
    known, codes, held = np.unique(words, return_inverse=True, return_counts=True)
    piece = np.repeat(np.arange(n), sizes)
    if n * len(known) <= DENSE:
        has = np.zeros((n, len(known)), dtype=np.float32)
        has[piece, codes] = 1
        shared = has @ has.T
        np.fill_diagonal(shared, 0)
        return shared.max(1).astype(np.int64)
    rank = np.empty(len(known), dtype=np.int64)
    rank[np.argsort(held, kind="stable")] = np.arange(len(known))
    codes = rank[codes]
    order = np.lexsort((codes, piece))
    codes = codes[order]
    by_word = np.argsort(codes, kind="stable")
    pieces, first = piece[by_word], np.searchsorted(codes[by_word], np.arange(len(known) + 1))
    for i in range(n):
        own = codes[starts[i] : ends[i]]
        near = [j for j in (i - 1, i + 1) if 0 <= j < n]
        found = max(len(np.intersect1d(own, codes[starts[j] : ends[j]], assume_unique=True)) for j in near)
        at = 0
        while at < len(own) - found:
            others = pieces[first[own[at]] : first[own[at] + 1]]
            others = others[others != i]
            others = others[sizes[others] > found]
            for j in others.tolist():
                found = max(found, len(np.intersect1d(own, codes[starts[j] : ends[j]], assume_unique=True)))
                if found == len(own):
                    break
            at += 1
        best[i] = found
    return best


def most_shared(sets: Column) -> Column:
    """For an array of word sets (numbers), the largest number of words that each shares with another."""

    def rows(sets: pa.Array) -> pa.Array:
        inner = sets.flatten()
        outer, cuts = sets.offsets.to_numpy(), inner.offsets.to_numpy()
        values, base = inner.values.to_numpy(), 0
        lengths = np.diff(outer)
        found = [largest_overlaps(values[cuts[base + a] : cuts[base + b]], cuts[base + a + 1 : base + b + 1] - cuts[base + a]) for a, b in zip(outer[:-1] - outer[0], outer[1:] - outer[0], strict=True)]
        offsets = pa.array(np.r_[0, np.cumsum(lengths)], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64), pa.int64()))

    rows.__annotations__ = {"sets": pa.Array, "return": pa.Array}
    return F.arrow_udf(rows, T.ArrayType(T.LongType()))(sets)


def piece_overlaps(codes: np.ndarray, n_codes: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces that are runs of a passage's words (numbers below ``n_codes``): how many different words each has, and how
    many of them the piece that shares most has."""
    n, sizes = len(starts), ends - starts
    if n == 1 and sizes[0] == len(codes):
        return np.array([n_codes]), np.zeros(1, dtype=np.int64)
    piece = np.repeat(np.arange(n), sizes)
    own = codes[np.arange(len(piece)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)]
    if n * n_codes <= DENSE:
        has = np.zeros((n, n_codes), dtype=np.float32)
        has[piece, own] = 1
        shared = has @ has.T
        different = shared.diagonal().astype(np.int64)
        np.fill_diagonal(shared, 0)
        return different, shared.max(1, initial=0).astype(np.int64)
    held = np.unique(piece * n_codes + own)
    ends = np.searchsorted(held, np.arange(1, n + 1) * n_codes)
    return np.diff(ends, prepend=0), largest_overlaps(held % n_codes, ends)


def passage_overlaps(codes: np.ndarray, n_codes: int, starts: np.ndarray, ends: np.ndarray, views: list[int]) -> np.ndarray:
    """``piece_overlaps`` of a passage's pieces in several views, which end at ``views``: one matrix serves all of them."""
    n, sizes = len(starts), ends - starts
    if n * n_codes > DENSE:
        return np.hstack([piece_overlaps(codes, n_codes, starts[a:b], ends[a:b]) for a, b in pairwise(views)])
    has, found = np.zeros((n, n_codes), dtype=np.float32), np.zeros((2, n), dtype=np.int64)
    to = np.cumsum(sizes)
    has[np.repeat(np.arange(n), sizes), codes[np.arange(to[-1] if n else 0) + np.repeat(starts - to + sizes, sizes)]] = 1
    found[0] = has.sum(1)
    for a, b in pairwise(views):
        if b - a > 1:
            shared = has[a:b] @ has[a:b].T
            shared.flat[:: b - a + 1] = 0
            found[1, a:b] = shared.max(1)
    return found


def passage_codes(words: np.ndarray, at: list[int]) -> tuple[np.ndarray, list[int]]:
    """Numbers of the different words of each passage (a run of ``words`` between two of ``at``), in the order of their first
    places, on from passage to passage; and where each passage's begin and the last one's end."""
    known, different = pd.factorize(words)
    passage = np.repeat(np.arange(len(at) - 1), np.diff(at))
    codes = pd.factorize(passage * len(different) + known)[0]
    return codes, np.r_[0, np.maximum.accumulate(codes) + 1][at].tolist()


OVERLAPS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("n_different", T.LongType()), T.StructField("shared", T.LongType())])))


def overlaps(numbers: Column, counts: Column, literal: Column, at_literal: int, cutters: Sequence[Callable[[list[int]], list[tuple[int, int]]]]) -> Column:
    """For each of ``cutters`` (from the words of a passage's sentences to bounds of pieces over them) an array with
    ``piece_overlaps`` of its pieces.

    ``numbers`` are the passage's words in order, ``counts`` those of its sentences. Where ``literal`` isn't null the
    pieces of the cutter at that place are runs of so many words instead. Bounds are found here once more, as a walk over a few sums: a function
    in Python that reads what another one gives would make Spark put all that lies between them into one expression.
    """

    def rows(numbers: pa.Array, counts: pa.Array, literal: pa.Array) -> pa.Array:
        words, at = numbers.flatten().to_numpy(), (numbers.offsets.to_numpy() - numbers.offsets[0].as_py()).tolist()
        tokens, first = counts.flatten().tolist(), (counts.offsets.to_numpy() - counts.offsets[0].as_py()).tolist()
        sums, starts, ends, sizes = [0, *accumulate(tokens)], [], [], []
        for i, runs in enumerate(literal.to_pylist()):
            own, low = tokens[first[i] : first[i + 1]], first[i]
            for place, cut in enumerate(cutters):
                if runs is not None and place == at_literal:
                    cuts = list(accumulate(runs, initial=at[i]))
                    starts += cuts[:-1]
                    ends += cuts[1:]
                    sizes.append(len(runs))
                else:
                    spans = cut(own)
                    starts += [sums[low + a] for a, _ in spans]
                    ends += [sums[low + b + 1] for _, b in spans]
                    sizes.append(len(spans))
        low, high, k = np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64), len(cutters)
        cuts = [0, *accumulate(sizes)]
        found = np.zeros((2, len(low)), dtype=np.int64)
        begin, n = 0, len(at) - 1
        while begin < n:
            end = max(begin + 1, bisect_right(at, at[begin] + BLOCK) - 1)
            codes, tops = passage_codes(words[at[begin] : at[end]], [a - at[begin] for a in at[begin : end + 1]])
            for i in range(begin, end):
                own, (top, after) = cuts[k * i : k * (i + 1) + 1], tops[i - begin : i - begin + 2]
                mine = slice(own[0], own[-1])
                of_passage = codes[at[i] - at[begin] : at[i + 1] - at[begin]] - top
                found[:, mine] = passage_overlaps(of_passage, after - top, low[mine] - at[i], high[mine] - at[i], [c - own[0] for c in own])
            begin = end
        pieces = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(v) for v in found], ["n_different", "shared"]))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pieces)

    rows.__annotations__ = {"numbers": pa.Array, "counts": pa.Array, "literal": pa.Array, "return": pa.Array}
    return F.arrow_udf(rows, OVERLAPS)(numbers, counts, literal)


def penalty(shared: Column, different: Column) -> Column:
    """Half of the share of a piece's words that another piece has; a piece without words has none."""
    return F.when(F.coalesce(shared, F.lit(0)) == 0, 0.0).otherwise(F.round(F.least(shared / different * 0.5, F.lit(0.5)), 3))


def penalties(sets: str | Column) -> Column:
    """The penalty of each piece of a passage, from their word sets (an array of arrays)."""
    ids = F.transform(sets, lambda own: F.transform(own, lambda w: F.xxhash64(w)))
    return F.zip_with(most_shared(ids), sets, lambda n, own: penalty(n, F.size(own)))


BREAKDOWN = ("quality_score", "semantic_coherence_proxy", "information_density", "boundary_quality", "duplication_penalty")


def with_breakdown(rows: DataFrame, coherent: Column, dense: Column, bounded: Column, penalty: Column, name: str) -> DataFrame:
    """``rows`` with the terms and their sum as a struct; each term is computed once."""
    rows = rows.withColumn(name, F.struct(coherent.alias("c"), dense.alias("d"), bounded.alias("b"), penalty.alias("p")))
    c, d, b, p = (F.col(f"{name}.{k}") for k in "cdbp")
    return rows.withColumn(name, F.struct(*[value.alias(key) for key, value in zip(BREAKDOWN, (F.round(c + d + b - p, 3), c, d, b, p), strict=True)]))


def breakdown_json(name: str) -> Column:
    """A breakdown as JSON, as ``to_json`` writes it: its numbers are never null."""
    parts = [part for key in BREAKDOWN for part in (F.lit(f',"{key}":'), F.col(f"{name}.{key}").cast("string"))]
    return F.concat(F.lit(f'{{"{BREAKDOWN[0]}":'), *parts[1:], F.lit("}"))
