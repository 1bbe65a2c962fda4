"""Where a passage's sentences are cut. Only sentence token counts come here, never text.

Bounds are pairs (first, last) of sentence places. Each rule walks over prefix sums: a sorted search gives each start that
is reached its end.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDS = "array<struct<first:int,last:int>>"


@dataclass(frozen=True)
class WindowRule:
    """Sentence windows: at least, about and at most so many tokens, and sentences shared by neighbours."""

    least: int = 30
    target: int = 100
    most: int = 160
    overlap: int = 1


@dataclass(frozen=True)
class BudgetRule:
    """Groups of up to ``target`` tokens; trailing sentences of up to ``overlap`` tokens are repeated."""

    target: int = 150
    overlap: int = 20


@dataclass(frozen=True)
class AdaptiveRule:
    """Token limits of the length classes."""

    short: int = 40
    medium: int = 120
    long: int = 250
    overlap: int = 1

    def window(self, total: int) -> WindowRule | None:
        """The windows of a medium or long passage; None for others."""
        if self.short < total <= self.medium:
            return WindowRule(max(10, self.short // 2), self.medium, self.medium + 30, self.overlap)
        if self.medium < total <= self.long:
            return WindowRule(max(20, self.medium // 2), self.long - 40, self.long, self.overlap)
        return None


def _sums(tokens: Sequence[int]) -> list[int]:
    return [0, *accumulate(tokens)]


def window_bounds(tokens: Sequence[int], rule: WindowRule) -> list[tuple[int, int]]:
    """A window ends where the target is reached or the next sentence would pass the most, whichever is
    first, and later where it would have less than the least."""
    n, sums = len(tokens), _sums(tokens)
    found, at = [], 0
    while at < n:
        reach = bisect_left(sums, sums[at] + rule.target) - 1
        fits = max(bisect_right(sums, sums[at] + rule.most) - 2, at)
        filled = bisect_left(sums, sums[at] + rule.least) - 1
        end = min(max(min(reach, fits), filled), n - 1)
        found.append((at, end))
        if end == n - 1:
            break
        at = max(at + 1, end + 1 - rule.overlap)
    return found


def budget_bounds(tokens: Sequence[int], rule: BudgetRule) -> list[tuple[int, int]]:
    """``first`` may be in the previous group's end, ``fresh`` is the first sentence not yet in any."""
    n, sums = len(tokens), _sums(tokens)
    found, first, fresh = [], 0, 0
    while fresh < n:
        last = max(fresh, bisect_right(sums, sums[first] + rule.target) - 2)
        found.append((first, min(last, n - 1)))
        fresh = last + 1
        back = bisect_left(sums, sums[min(fresh, n)] - rule.overlap)
        first = min(max(back, first), fresh)
    return found


def halved_bounds(tokens: Sequence[int], most: int) -> list[tuple[int, int]]:
    """Halve at the middle sentence until a part has at most ``most`` tokens or one sentence."""
    sums = _sums(tokens)
    found, open_parts = [], [(0, len(tokens))] if len(tokens) else []
    while open_parts:
        low, high = open_parts.pop()
        if sums[high] - sums[low] <= most or high - low <= 1:
            found.append((low, high - 1))
        else:
            middle = low + (high - low) // 2
            open_parts += [(middle, high), (low, middle)]
    return found


def adaptive_bounds(tokens: Sequence[int], rule: AdaptiveRule) -> list[tuple[int, int]]:
    """Windows or halves by the length class; a short passage is one part."""
    total = int(sum(tokens))
    if total <= rule.short:
        return [(0, len(tokens) - 1)] if len(tokens) else []
    window = rule.window(total)
    return window_bounds(tokens, window) if window else halved_bounds(tokens, rule.long)


CUTTERS = {WindowRule: window_bounds, BudgetRule: budget_bounds, AdaptiveRule: adaptive_bounds}


def bounds(counts: Column, rule: WindowRule | BudgetRule | AdaptiveRule) -> Column:
    """Bounds of an array of token counts by a rule, one Arrow round trip of small integers."""
    cut = CUTTERS[type(rule)]

    def rows(counts: pa.Array) -> pa.Array:
        values, at = counts.flatten().tolist(), (counts.offsets.to_numpy() - counts.offsets[0].as_py()).tolist()
        found = [cut(values[a:b], rule) for a, b in pairwise(at)]
        flat = chain.from_iterable(found)
        pairs = np.fromiter(chain.from_iterable(flat), dtype=np.int32).reshape(-1, 2)
        ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["first", "last"]))

    rows.__annotations__ = {"counts": pa.Array, "return": pa.Array}
    return F.arrow_udf(rows, BOUNDS)(counts)
