"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

A candidate token's encoding is inferred from its alphabet. Tests then ask whether its characters look drawn at
random from that alphabet: chi-squared uniformity (of its characters, and of digits, lower and upper case), runs (about
the alphabet's middle, and of digits, lower and upper case), lag-one serial correlation, and whether the bytes that it
encodes have as many high bits as random ones (encoded text has few). What passes them is ranked by a combination of the same three under
written language, which depends on the token's length, and thresholds that hold the false discovery rate are set
for each length class over the whole corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, key_type, records, row_slices, texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
HEXADECIMAL, BASE32, ALPHANUMERIC, BASE64 = range(4)
#: Letters of each encoding in the order of their values.
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
#: Per cent of a to z in written English, rounded. Fixed values.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.07)
#: Upper ends of the length classes, the last open; and bins of -log10 p, a quarter each.
LENGTHS = (24, 32, 48, 64, 128, 256)
BINS = 80
FOUND = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))), ("candidates", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cell", pa.int32())])))])


def infer(token: str) -> tuple[int, np.ndarray]:
    """The encoding with the smallest alphabet that holds the token, and the characters' values in it."""
    token = token.rstrip("=")
    plain = token.replace("-", "+").replace("_", "/")
    lower = token.lower()
    for encoding, text in ((HEXADECIMAL, lower if token in (lower, token.upper()) else token), (BASE32, token), (ALPHANUMERIC, token), (BASE64, plain)):
        codes = np.array([ALPHABETS[encoding].find(c) for c in text])
        if (codes >= 0).all():
            return encoding, codes
    return BASE64, np.zeros(0, dtype=np.int64)


def kind_of(c: str) -> int:
    """1 digit, 2 lower, 3 upper case; 0 what joins words."""
    return 1 if c.isdigit() else 2 if c.islower() else 3 if c.isupper() else 0


def _written(encoding: int) -> np.ndarray:
    """Frequencies of an encoding's characters in written tokens: mostly letters of one case, some of the other, some digits."""
    share = np.full(len(ALPHABETS[encoding]), 2e-3)
    for at, c in enumerate(ALPHABETS[encoding]):
        if c.isalpha():
            share[at] += LETTERS[ord(c.lower()) - 97] / 100 * (0.1 if c.isupper() and encoding in (ALPHANUMERIC, BASE64) else 1)
        elif c.isdigit():
            share[at] += 0.008
    return share / share.sum()


@dataclass(frozen=True)
class Null:
    """What one character of a written token, and of a random one, adds to the statistics of an encoding.

    ``weights``: log ratio of the uniform share to the written one. ``written`` and ``random``: their mean and
    deviation. ``changes``: the share of neighbours of different kinds (digit, lower, upper) in random tokens.
    """

    size: int
    weights: np.ndarray
    written: tuple[float, float]
    random: float
    changes: float

    @classmethod
    def of(cls, encoding: int) -> Null:
        share, size = _written(encoding), len(ALPHABETS[encoding])
        weights = -np.log(share * size)
        mean = float(share @ weights)
        kinds = np.unique([kind_of(c) for c in ALPHABETS[encoding] if kind_of(c)], return_counts=True)[1] / size
        return cls(size, weights, (mean, math.sqrt(float(share @ weights**2) - mean**2)), float(weights.mean()), float(kinds.sum() ** 2 - (kinds**2).sum()) / float(kinds.sum() ** 2))


NULLS = tuple(Null.of(e) for e in range(4))
#: A test vetoes a token whose statistic random characters would give less often than this.
VETO = 1e-3
#: Written tokens vary more than independent draws: so many times the deviation.
SPREAD = 1.5
#: Of neighbours in written tokens, so many are of different kinds; and the lag-one correlation of their values, with its deviation.
JOINTS, ECHO = 0.15, (0.15, 0.15)


#: Kinds of characters (what joins words counts with digits) and their shares, by encoding.
SHARES = tuple(np.bincount([max(1, kind_of(c)) for c in alphabet], minlength=4)[1:] / len(alphabet) for alphabet in ALPHABETS)
#: Bits of a character's value, by encoding.
WIDTHS = (4, 5, 6, 6)


def _tail(z: float) -> float:
    """The normal's lower tail at z."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def uniformity(codes: np.ndarray, size: int) -> float:
    """z of Pearson's chi-squared against a uniform alphabet (unbiased, 0 on average if random)."""
    n, counts = len(codes), np.bincount(codes, minlength=size)
    excess = size * float((counts * (counts - 1)).sum()) / (n * (n - 1)) - 1
    return excess / math.sqrt(2 * (size - 1) / (n * (n - 1)))


def runs(codes: np.ndarray, size: int) -> float | None:
    """Wald-Wolfowitz z of runs above and below the alphabet's middle; None where all lie on one side."""
    high = codes >= size // 2
    n, ones = len(codes), int(high.sum())
    if ones in (0, n):
        return None
    expected = 2 * ones * (n - ones) / n + 1
    variance = max((expected - 1) * (expected - 2) / (n - 1), 1e-9)
    return (int((high[1:] != high[:-1]).sum()) + 1 - expected) / math.sqrt(variance)


def kind_changes(token: str) -> tuple[int, int]:
    """Neighbours of different kinds, and all neighbours, apart from what joins words."""
    kinds = [kind_of(c) for c in token]
    pairs = [(a, b) for a, b in zip(kinds, kinds[1:], strict=False) if a and b]
    return sum(a != b for a, b in pairs), len(pairs)


def serial(codes: np.ndarray) -> float | None:
    """The lag-one correlation; None where all characters are the same."""
    centred = codes - codes.mean()
    power = float((centred**2).sum())
    return float((centred[1:] * centred[:-1]).sum()) / power if power else None


def kinds_p(encoding: int, token: str) -> float:
    """Pearson's chi-squared of digits, lower and upper case against their shares in the alphabet; its upper tail."""
    share = SHARES[encoding]
    plain = token.lower() if encoding == HEXADECIMAL else token
    seen = np.bincount([max(1, kind_of(c)) for c in plain], minlength=4)[1:]
    kinds = share > 0
    expected = share[kinds] * len(token)
    x = float(((seen[kinds] - expected) ** 2 / expected).sum())
    return math.exp(-x / 2) if kinds.sum() == 3 else math.erfc(math.sqrt(x / 2))


def high_bits_p(encoding: int, codes: np.ndarray) -> float:
    """How likely random characters encode bytes with as few high bits as these: text has none or few."""
    width = WIDTHS[encoding]
    bits = (codes[:, None] >> np.arange(width - 1, -1, -1) & 1).reshape(-1)
    n = len(bits) // 8
    high = int(bits[: 8 * n : 8].sum())
    if n > 512:
        return _tail((high + 0.5 - n / 2) / math.sqrt(n / 4))
    return sum(math.comb(n, i) for i in range(high + 1)) / 2**n


def written_p(encoding: int, codes: np.ndarray, token: str) -> float:
    """How likely written tokens of this length look as random as this one does.

    Each test must take the token for random: one that fails (at ``VETO``), or can't be run, gives 1. Then
    three z-scores under the written null are added, weighted by how far random tokens of this length lie
    from it: of the letters' likelihood under the uniform against the written alphabet, of the runs of
    digits, lower and upper case, and of the serial correlation.
    """
    null, n = NULLS[encoding], len(codes)
    changed, neighbours = kind_changes(token)
    if n < 8 or neighbours < 7:
        return 1.0
    run_z, echo = runs(codes, null.size), serial(codes)
    if run_z is None or echo is None:
        return 1.0
    if kinds_p(encoding, token.rstrip("=")) < VETO or high_bits_p(encoding, codes) < VETO:
        return 1.0
    change_z = (changed - neighbours * null.changes) / math.sqrt(neighbours * null.changes * (1 - null.changes))
    if _tail(-uniformity(codes, null.size)) < VETO or 2 * _tail(-max(abs(run_z), abs(change_z), abs(echo) * math.sqrt(n))) < VETO:
        return 1.0
    mean, deviation = null.written
    tests = (
        (float(null.weights[codes].sum()), n * mean, n * null.random, SPREAD * deviation * math.sqrt(n)),
        (changed, neighbours * JOINTS, neighbours * null.changes, SPREAD * math.sqrt(neighbours * JOINTS * (1 - JOINTS))),
        (-echo, -ECHO[0], 0.0, math.sqrt(1 / n + ECHO[1] ** 2)),
    )
    found = np.array([(seen - written) / spread for seen, written, _, spread in tests])
    shift = np.array([(random - written) / spread for _, written, random, spread in tests])
    return max(_tail(-float(found @ shift) / math.sqrt(float(shift @ shift))), 1e-30)


def cell_of(length: int, p: float) -> int:
    """Length class and bin of -log10 p as one number."""
    kind = next((i for i, most in enumerate(LENGTHS) if length <= most), len(LENGTHS))
    return kind * BINS + min(BINS - 1, int(-4 * math.log10(max(p, 1e-30))))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind."""
    found = [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(1, *m.span()) for m in ACCESS.finditer(text)]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, cell) of long tokens that don't touch a base span. Both come by start, so one sweep meets them."""
    found, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][1] < end:
            reach = max(reach, base[at][2])
            at += 1
        if reach > start:
            continue
        encoding, codes = infer(m[0])
        found.append((start, end, cell_of(end - start, written_p(encoding, codes, m[0]) if len(codes) else 1.0)))
    return found


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: base spans and tested candidates, without the text."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, 1):
                rows = []
                for value in texts(batch.column(1)):
                    value = (value or b"").decode("utf-8", "replace")
                    base = base_spans(value)
                    counts = [sum(kind == k for kind, _, _ in base) for k in range(3)]
                    rows.append((*counts, [dict(zip(("kind", "start", "end"), x, strict=True)) for x in base], [dict(zip(("start", "end", "cell"), x, strict=True)) for x in candidates(value, base)]))
                if rows:
                    found = records(FOUND, zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], names=["key", *FOUND.names])

    schema = f"key {key_type(docs, key)[0]}, n_assign long, n_access long, n_hex long, base array<struct<kind:int,start:long,end:long>>, candidates array<struct<start:long,end:long,cell:int>>"
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(look, schema)


def thresholds(counts: dict[int, int], rate: float) -> dict[int, int]:
    """The least bin of each length class that Benjamini-Hochberg accepts at ``rate`` within that class.

    ``counts``: candidates by cell. The p-value of a bin is that of its least random member.
    """
    least = {}
    for kind in range(len(LENGTHS) + 1):
        tested, total = 0, sum(counts.get(kind * BINS + b, 0) for b in range(BINS))
        for b in range(BINS - 1, -1, -1):
            tested += counts.get(kind * BINS + b, 0)
            if tested and 10 ** (-b / 4) * total <= rate * tested:
                least[kind] = b
    return least


def find_secrets(docs: DataFrame, rate: float = 0.01, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_assign, n_access, n_hex, spans``: one row for each row of ``docs``.

    ``spans`` (array of kind, start, end in code points, the end exclusive) holds the fixed patterns' matches
    and, as kind ``random``, tokens of 20 or more characters outside them that pass the battery. Very long texts are
    read whole, and repeated rows are scanned each. Only a table
    of counts by length class and p-value bin, of bounded size, comes to the driver. Null texts are empty
    and have no spans; keys may repeat or be null; an empty table gives no rows.
    """
    found = checkpoint(scan(docs, key, text))
    cells = found.select(F.explode("candidates.cell").alias("cell")).groupBy("cell").count().collect()
    least = thresholds({r["cell"]: r["count"] for r in cells}, rate)
    floor = F.array(*[F.lit(least.get(kind, BINS)) for kind in range(len(LENGTHS) + 1)])
    passed = F.filter("candidates", lambda x: x["cell"] % BINS >= floor[F.floor(x["cell"] / BINS).cast("int")])
    more = F.transform(passed, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    named = F.transform(F.array_sort(F.concat(base, more)), lambda x: F.struct(F.array(*map(F.lit, KINDS))[x["kind"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.select(F.col("key").alias(key), "n_assign", "n_access", "n_hex", named.alias("spans"))


def spans_text(spans, kinds: tuple[str, ...] = KINDS):
    """Spans of the given kinds as kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.filter(spans, lambda x: x["kind"].isin(*kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
