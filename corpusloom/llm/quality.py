"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and its diagonal. A score is the logistic
of the difference of two Mahalanobis log densities, computed with cached Cholesky factors.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import stored
from .common import checkpoint, row_slices, texts

NAMES = ("words", "word_size", "word_spread", "upper", "symbols", "shouts", "bare", "digits", "stops", "distinct", "repeats", "top", "echo", "packed", "lines", "same_lines", "short", "odd_ends")
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-\"!"]] = True
UPPER, LOWER, DIGIT = (np.array([a <= c <= b for c in range(256)]) for a, b in ((65, 90), (97, 122), (48, 57)))
CUT = 1 << 20


def statistics(text: bytes | None) -> list[float]:
    """The document's transformed statistics, in the order of ``NAMES``: finite for every text."""
    text = text or b""
    found = text.split()
    n = len(found)
    octets = np.frombuffer(text, dtype=np.uint8)
    counts = np.bincount(octets, minlength=256) if len(text) <= CUT else sum(np.bincount(octets[a : a + CUT], minlength=256) for a in range(0, len(text), CUT))
    size, letters = max(1, len(text)), max(1, int(counts[UPPER].sum() + counts[LOWER].sum()))
    sizes = np.fromiter(map(len, found), dtype=np.float64, count=n) if n else np.zeros(1)
    tally = Counter(found)
    lines = text.split(b"\n")
    alike = sum(a == b for a, b in zip(found, found[1:], strict=False))
    triples = set(zip(found, found[1:], found[2:], strict=False))
    share = lambda x, of, least=1e-3: float(np.log(x / max(1, of) + least))
    bare = sum(c for w, c in tally.items() if not any(x in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" or x > 127 for x in w[:4]))
    odd = sum(c for w, c in tally.items() if SYMBOL[w[-1]] or w[-1] == 33)
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(text[a : a + CUT])) for a in range(0, len(text), CUT)) + len(packer.flush())
    return [
        float(np.log1p(n)),
        float(np.log1p(sizes.mean())),
        float(np.log1p(sizes.std())),
        share(counts[UPPER].sum(), letters),
        share(counts[SYMBOL].sum(), size),
        share(counts[33], size),
        share(bare, n),
        share(counts[DIGIT].sum(), size),
        share(counts[46], n, 1e-2),
        float(np.log(len(tally) + 1) - 0.8 * np.log(n + 1)),
        share(alike, n),
        share(max(tally.values(), default=0), n, 1e-2),
        share(max(0, n - 2) - len(triples), n, 1e-2),
        float(np.log((packed + 1) / (size + 20))),
        share(len(lines), n, 1e-2),
        share(len(lines) - len(set(lines)), len(lines), 1e-2),
        share(int((sizes <= 3).sum()) if n else 0, n, 1e-2),
        share(odd, n),
    ]


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, x``: the statistics of every row's whole text. Null texts are empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text"):
                found = pa.array([statistics(t) for t in texts(batch.column("text"))], type=pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("key"), found], names=["key", "x"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(scan, f"key {docs.schema[key].dataType.simpleString()}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Two classes' means and whitening factors (inverse Cholesky factors of their covariances)."""

    shift: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    temper: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.shift) / self.scale, -6, 6)
        log = [self.offsets[k] - 0.5 * np.square((z - self.means[k]) @ self.factors[k].T).sum(axis=1) for k in range(2)]
        return 1 / (1 + np.exp(-np.clip(self.temper * (log[1] - log[0]), -700, 700)))


def _moments(rows: DataFrame, label: str, shift: np.ndarray | None = None, scale: np.ndarray | None = None) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sums and products of ``x`` by class, over all rows: partial sums a task, then one small aggregate."""
    size = len(NAMES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(1 + size + size * size) for k in range(2)}
        for batch in batches:
            classes = batch.column("y").to_numpy(zero_copy_only=False)
            x = np.array(batch.column("x").flatten()).reshape(-1, size)
            x = x if shift is None else np.clip((x - shift) / scale, -6, 6)
            for k in range(2):
                own = x[classes == k]
                totals[k] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
        for k, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["y", "at", "v"])

    parts = rows.select(F.col(label).cast("int").alias("y"), "x").where("y in (0, 1)").mapInArrow(scan, "y int, at int, v double")
    sums = parts.groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    found = {k: np.zeros(1 + size + size * size) for k in range(2)}
    for row in sums:
        found[row["y"]][row["at"]] = row["v"]
    return {k: (int(v[0]), v[1 : 1 + size], v[1 + size :].reshape(size, size)) for k, v in found.items()}


def fit(rows: DataFrame, label: str, shrink: float = 0.5, ridge: float = 0.1, temper: float = 0.5) -> Discriminant:
    """Fit on every labelled row of ``rows`` (``x`` and a 0/1 label); other labels and nulls are left out.

    ``shrink`` pulls a class's covariance towards the pooled one, ``ridge`` both towards the identity.
    Without rows of both classes every score is the prior's.
    """
    size = len(NAMES)
    raw = _moments(rows, label)
    n = max(1, sum(m[0] for m in raw.values()))
    shift = sum(m[1] for m in raw.values()) / n
    spread = np.sqrt(np.maximum(np.diag(sum(m[2] for m in raw.values())) / n - shift**2, 1e-6))
    own = _moments(rows, label, shift, spread)
    means = np.stack([own[k][1] / max(1, own[k][0]) for k in range(2)])
    covariances = [own[k][2] / max(1, own[k][0]) - np.outer(means[k], means[k]) for k in range(2)]
    pooled = sum(own[k][0] * covariances[k] for k in range(2)) / n
    if not (own[0][0] and own[1][0]):
        means, covariances = np.zeros((2, size)), [np.eye(size)] * 2
        pooled = np.eye(size)
    factors, offsets = [], []
    for k in range(2):
        shrunk = (1 - ridge) * ((1 - shrink) * covariances[k] + shrink * pooled) + ridge * np.eye(size)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log((own[k][0] + 1) / (n + 2)) - np.log(np.diag(lower)).sum())
    return Discriminant(shift, spread, means, np.stack(factors), np.array(offsets), temper)


def score(rows: DataFrame, model: Discriminant) -> DataFrame:
    """``rows`` (``key, x``) as ``key, score``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(model.scores(x), pa.float64())], names=["key", "score"])

    return rows.select("key", "x").mapInArrow(scan, f"key {rows.schema['key'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, predicted``: one row for each row of ``docs``, from its text alone.

    ``labels`` (``key``, ``label``) rows where ``learn`` holds (a condition on ``labels``; all if None) teach
    the classes; keys that aren't in ``docs``, null labels and labels other than 0 and 1 teach nothing. A
    repeated key teaches once a pair of rows. Null and empty texts get the score of the empty text; very long
    ones are read whole. An empty table gives no rows.
    """
    found = checkpoint(features(docs, key, text))
    taught = labels.where(learn) if learn is not None else labels
    known = found.join(taught.select(F.col(key).alias("key"), F.col(label).alias("label")), "key").select("x", "label")
    model = fit(checkpoint(known), "label")
    scored = score(found, model)
    return scored.select(F.col("key").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, learn: Column | None = None, threshold: float = 0.5, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns as they are.

    Statistics are taken once and stored beside the rows, in the shared folder until the session ends; the model
    learns from the statistics alone, and the stored rows are filtered where they lie. No text is shuffled.
    Null and empty texts have the empty text's score, rows that repeat the same score each, and an empty table
    gives no rows.
    """
    found = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _statistics(F.col(text).cast("string")).alias("x")), "statistics")
    taught = labels.where(learn) if learn is not None else labels
    known = found.select(F.col(f"row.`{key}`").alias("key"), "x").join(taught.select(F.col(key).alias("key"), F.col(label).alias("label")), "key").select("x", "label")
    model = fit(checkpoint(known), "label")
    return found.where(_score(model, F.col("x")) >= threshold).select("row.*")


def _arrow(f: Callable[[pa.Array], pa.Array], kind: T.DataType, column: Column) -> Column:
    """A column of Python values, Arrow batch by batch; the other columns stay in the JVM."""

    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield f(batch)

    udf.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(udf, kind)(column)


def _statistics(column: Column) -> Column:
    return _arrow(lambda own: pa.array([statistics(t) for t in texts(own)], type=pa.list_(pa.float64())), T.ArrayType(T.DoubleType()), column)


def _score(model: Discriminant, column: Column) -> Column:
    return _arrow(lambda own: pa.array(model.scores(np.array(own.flatten()).reshape(-1, len(NAMES))), type=pa.float64()), T.DoubleType(), column)
