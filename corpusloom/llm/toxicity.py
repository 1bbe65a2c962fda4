"""Toxicity: a convolutional text classifier in numpy.

Words get hashed embeddings (of the word and of its beginnings), filters of several widths slide over the whole
text, and each filter keeps its largest responses (max pooling, with the k-th largest beside it). Thresholds are
calibrated by the language that the text itself shows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, row_slices, send, utf8

WORD = re.compile(r"[^\W\d_]+")
#: Function words that show a language. Fixed values.
LANGUAGES = {
    "en": frozenset("the of and to is that was for it with as on be at by this are from".split()),
    "fr": frozenset("le la les des et que qui dans du une pour pas sur au aux est elle".split()),
    "de": frozenset("der die und das den dem ist nicht mit sich auf für ein eine von zu".split()),
    "es": frozenset("el los las y que por con para una del se su al lo como no".split()),
}
SHOWN = frozenset().union(*LANGUAGES.values())
PREFIXES = (4, 5, 6)
BEGINS = 1 << 17
CACHE = 1 << 18


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def language(found: list[str]) -> str:
    """The language with most function words; empty where there is none or a tie."""
    tally = Counter(filter(SHOWN.__contains__, found))
    counts = sorted(((sum(tally[w] for w in own if w in tally), name) for name, own in LANGUAGES.items()), reverse=True)
    return counts[0][1] if counts[0][0] > counts[1][0] else ""


def hashed(word: str, buckets: int) -> tuple[int, ...]:
    """Row of the word, then rows of its beginnings; row 0 is for none."""
    raw = word.encode()
    rows = [1 + xxhash.xxh32_intdigest(raw) % (buckets - 1)]
    return (*rows, *(buckets + 1 + xxhash.xxh32_intdigest(word[:n].encode(), n) % (BEGINS - 1) if len(word) >= n else 0 for n in PREFIXES))


@dataclass
class Network:
    """Embedding rows, one filter bank a width (width x size x filters), biases, and the output layer."""

    buckets: int
    rows: np.ndarray
    banks: list[np.ndarray]
    bias: np.ndarray
    output: np.ndarray
    intercept: float
    kth: int
    thresholds: dict[str, float]

    def responses(self, vectors: np.ndarray) -> np.ndarray:
        """Filter responses at every place (words x all filters); places past the end see zeros."""
        n = len(vectors)
        padded = np.concatenate([vectors, np.zeros((len(self.banks) - 1, vectors.shape[1]), vectors.dtype)])
        return np.concatenate([sum(padded[j : j + n] @ bank[j] for j in range(len(bank))) for bank in self.banks], axis=1)

    def pool(self, responses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest and k-th largest response of each filter after the rectifier, and the places of both."""
        k = min(self.kth, len(responses))
        places = np.argpartition(responses, len(responses) - k, axis=0)[-k:]
        top = np.take_along_axis(responses, places, axis=0)
        order = np.argsort(top, axis=0)
        first = np.take_along_axis(places, order[-1:], axis=0)[0]
        last = np.take_along_axis(places, order[:1], axis=0)[0]
        at = np.r_[first, last]
        values = responses[at, np.r_[np.arange(responses.shape[1]), np.arange(responses.shape[1])]] + self.bias
        if len(responses) < self.kth:
            values[len(values) // 2 :] = 0
        return np.maximum(values, 0), at

    def logit(self, vectors: np.ndarray) -> float:
        if not len(vectors):
            return self.intercept
        return float(self.pool(self.responses(vectors))[0] @ self.output + self.intercept)

    def gradients(self, vectors: np.ndarray, target: int, weight: float) -> tuple[float, list[np.ndarray], np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Of the weighted log loss of one document: by the intercept, by each bank, by the biases, by the output layer,
        and by the vector at each place that a filter's kept response looks at."""
        pooled, at = self.pool(self.responses(vectors))
        error = (1 / (1 + np.exp(-np.clip(pooled @ self.output + self.intercept, -30, 30))) - target) * weight
        back = error * self.output * (pooled > 0)
        filters = self.banks[0].shape[2]
        by_place: dict[int, np.ndarray] = {}
        by_bank = [np.zeros_like(b) for b in self.banks]
        for f in np.flatnonzero(back):
            w, column = f // filters % len(self.banks), f % filters
            for j in range(w + 1):
                place = int(at[f]) + j
                if place < len(vectors):
                    by_bank[w][j, :, column] += back[f] * vectors[place]
                    by_place[place] = by_place.get(place, 0) + back[f] * self.banks[w][j, :, column]
        return float(error), by_bank, back, error * pooled, by_place

    def score(self, logit: float, name: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(logit - self.thresholds.get(name, self.thresholds[""]), -60, 60))))


class Scorer:
    """Scores texts with a cache of bounded size: what each word gives every filter position."""

    def __init__(self, network: Network):
        self.network, self.known = network, {}
        self.matrix = np.concatenate([part for bank in network.banks for part in bank], axis=1)
        self.given = np.empty((CACHE, self.matrix.shape[1]), dtype=np.float32)

    def _learn(self, found: list[str]) -> None:
        fresh = [w for w in set(found) if w not in self.known]
        if len(self.known) + len(fresh) > len(self.given):
            self.known, fresh = {}, list(set(found))
            if len(fresh) > len(self.given):
                self.given = np.empty((len(fresh), self.matrix.shape[1]), dtype=np.float32)
        if fresh:
            net, at = self.network, len(self.known)
            rows = np.array([hashed(w, net.buckets) for w in fresh])
            self.given[at : at + len(fresh)] = net.rows[rows].sum(axis=1) @ self.matrix
            self.known.update(zip(fresh, range(at, at + len(fresh)), strict=True))

    def logit(self, found: list[str]) -> float:
        """As ``Network.logit`` of the words' vectors."""
        net, n = self.network, len(found)
        if not n:
            return net.intercept
        self._learn(found)
        given = self.given[np.fromiter(map(self.known.__getitem__, found), dtype=np.int64, count=n)].T
        banks, column = [], 0
        for bank in net.banks:
            filters = bank.shape[2]
            own = np.array(given[column : column + filters])
            for j in range(1, len(bank)):
                column += filters
                own[:, : max(0, n - j)] += given[column : column + filters, j:]
            column += filters
            banks.append(own)
        responses = np.concatenate(banks)
        k = min(net.kth, n)
        top = np.partition(responses, n - k, axis=1)[:, n - k :]
        values = np.r_[top.max(axis=1), top[:, 0]] + net.bias
        if n < net.kth:
            values[len(values) // 2 :] = 0
        return float(np.maximum(values, 0) @ net.output + net.intercept)

    def score(self, text: str) -> float:
        found = words(text)
        return self.network.score(self.logit(found), language(found))


def train(texts: list[np.ndarray], names: list[str], y: np.ndarray, buckets: int, size: int = 8, filters: int = 8, widths: int = 3, kth: int = 3, epochs: int = 4, rate: float = 0.02, least: int = 4, seed: int = 7) -> Network:
    """Fit on documents given as hashed rows (words x rows). One in five only calibrates the thresholds.

    One dimension of the embeddings starts as the row's smoothed log odds between the classes, the rest at
    random; rows that fewer than ``least`` documents have stay zero, so that no document is learnt by heart.
    """
    rng = np.random.default_rng(seed)
    total = buckets + BEGINS
    part = rng.random(len(texts)) < 0.2
    if (y[~part] == 1).sum() < 5 or (y[~part] == 0).sum() < 5:
        part[:] = False
    fit = np.flatnonzero(~part)
    odds = np.zeros((2, total), dtype=np.float32)
    for i in fit:
        odds[y[i], np.unique(texts[i])] += 1
    n = np.array([max(1, int((y[fit] == k).sum())) for k in range(2)])
    log = np.log((odds[1] + 1) / (odds[0] * n[1] / n[0] + 1))
    odds[:, 0] = 0
    seen = odds.sum(axis=0) >= least
    rows = rng.normal(0, 0.05, (total, size)).astype(np.float32)
    rows[:, 0] = np.clip(log, -1, 4) / 2
    rows[~seen] = 0
    banks = [rng.normal(0, 0.2, (w, size, filters)).astype(np.float32) for w in range(1, widths + 1)]
    for bank in banks:
        bank[:, 0, : filters // 2] = 1 / len(bank)
    count = filters * widths
    bias = np.full(2 * count, -0.2, dtype=np.float32)
    output = np.full(2 * count, 0.5 / count, dtype=np.float32)
    net = Network(buckets, rows, banks, bias, output, -1.0, kth, {"": 0.0})
    speed = [np.full_like(p, 1e-2) for p in (*banks, bias, output)]
    row_speed, step_c = np.full(total, 1e-2, dtype=np.float32), 1e-2
    weight = np.array([0.5, 0.5]) * n.sum() / n
    weight = np.minimum(weight, 4)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids = texts[i]
            if not len(ids):
                continue
            error, by_bank, by_bias, by_output, by_place = net.gradients(net.rows[ids].sum(axis=1), int(y[i]), float(weight[y[i]]))
            for p, g, s in zip((*banks, bias, output), (*by_bank, by_bias, by_output), speed, strict=True):
                s += g * g
                p -= rate * g / np.sqrt(s)
            step_c += error * error
            net.intercept -= float(rate * error / np.sqrt(step_c))
            for place, g in by_place.items():
                own = ids[place][seen[ids[place]]]
                row_speed[own] += float(g @ g)
                rows[own] -= rate * g / np.sqrt(row_speed[own])[:, None]
    logits = np.array([net.logit(net.rows[ids].sum(axis=1)) if len(ids) else net.intercept for ids in texts])
    held = part if (y[part] == 1).sum() >= 5 else np.ones(len(y), dtype=bool)
    net.thresholds[""] = _threshold(logits[held], y[held], 0.0)
    for name in LANGUAGES:
        own = held & (np.array(names) == name)
        net.thresholds[name] = _threshold(logits[own], y[own], net.thresholds[""])
    return net


def _threshold(logits: np.ndarray, y: np.ndarray, prior: float, least: int = 8) -> float:
    """The logit with the best F1; the prior where a class has fewer than ``least`` rows."""
    if min((y == 1).sum(), (y == 0).sum()) < least:
        return prior
    order = np.argsort(-logits)
    right = np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(np.round(f1, 12)))
    low = logits[order[best + 1]] if best + 1 < len(y) else logits[order[best]] - 1
    return float((logits[order[best]] + low) / 2)


def sample(docs: DataFrame, labels: DataFrame, most_docs: int, most_words: int, buckets: int, label: str, key: str, text: str) -> tuple[list[np.ndarray], list[str], np.ndarray]:
    """A bounded sample of labelled rows as hashed rows: about ``most_docs`` / 3 of class 1 and twice as many of class 0.

    Labels are sampled first, by a hash of the key, so that only the chosen documents' texts move. Each class has its
    share of ``most_words``, which bounds what comes to the driver (16 bytes a word): in the order of the draw its rows
    teach that still fit, longer ones are passed over and scored like any other. A class of which no row fits is an error.
    """
    clean = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and key is not null").distinct()
    counts = {r["y"]: r["count"] for r in clean.groupBy("y").count().collect()}
    share = {1: most_docs / 3 / max(1, counts.get(1, 0)), 0: 2 * most_docs / 3 / max(1, counts.get(0, 0))}
    draw = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 20)) / float(1 << 20) / F.when(F.col("y") == 1, share[1]).otherwise(share[0])
    chosen = checkpoint(clean.withColumn("draw", draw).where("draw < 1"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for whole in batches:
            for batch in row_slices(whole, "text"):
                out: list[list] = [[], []]
                for value in utf8(batch.column("text")):
                    found = words((value or b"").decode("utf-8", "replace"))
                    if len(known) > CACHE:
                        known.clear()
                    rows = [known.get(w) or known.setdefault(w, hashed(w, buckets)) for w in found]
                    for column, x in zip(out, (language(found), np.array(rows, dtype="<i4").tobytes()), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("y"), pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], names=["draw", "y", "name", "ids"])

    # the sample's keys are few at any size of the corpus; counted, so that nothing larger is ever broadcast
    keys = F.broadcast(chosen) if chosen.count() <= 4 * most_docs else chosen
    joined = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(keys, "key").select("draw", "y", "text")
    looked = checkpoint(joined.mapInArrow(look, "draw double, y int, name string, ids binary"))
    sizes = looked.groupBy("y", "draw").agg(F.sum(F.octet_length("ids")).alias("n")).orderBy("draw").toPandas()
    taken = []
    for y, part in ((0, 2 / 3), (1, 1 / 3)):
        own, left = sizes[sizes.y == y], 4 * (1 + len(PREFIXES)) * most_words * part
        before = len(taken)
        for draw, n in zip(own.draw, own.n, strict=True):
            if n <= left:
                left -= n
                taken.append((y, float(draw)))
        if len(own) and len(taken) == before:
            raise ValueError(f"no row of class {y} has as few words as the sample may have; raise most_words")
    teach = F.broadcast(docs.sparkSession.createDataFrame(taken, "y int, draw double"))
    table = looked.join(teach, ["y", "draw"], "left_semi").toArrow()
    # the order of tasks mustn't matter
    taught = sorted(zip(table["ids"].to_pylist(), table["name"].to_pylist(), table["y"].to_pylist(), strict=True))
    return [np.frombuffer(x[0], dtype="<i4").reshape(-1, 1 + len(PREFIXES)) for x in taught], [x[1] for x in taught], np.array([x[2] for x in taught], dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = 6000, most_words: int = 6_000_000, buckets: int = 1 << 18, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Network:
    """A network from a bounded sample of the labelled rows of ``docs``; see ``sample`` for the bounds."""
    texts, names, y = sample(docs, labels, most_docs, most_words, buckets, label, key, text)
    return train(texts, names, y, buckets)


def score(docs: DataFrame, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, predicted``: one row for each row of ``docs``, from its whole text alone. Null texts are empty."""
    take = send(docs.sparkSession, network)[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(take())
        for whole in batches:
            for batch in row_slices(whole, "text"):
                scores = [scorer.score((t or b"").decode("utf-8", "replace")) for t in utf8(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scores, pa.float64())], names=["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    scored = rows.mapInArrow(scan, f"key {docs.schema[key].dataType.simpleString()}, score double")
    return scored.select(F.col("key").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "toxic", key: str = "doc_id", text: str = "text", **bounds: int) -> DataFrame:
    """Fit on ``labels`` where ``learn`` holds, then score every row of ``docs``.

    Null keys and labels other than 0 and 1 teach nothing. Without a class's rows every score stays near
    what the other class gives. Null and empty texts are scored alike, very long ones whole, repeated rows each. An
    empty table gives no rows.
    """
    network = fit(docs, labels.where(learn) if learn is not None else labels, label=label, key=key, text=text, **bounds)
    return score(docs, network, key, text)
