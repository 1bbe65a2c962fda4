"""Embedding, dense and BM25 search, rank fusion. Ranked results are rows (query_id, rank, chunk_id, score)."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.frames import scratch_path, union_all
from ..sources.term_index import ASKED, TermIndex

#: Payload columns that a search may be filtered on. is_selected must never be one.
FILTERS = ("language", "query_type", "chunk_strategy")
DISTANCES = ("cosine", "dot", "euclid")


# ---- embedding ----


#: Models whose texts take a prefix. Fixed values.
PREFIXED = frozenset(f"intfloat/multilingual-e5-{size}" for size in ("small", "base", "large"))


class HashingEmbedder:
    """Character n-grams of words (with a blank on both sides) hashed to ``dimension`` places, L2-normalised.

    A stand-in without meaning, for tests of the path from text to metrics. The hash of an n-gram is its code
    points as digits in base 131, modulo the dimension, so that any engine gives the same vector. Words' places are known
    from one call to the next, as bytes: an array for each word takes twice the room.
    """

    def __init__(self, dimension: int = 256, sizes: tuple[int, int] = (2, 4)):
        self.name, self.dimension, self.sizes, self.most_known, self._known = f"TEST_ONLY_hashing_dim{dimension}", dimension, sizes, 1 << 18, {}

    def __getstate__(self) -> dict:
        """Without the words known so far."""
        return self.__dict__ | {"_known": {}}

    def places(self, word: str) -> np.ndarray:
        """The place of each n-gram of a word; a word shorter than n gives itself once."""
        codes = np.array([ord(c) for c in f" {word} "], dtype=np.int64)
        found = []
        for n in range(self.sizes[0], self.sizes[1] + 1):
            width = min(n, len(codes))
            value = np.zeros(len(codes) - width + 1, dtype=np.int64)
            for j in range(width):
                value = (value * 131 + codes[j : len(codes) - width + 1 + j]) % self.dimension
            found.append(value)
            if n >= len(codes):
                break
        return np.concatenate(found)

    def embed(self, texts: Sequence[str | None], is_query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), dtype=np.float64)
        kind = np.uint16 if self.dimension <= 1 << 16 else np.uint32
        known = self._known
        for row, text in enumerate(texts):
            places = []
            for word in (text or "").lower().split():
                if word not in known:
                    if len(known) >= self.most_known:
                        known.clear()
                    known[word] = self.places(word).astype(kind).tobytes()
                places.append(known[word])
            if places:
                out[row] = np.bincount(np.frombuffer(b"".join(places), dtype=kind), minlength=self.dimension)
        sizes = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(sizes == 0, 1, sizes)).astype(np.float32)


class TransformerEmbedder:
    """A sentence-transformers model, loaded once a worker; needs that optional package.

    A device never falls back: one that isn't there, or a model that ends up on another, is an error.
    """

    def __init__(self, model: str, device: str = "cpu"):
        if device not in ("cpu", "cuda", "mps"):
            raise ValueError(f"unknown device {device}")
        self.name, self.device, self._model = model, device, None

    def __getstate__(self) -> dict:
        """Without the loaded model: a worker loads its own."""
        return self.__dict__ | {"_model": None}

    def _load(self):
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            if self.device != "cpu":
                import torch

                backend = torch.cuda if self.device == "cuda" else getattr(torch.backends, "mps", None)
                if backend is None or not backend.is_available():
                    raise RuntimeError(f"device {self.device} was asked for and isn't available")
            model = SentenceTransformer(self.name, device=self.device)
            actual = str(next(model.parameters()).device)
            if not actual.startswith(self.device):
                raise RuntimeError(f"device {self.device} was asked for, but the model is on {actual}")
            self._model = model
        return self._model

    @property
    def dimension(self) -> int:
        return self._load().get_sentence_embedding_dimension()

    def embed(self, texts: Sequence[str | None], is_query: bool = False) -> np.ndarray:
        prefix = ("query: " if is_query else "passage: ") if self.name in PREFIXED else ""
        return np.asarray(self._load().encode([prefix + (t or "") for t in texts], normalize_embeddings=True), dtype=np.float32)


def get_embedder(model: str, device: str = "cpu") -> HashingEmbedder | TransformerEmbedder:
    """``TEST_ONLY:dim{n}`` names the hashing stand-in; anything else is a model's name."""
    if model.startswith("TEST_ONLY:"):
        return HashingEmbedder(int(model.rpartition("dim")[2]) if "dim" in model else 256)
    return TransformerEmbedder(model, device)


def embed_with_timing(embedder, texts: Sequence[str], is_query: bool = False) -> tuple[np.ndarray, float]:
    """Vectors, and milliseconds."""
    began = time.perf_counter()
    return embedder.embed(texts, is_query), (time.perf_counter() - began) * 1000


def warm_up(embedder, calls: int = 5, text: str = "warm-up text") -> float:
    """Milliseconds of some calls that don't count."""
    return sum(embed_with_timing(embedder, [text])[1] for _ in range(calls))


#: Texts that a task embeds together.
TEXTS = 1 << 10


def list_array(vectors: np.ndarray) -> pa.ListArray:
    """A matrix's rows as an Arrow column of lists."""
    n, size = vectors.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(np.ascontiguousarray(vectors, dtype=np.float32).ravel()))


def embed(frame: DataFrame, embedder, text: str = "text", name: str = "embedding", is_query: bool = False) -> DataFrame:
    """``frame`` with the vectors of a text column, Arrow batch by batch; the embedder is sent once a task."""

    def vectors(batches: Iterator) -> Iterator:
        for texts in batches:
            # a batch has as many texts as the session's Arrow batches; what is made of them at once has a bound of its own
            parts = [list_array(embedder.embed(texts.slice(at, TEXTS).to_pylist(), is_query)) for at in range(0, len(texts), TEXTS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=pa.list_(pa.float32()))

    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from vectors(batches)

    udf.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return frame.withColumn(name, F.arrow_udf(udf, T.ArrayType(T.FloatType()))(F.col(text)))


# ---- dense ----


def check_filter(query_filter: Mapping[str, str] | None) -> dict[str, str]:
    """Only routing keys may filter a search."""
    odd = set(query_filter or {}) - set(FILTERS)
    if odd:
        raise ValueError(f"refusing to filter on {', '.join(sorted(odd))}; allowed are {', '.join(FILTERS)}")
    return dict(query_filter or {})


def _hit_schema(queries: DataFrame, query_key: str, corpus: DataFrame, corpus_key: str) -> tuple[T.StructType, list[pa.DataType]]:
    """Fields of a task's hits, and their Arrow types; keys keep their types."""
    fields = [T.StructField("query_id", queries.schema[query_key].dataType), T.StructField("chunk_id", corpus.schema[corpus_key].dataType), T.StructField("score", T.DoubleType())]
    return T.StructType(fields), [to_arrow_type(f.dataType) for f in fields]


def _scores(block: np.ndarray, corpus: np.ndarray, distance: str) -> np.ndarray:
    """Scores (larger is better) of every query of a block for every corpus row."""
    if distance == "euclid":
        squared = (block**2).sum(axis=1)[:, None] + (corpus**2).sum(axis=1)[None, :] - 2 * block @ corpus.T
        return -np.sqrt(np.maximum(squared, 0))
    if distance == "cosine":
        block = block / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-300)
        corpus = corpus / np.maximum(np.linalg.norm(corpus, axis=1, keepdims=True), 1e-300)
    return block @ corpus.T


#: Queries whose hits a task gives in one batch.
PART = 1 << 10


class Best:
    """Each query's best k hits as (-score, id), by blocks of scores; equal scores go by id. ``least``: scores that a
    query's hits must reach, where that is known."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None):
        self.k, self.hits = k, [[] for _ in range(queries)]
        self.cuts = np.full(queries, -np.inf) if least is None else least.astype(np.float64)

    def add(self, scores: np.ndarray, ids: list, queries: np.ndarray) -> None:
        """A block of scores (``queries`` by rows) whose ``ids`` ascend. Only queries that a row can still help are looked at."""
        if not len(ids) or not len(queries):
            return
        k, tops = self.k, scores.max(axis=1)
        for i in np.flatnonzero(tops >= self.cuts[queries]).tolist():
            query, line = int(queries[i]), scores[i]
            best, floor = self.hits[query], self.cuts[query]
            if len(best) == k and tops[i] == floor and not ids[0] < best[-1][1]:
                continue
            if len(line) > 4 * k:
                floor = max(floor, np.partition(line, len(line) - k)[len(line) - k])
            near = np.flatnonzero(line >= floor)
            near = near[np.argsort(-line[near], kind="stable")[:k]]
            best = self.hits[query] = sorted([*best, *((-line[j], ids[j]) for j in near.tolist())])[:k]
            if len(best) == k:
                self.cuts[query] = -best[-1][0]

    def batches(self, keys: list, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        """The hits of some queries at a time, which then are held no more."""
        for first in range(0, len(self.hits), PART):
            flat = [(keys[i], key, -score) for i in range(first, min(first + PART, len(self.hits))) for score, key in self.hits[i]]
            self.hits[first : first + PART] = [[]] * len(self.hits[first : first + PART])
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*flat, strict=True), kinds, strict=True)], names=["query_id", "chunk_id", "score"])


def usable(ids: pa.Array, vectors: pa.Array, dimension: int) -> tuple[list, np.ndarray]:
    """Ids in order and their vectors, without rows that have no id, no vector or one of another size, or an element that
    is null, NaN or infinite."""
    right = pc.and_(ids.is_valid(), pc.fill_null(pc.equal(pc.list_value_length(vectors), dimension), False))
    ids, vectors = ids.filter(right), vectors.filter(right)
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dimension)
    good = np.flatnonzero(np.isfinite(matrix).all(axis=1))
    named = ids.take(pa.array(good)).to_pylist()
    order = sorted(range(len(named)), key=named.__getitem__)
    return [named[j] for j in order], matrix[good[order]]


def query_blocks(queries: DataFrame, query_key: str, vector: str, block: int, most: int) -> Iterator[tuple[list, np.ndarray]]:
    """Keys and vectors of usable queries, ``block`` numbers or ``most`` queries of them at a time. Queries without a vector, or with an
    element that is null, NaN or infinite, are left out; all others must have one dimension."""
    precision = np.float32 if queries.schema[vector].dataType == T.ArrayType(T.FloatType()) else np.float64
    keys, vectors, size = [], [], None
    for row in queries.select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").toLocalIterator():
        if any(x is None or not math.isfinite(x) for x in row.v):
            continue
        size = len(row.v) if size is None else size
        if len(row.v) != size:
            raise ValueError(f"queries have vectors of {size} and of {len(row.v)}")
        keys.append(row.q)
        vectors.append(np.array(row.v, dtype=precision))
        if len(keys) * size >= block or len(keys) >= most:
            yield keys, np.array(vectors)
            keys, vectors = [], []
    if keys:
        yield keys, np.array(vectors)


def kth_scores(hits: DataFrame, keys: list, k: int) -> np.ndarray:
    """Each query's k-th best score of some hits, -inf where there are fewer; one number a query comes to the driver."""
    cut = best_hits([hits], k, "dot").where(F.col("rank") == k).select("query_id", "score").toArrow()
    place, least = {key: at for at, key in enumerate(keys)}, np.full(len(keys), -np.inf)
    for key, score in zip(cut.column("query_id").to_pylist(), cut.column("score").to_pylist(), strict=True):
        least[place[key]] = score
    return least


def best_hits(found: Sequence[DataFrame], k: int, distance: str) -> DataFrame:
    """Ranked rows of tasks' hits; scores are larger is better there, and distances here."""
    ranked = union_all(found).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= k)
    score = -F.col("score") if distance == "euclid" else F.col("score")
    return ranked.select("query_id", "rank", "chunk_id", score.alias("score"))


#: Scores that a task holds at once, at most: rows come in runs, queries in parts.
ROWS, QUERIES = 1 << 10, 1 << 10
#: Hits that a task holds at once, at most: so many queries, times k, are asked in one pass over the corpus.
HITS = 1 << 20
#: From so many tasks on a first round over one row in ``SHARE`` gives each query a score that its hits must reach.
TASKS, SHARE = 64, 128


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 30, distance: str = "cosine", query_filter: Mapping[str, str] | None = None, block: int = 1 << 24, query_key: str = "query_id", corpus_key: str = "chunk_id", vector: str = "embedding", places: int | None = None) -> DataFrame:
    """Exact top k of every query over the whole corpus; equal scores go by corpus key. Euclid scores are distances.
    With ``places`` scores are rounded before any row is left out, so that ties are those of the rounded scores.

    The corpus is read once for each ``block`` numbers of query vectors (65,536 queries of 256 dimensions) or ``HITS`` hits,
    so what is sent and held has a fixed bound; a task keeps its own best k of each query, and only those are shuffled. A corpus
    of more than ``TASKS`` tasks is first searched in part, one row in ``SHARE`` by its key's hash: tasks then give only hits
    that reach the k-th best score found there, some k for each query together and not k from each task.
    Rows and queries without a vector, or with an element that is null, NaN or infinite, match nothing, nor do rows
    of another dimension or without a key; queries of two dimensions are refused.
    """
    if distance not in DISTANCES:
        raise ValueError(f"distance is one of {', '.join(DISTANCES)}")
    for name, value in check_filter(query_filter).items():
        corpus = corpus.where(F.col(name) == value)
    spark = queries.sparkSession
    schema, kinds = _hit_schema(queries, query_key, corpus, corpus_key)
    rows = corpus.select(F.col(corpus_key).alias("chunk_id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")

    def search(rows: DataFrame, keys: list, vectors: np.ndarray, least: np.ndarray | None = None) -> DataFrame:
        shared = spark.sparkContext.broadcast((keys, vectors, least))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_keys, own, floor = shared.value
            best = Best(len(own_keys), k, floor)
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(start, ROWS)
                    named, matrix = usable(batch.column(0), batch.column(1), own.shape[1])
                    for first in range(0, len(own), QUERIES):
                        scores = _scores(own[first : first + QUERIES].astype(np.float64), matrix, distance)
                        best.add(scores if places is None else np.round(scores, places), named, np.arange(first, first + len(scores)))
            yield from best.batches(own_keys, kinds)

        return rows.mapInArrow(scan, schema)

    found, part = [], None
    if rows.rdd.getNumPartitions() > TASKS:
        part = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(SHARE)) == 0)
    for keys, vectors in query_blocks(queries, query_key, vector, block, max(1, HITS // k)):
        least = None if part is None else kth_scores(search(part, keys, vectors), keys, k)
        found.append(search(rows, keys, vectors, least))
    return best_hits(found or [spark.createDataFrame([], schema)], k, distance)


# ---- sparse ----


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int = 30, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, block: int = ASKED, query_key: str = "query_id", corpus_key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Okapi BM25 over white-space words; equal scores (to 9 places) go by corpus key, so rows that match nothing fill up to k.

    idf is ln(N - n + 0.5) - ln(n + 0.5), a negative one replaced by ``epsilon`` times the mean idf of all
    words. A repeated query word counts as often as it occurs. The corpus is read and split into words once, into
    an inverted index that goes with the session; what is searched again should have its own ``TermIndex``.
    A task scores ``block`` query words together at most.
    """
    index = TermIndex(queries.sparkSession, scratch_path(queries.sparkSession, "terms"))
    index.add(corpus, key=corpus_key, text=text)
    return index.search(queries, k, k1, b, epsilon, query_key, text, asked=block)


# ---- fusion ----


def rrf(lists: Sequence[DataFrame], k: int = 60, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked rows: the sum of 1 / (k + rank). Equal scores go by the place in the first
    list that has the row, then in the next."""
    if not lists:
        raise ValueError("no ranking is given")
    rows = union_all([ranked.select("query_id", "chunk_id", "rank", F.lit(n).alias("list")) for n, ranked in enumerate(lists)])
    fused = rows.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("_seen"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "_seen")))
    ranked = ranked.where(F.col("rank") <= top) if top else ranked
    return ranked.select("query_id", "rank", "chunk_id", "score")


def retrieval_modes(dense: DataFrame, sparse: DataFrame, modes: Sequence[str] = ("dense", "hybrid_rrf"), k: int = 60) -> DataFrame:
    """Ranked rows with their mode."""
    made = {"dense": lambda: dense, "hybrid_rrf": lambda: rrf([dense, sparse], k)}
    odd = set(modes) - set(made)
    if odd or not modes:
        raise ValueError(f"modes are {', '.join(made)}")
    return union_all([made[mode]().withColumn("mode", F.lit(mode)) for mode in modes])


def restore_text(hits: DataFrame, corpus: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Hits with their text; null where the corpus lacks the id."""
    return hits.join(corpus.select(F.col(key).alias("chunk_id"), F.col(text).alias("text")), "chunk_id", "left")


def retrieve(spark, query: str, embedder, points: DataFrame, corpus: DataFrame, k: int = 10, query_filter: Mapping[str, str] | None = None, distance: str = "cosine") -> dict:
    """One query against a point table: chunks with score (6 places), text and payload, and the time taken.

    ``distance`` is that of the collection. ``points`` are read once: hits, k at most, come to the driver, and their
    payload is read by their ids alone. The result's keys are fixed values of its format.
    """
    began = time.perf_counter()
    vector = [float(x) for x in embedder.embed([query], is_query=True)[0]]
    embedded = time.perf_counter()
    asked = spark.createDataFrame([("q", vector)], "query_id string, embedding array<float>")
    ranked = dense_topk(asked, points, k, distance, query_filter).orderBy("rank").collect()
    hits = spark.createDataFrame(ranked, f"query_id string, rank int, chunk_id {points.schema['chunk_id'].dataType.simpleString()}, score double")
    ids = [r["chunk_id"] for r in ranked]
    payload = F.to_json(F.struct(*[F.col(c) for c in points.columns if c not in ("embedding", "vector", "point_id")])).alias("metadata")
    about = points.where(F.col("chunk_id").isin(ids)).select("chunk_id", payload)
    rows = restore_text(hits.join(about, "chunk_id", "left"), corpus.where(F.col("chunk_id").isin(ids))).orderBy("rank").collect()
    done = time.perf_counter()
    found = [{"chunk_id": r["chunk_id"], "score": round(r["score"], 6), "text": r["text"], "metadata": r["metadata"]} for r in rows]
    times = {"embedding_ms": (embedded - began) * 1000, "search_ms": (done - embedded) * 1000, "total_ms": (done - began) * 1000}
    return {"query": query, "retrieved_chunks": found, "latency_breakdown_ms": {n: round(t, 3) for n, t in times.items()}, "guardrail_preparation": {"top_k_requested": k, "results_returned": len(found), "filters_applied": dict(query_filter or {}) or None}}
