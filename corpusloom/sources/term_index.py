"""A stored inverted index: a corpus is split into words once, and BM25 searches read the postings of their words only.

Rows of a task are taken in shards of bounded size. A shard gives one block a word (its rows' places and counts,
the largest count and the smallest row, from which no row of the block can gain more) and one block of the empty
word with all its rows' keys and sizes. Blocks lie sorted by word, so Parquet's statistics keep a search for few
words to the pages that hold them; nothing is shuffled to build the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window
from pyspark.taskcontext import TaskContext

from ..functions import text as X
from ..functions.frames import stored, union_all

#: Rows and words of a shard, at most; a row of more words is a shard of its own.
ROWS, WORDS = 1 << 16, 1 << 21
#: Rows that are looked at together while a shard fills.
RUN = 1 << 10
#: Distinct words up to which a search names them in the scan's filter; beyond, a semi-join finds their blocks.
NAMED = 256
#: Query words that a task scores together, at most, for one shard.
ASKED = 200_000
#: Bounds are compared with this much room for rounding.
ROOM = 1e-6


class Statistics(NamedTuple):
    """``df``: rows (term, df); the number of rows, their mean length in words, the mean idf over all words."""

    df: DataFrame
    rows: int
    mean_size: float
    mean_idf: float


def _schema(key: T.DataType) -> T.StructType:
    names = [("shard", T.LongType()), ("term", T.StringType()), ("df", T.IntegerType()), ("words", T.LongType()), ("most", T.IntegerType()), ("least_size", T.IntegerType())]
    arrays = [("places", T.IntegerType()), ("counts", T.IntegerType()), ("sizes", T.IntegerType()), ("keys", key)]
    return T.StructType([*(T.StructField(n, t) for n, t in names), *(T.StructField(n, T.ArrayType(t)) for n, t in arrays)])


def _blocks(keys: pa.Array, words: pa.Array, sizes: np.ndarray, shard: int, schema: pa.Schema, most: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The blocks of a shard: all rows' keys and sizes, then each word's, in the order of the words' bytes."""
    rows = len(sizes)
    none = [pa.nulls(1, schema.field(n).type) for n in ("places", "counts")]
    own = [pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), v) for v in (pa.array(sizes, pa.int32()), keys)]
    first = [pa.array([v], schema.field(n).type) for n, v in (("shard", shard), ("term", ""), ("df", rows), ("words", int(sizes.sum())), ("most", 0), ("least_size", 0))]
    yield pa.RecordBatch.from_arrays([*first, *none, *own], schema=schema)
    if not len(words):
        return
    coded = words.dictionary_encode()
    del words
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    # a number for each word of the shard, in place: these arrays are most of what a task holds
    pairs = rank[coded.indices.to_numpy()]
    terms = coded.dictionary.take(pa.array(order))
    del coded, order, rank
    pairs *= rows
    pairs += np.repeat(np.arange(rows, dtype=np.int32), sizes)
    pairs.sort()
    heads = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]).astype(np.int32)
    counts = np.diff(heads, append=np.int32(len(pairs)))
    pairs = pairs[heads]
    del heads
    term = (pairs // rows).astype(np.int32)
    pairs %= rows
    place = pairs.astype(np.int32)
    del pairs
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    ends = np.r_[starts[1:], len(term)]
    largest, smallest = np.maximum.reduceat(counts, starts), np.minimum.reduceat(sizes[place], starts)
    for at in range(0, len(starts), most):
        some = slice(at, at + most)
        low, high, n = int(starts[at]), int(ends[some][-1]), len(starts[some])
        offsets = pa.array(np.r_[starts[some], high] - low, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[low:high], pa.int32())) for v in (place, counts)]
        columns = [pa.repeat(pa.scalar(shard, pa.int64()), n), terms.slice(at, n), pa.array(ends[some] - starts[some], pa.int32()), pa.repeat(pa.scalar(0, pa.int64()), n), pa.array(largest[some], pa.int32()), pa.array(smallest[some], pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, *lists, pa.nulls(n, schema.field("sizes").type), pa.nulls(n, schema.field("keys").type)], schema=schema)


def _build(schema: pa.Schema, rows: int, words: int):
    """Batches of (key, words) to blocks; a task's shards are numbered within it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
        n_rows = n_words = 0

        def taken() -> tuple[pa.Array, pa.Array, np.ndarray]:
            """What is held, which then is held no more."""
            own = tuple(pa.concat_arrays([h[i] for h in held]) for i in (0, 1)), np.concatenate([h[2] for h in held])
            held.clear()
            return *own[0], own[1]

        def shard() -> Iterator[pa.RecordBatch]:
            yield from _blocks(*taken(), base + number, schema)
            pa.default_memory_pool().release_unused()

        for whole in batches:
            sizes = pc.list_value_length(whole.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(sizes):
                run = np.cumsum(sizes[at : at + min(RUN, rows - n_rows)])
                fits = int(np.searchsorted(run, words - n_words, side="right"))
                if not fits and not held:
                    fits = 1
                if fits:
                    some = whole.slice(at, fits)
                    held.append((some.column(0), some.column(1).flatten(), sizes[at : at + fits]))
                    n_rows, n_words, at = n_rows + fits, n_words + int(run[fits - 1]), at + fits
                if n_rows >= rows or fits < len(run):
                    yield from shard()
                    n_rows, n_words, number = 0, 0, number + 1
        if held:
            yield from shard()

    return scan


def gain(count, size, mean: float, k1: float, b: float):
    """What a word's count in a row of some size gives, before its weight; columns or arrays. It rises with the count and falls with the size."""
    return count * (k1 + 1) / (count + k1 * (1 - b + b * size / mean))


def _score(k: int, mean: float, k1: float, b: float, every: bool, kinds: list[pa.DataType]):
    """One shard: the blocks of the words asked for and (query, term, weight) rows to each query's best k rows."""

    def score(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        terms = blocks.column("term").to_pylist()
        whole = terms.index("")
        keys = blocks.column("keys")[whole].as_py()
        sizes = np.asarray(blocks.column("sizes")[whole].values)
        order = np.empty(len(keys), dtype=np.int64)
        order[sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i]))] = np.arange(len(keys))
        own = {}
        for at, term in enumerate(terms):
            if at != whole:
                places = np.asarray(blocks.column("places")[at].values)
                own[term] = (places, gain(np.asarray(blocks.column("counts")[at].values), sizes[places], mean, k1, b))
        by: dict = {}
        for query, term, weight in zip(*(asked.column(c).to_pylist() for c in ("query_id", "term", "weight")), strict=True):
            by.setdefault(query, []).append((term, weight))
        scores, found = np.zeros(len(keys)), ([], [], [])
        for query, words in by.items():
            hit = [np.arange(len(keys))] if every else []
            for term, weight in sorted(words):
                if term in own:
                    places, gains = own[term]
                    scores[places] += weight * gains
                    hit.append(places)
            if not hit:
                continue
            places = np.unique(np.concatenate(hit))
            rounded = np.round(scores[places], 9)
            scores[places] = 0
            if not every:
                places, rounded = places[rounded > 0], rounded[rounded > 0]
            if len(places) > k:
                near = rounded >= np.partition(rounded, len(rounded) - k)[len(rounded) - k]
                places, rounded = places[near], rounded[near]
            best = np.lexsort((order[places], -rounded))[:k]
            found[0].extend([query] * len(best))
            found[1].extend(keys[i] for i in places[best].tolist())
            found[2].extend(rounded[best].tolist())
        return pa.table([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], names=["query_id", "chunk_id", "score"])

    return score


class TermIndex:
    """An inverted index in a folder. ``add`` writes a segment and replaces the one of that number, so that adding
    a batch again, after a failure, changes nothing; searches are over all segments.

    Keys of any type with an order, different ones for different rows; null texts are rows without words.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, corpus: DataFrame, segment: int = 0, key: str = "chunk_id", text: str = "text", rows: int = ROWS, words: int = WORDS) -> None:
        """Index the rows of ``corpus`` where they lie; its texts are read once."""
        kind = corpus.schema[key].dataType
        schema = _schema(kind)
        arrow = pa.schema([(f.name, pa.list_(to_arrow_type(f.dataType.elementType)) if isinstance(f.dataType, T.ArrayType) else to_arrow_type(f.dataType)) for f in schema])
        made = corpus.select(F.col(key).alias("key"), X.lower_words(text).alias("words")).mapInArrow(_build(arrow, rows, words), schema)
        # small row groups: a search reads those that may hold its words
        made.write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{self.path}/segment={segment}")

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def statistics(self) -> Statistics:
        """Of all segments, from the blocks' narrow columns; three numbers come to the driver."""
        rows = self.blocks().select("term", "df", "words")
        df = rows.where("term <> ''").groupBy("term").agg(F.sum("df").alias("df"))
        sums = rows.where("term = ''").agg(F.sum("df").alias("n"), F.sum("words").alias("words")).first()
        n = sums["n"] or 0
        idf = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean_idf = df.agg(F.avg(idf)).first()[0] or 0.0
        return Statistics(df, n, (sums["words"] or 0) / n if n and sums["words"] else 1.0, float(mean_idf))

    def weights(self, queries: DataFrame, statistics: Statistics, epsilon: float = 0.25, query_key: str = "query_id", text: str = "text") -> DataFrame:
        """``query_id, term, weight`` of the query words that the corpus has: idf times the word's count in the query. An
        idf below 0 is replaced by ``epsilon`` times the mean idf."""
        asked = queries.select(F.col(query_key).alias("query_id"), F.explode(X.lower_words(text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        idf = F.log(F.lit(float(statistics.rows)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        return asked.join(statistics.df, "term").select("query_id", "term", (F.when(idf < 0, epsilon * statistics.mean_idf).otherwise(idf) * F.col("times")).alias("weight"))

    def _of(self, terms: DataFrame, columns: list[str]) -> DataFrame:
        """The blocks of some words; few words are named in the scan's filter, which then skips pages."""
        rows = self.blocks().select("segment", "shard", "term", *columns)
        named = [r[0] for r in terms.limit(NAMED + 1).collect()]
        if len(named) <= NAMED:
            return rows.where(reduce(lambda a, b: a | b, [F.col("term") == t for t in named], F.lit(False)))
        return rows.join(terms, "term", "left_semi")

    def search(self, queries: DataFrame, k: int = 30, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, query_key: str = "query_id", text: str = "text", first: int = 2, asked: int = ASKED) -> DataFrame:
        """``query_id, rank, chunk_id, score``: the exact Okapi BM25 top k; equal scores (to 9 places) go by key.

        Rows without any word of a query fill up to k with score 0, smallest keys first (null keys don't fill). From each
        word's largest count and smallest row in a shard follows what no row of the shard can exceed. A query is scored
        in its ``first`` shards of the highest bounds, which gives it a k-th best score, and then only in shards whose
        bound reaches that. Where most words are in over half of the rows (the mean idf is below 0, so that rows without
        the words may win), all rows are scored.
        """
        known = self.statistics()
        weights = self.weights(queries, known, epsilon, query_key, text)
        every = known.mean_idf < 0
        if every:
            ids = queries.select(F.col(query_key).alias("query_id")).distinct()
            weights = union_all([weights, ids.select("query_id", F.lit("").alias("term"), F.lit(0.0).alias("weight"))])
        weights = stored(weights, "query-weights")
        terms = weights.select("term").distinct()
        most = F.greatest(F.lit(0.0), F.col("weight") * gain(F.col("most"), F.col("least_size"), known.mean_size, k1, b))
        bounds = self._of(terms, ["most", "least_size"]).join(weights, "term").groupBy("query_id", "segment", "shard").agg(F.sum(most).alias("bound"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "shard"))
        bounds = stored(bounds.withColumn("place", place), "shard-bounds")
        parts = max(1, -(-weights.count() // asked))
        kinds = [to_arrow_type(queries.schema[query_key].dataType), to_arrow_type(self.blocks().schema["keys"].dataType.elementType), pa.float64()]
        schema = T.StructType([T.StructField("query_id", queries.schema[query_key].dataType), T.StructField("chunk_id", self.blocks().schema["keys"].dataType.elementType), T.StructField("score", T.DoubleType())])

        def scored(pairs: DataFrame) -> DataFrame:
            """Each query's best k of each shard that it is paired with. A shard's blocks meet in one task, once for
            each ``asked`` query words."""
            wanted = pairs.join(weights, "query_id").withColumn("part", F.pmod(F.hash("query_id"), F.lit(parts)))
            words = union_all([wanted.select("segment", "shard", "part", "term"), wanted.select("segment", "shard", "part", F.lit("").alias("term"))]).distinct()
            needed = union_all([terms, self.spark.range(1).select(F.lit("").alias("term"))]).distinct()
            group = ["segment", "shard", "part"]
            blocks = self._of(needed, ["places", "counts", "sizes", "keys"]).join(words, ["segment", "shard", "term"])
            blocks = blocks.select(*[F.col(c).alias(f"block_{c}") for c in group], "term", "places", "counts", "sizes", "keys")
            run = _score(k, known.mean_size, k1, b, every, kinds)
            return blocks.groupBy(*[f"block_{c}" for c in group]).cogroup(wanted.select(*group, "query_id", "term", "weight").groupBy(*group)).applyInArrow(lambda left, right: run(left, right), schema)

        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        tops = stored(scored(bounds.where(F.col("place") <= first)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "first-hits")
        least = tops.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = bounds.where(F.col("place") > first).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - ROOM))
        hits = union_all([tops.drop("rank"), scored(rest.select("query_id", "segment", "shard"))])
        hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return hits.select("query_id", "rank", "chunk_id", "score") if every else self._filled(hits, queries.select(F.col(query_key).alias("query_id")).distinct(), k)

    def _filled(self, hits: DataFrame, ids: DataFrame, k: int) -> DataFrame:
        """Hits, and for queries of fewer than k the smallest keys of other rows. A query has at most k - 1 hits then, so
        some of the 2k smallest keys are left for every place."""
        hits = stored(hits, "hits")
        smallest = self.blocks().where("term = ''").select(F.explode("keys").alias("key")).where("key is not null").orderBy("key").limit(2 * k).agg(F.array_sort(F.collect_list("key")).alias("keys"))
        own = hits.groupBy("query_id").agg(F.collect_list("chunk_id").alias("own"))
        short = ids.join(own, ids["query_id"].eqNullSafe(own["query_id"]), "left").select(ids["query_id"], F.coalesce("own", F.array().cast(T.ArrayType(hits.schema["chunk_id"].dataType))).alias("own"))
        short = short.where(F.size("own") < k).crossJoin(smallest)
        free = F.slice(F.array_except("keys", "own"), F.lit(1), k - F.size("own"))
        filled = short.select("query_id", F.size("own").alias("n"), F.posexplode(free).alias("at", "chunk_id"))
        more = filled.select("query_id", (F.col("n") + F.col("at") + 1).cast("int").alias("rank"), "chunk_id", F.lit(0.0).alias("score"))
        return union_all([hits.select("query_id", "rank", "chunk_id", "score"), more])
