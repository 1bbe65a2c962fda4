"""Exact dense search that reads only what can win: vectors stored by cell, with bounds.

A k-means over a bounded sample gives the cells; every vector lies in the folder of its nearest centre, in blocks that
know their own mean and radius. Whatever a vector of a cell or block scores follows up to a bound from its centre's
score and its radius. A query is first scored in the cells of its best bounds, which gives it a k-th best score, and
then in the cells whose bound reaches that.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.frames import stored
from ..operators.retrieval import DISTANCES, HITS, Best, _scores, best_hits, kth_scores, query_blocks, usable

#: Vectors that the centres are fitted on, about, and cells, at most.
SAMPLE, CELLS = 100_000, 1024
#: Vectors of a block, at most.
BLOCK = 1 << 10
#: Bounds are compared with this much room for rounding, relative and absolute.
ROOM = 1e-6


class Read(NamedTuple):
    """What a search read: cells of all cells, (query, block) pairs scored of all pairs."""

    cells: int
    of_cells: int
    pairs: int
    of_pairs: int


def unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray, distance: str) -> np.ndarray:
    """The most that a vector within a radius of a centre can score for each query (larger is better).

    For ``cosine`` queries and vectors have length 1 or 0. Euclid by the triangle inequality, the others by that of
    Cauchy and Schwarz.
    """
    if distance == "euclid":
        far = np.sqrt(np.maximum((queries**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * queries @ centres.T, 0))
        return -np.maximum(far - radii[None, :], 0) + ROOM * (1 + far)
    size = np.linalg.norm(queries, axis=1)[:, None]
    most = queries @ centres.T + size * radii[None, :]
    return most + ROOM * (1 + size * (np.linalg.norm(centres, axis=1) + radii)[None, :])


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Lloyd's k-means from a seeded choice; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[: max(1, min(cells, len(sample)))]].copy()
    for _ in range(rounds):
        nearest = nearest_centre(sample, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_centre(matrix: np.ndarray, centres: np.ndarray, run: int = 1 << 12) -> np.ndarray:
    weights = (centres**2).sum(1)
    return np.concatenate([(weights[None, :] - 2 * matrix[at : at + run] @ centres.T).argmin(1) for at in range(0, len(matrix), run)] or [np.zeros(0, dtype=np.int64)])


class VectorCells:
    """Vectors of one dimension in a folder, for one distance. ``build`` writes it; the seed and the sample's size
    decide where a vector lies, never what is found.

    Vectors with a null, NaN or infinite element, of another dimension or without a key are left out.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.read = spark, path, Read(0, 0, 0, 0)

    def build(self, corpus: DataFrame, distance: str = "cosine", cells: int | None = None, dimension: int | None = None, key: str = "chunk_id", vector: str = "embedding", sample: int = SAMPLE, seed: int = 0) -> None:
        """``cells`` (None: the root of the number of vectors) of ``CELLS`` at most; ``dimension`` (None: of the first vector).

        The vectors move once, in ranges of cell and key, so that a cell with a third of them lies in many tasks.
        """
        if distance not in DISTANCES:
            raise ValueError(f"distance is one of {', '.join(DISTANCES)}")
        kind = corpus.schema[key].dataType
        rows = corpus.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and key is not null")
        if dimension is None:
            first = rows.where("size(v) > 0").select(F.size("v")).first()
            dimension = first[0] if first else 1
        n = rows.count()
        share = min(1.0, sample / max(1, n))
        drawn = rows.where((F.size("v") == dimension) & (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).select("v").limit(2 * sample).toArrow()
        matrix = usable(pa.array(range(len(drawn))), drawn.column("v").combine_chunks(), dimension)[1] if len(drawn) else np.zeros((0, dimension))
        matrix = unit(matrix) if distance == "cosine" else matrix
        wanted = min(CELLS, cells or max(1, round(n**0.5)))
        centres = fit_centres(matrix, wanted, seed=seed) if len(matrix) else np.zeros((1, dimension))
        shared = self.spark.sparkContext.broadcast(centres)
        arrow = to_arrow_type(kind)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, found = usable(batch.column(0), batch.column(1), dimension)
                near = nearest_centre(unit(found) if distance == "cosine" else found, shared.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * dimension, pa.int32()), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(keys, arrow), lists], names=["cell", "key", "v"])

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch.column(0).to_numpy()
                edges = np.flatnonzero(np.r_[True, np.diff(cell) != 0, True]) if len(cell) else np.zeros(1, dtype=np.int64)
                for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    for at in range(low, high, BLOCK):
                        some = batch.slice(at, min(BLOCK, high - at))
                        keys, found = usable(some.column(1), some.column(2), dimension)
                        placed = unit(found) if distance == "cosine" else found
                        centre = placed.mean(0)
                        radius = float(np.sqrt(((placed - centre) ** 2).sum(1).max()))
                        yield pa.RecordBatch.from_arrays([pa.array([int(cell[low])], pa.int32()), pa.array([len(keys)], pa.int32()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius]), pa.array([keys], pa.list_(arrow)), pa.array([found.reshape(-1)], pa.list_(pa.float64()))], names=["cell", "n", "centre", "radius", "keys", "vectors"])

        name = kind.simpleString()
        placed = stored(rows.mapInArrow(assign, f"cell int, key {name}, v array<double>"), "placed-vectors")
        blocks = placed.repartitionByRange("cell", "key").sortWithinPartitions("cell", "key").mapInArrow(block, f"cell int, n int, centre array<double>, radius double, keys array<{name}>, vectors array<double>")
        blocks.write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/blocks")
        self.spark.createDataFrame([(distance, dimension, name)], "distance string, dimension int, key string").coalesce(1).write.mode("overwrite").json(f"{self.path}/settings")

    def _cells(self, blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each cell's number, centre and radius, and its blocks: a cell's centre is the mean of its blocks' and its
        radius reaches around all of them. At most ``CELLS`` rows come to the driver."""
        parts = blocks.select("cell", "n", F.posexplode("centre").alias("at", "x")).groupBy("cell", "at").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
        middles = parts.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("c")).select("cell", F.col("c.x").alias("middle"))
        apart = F.sqrt(F.aggregate(F.zip_with("centre", "middle", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
        rows = blocks.join(F.broadcast(middles), "cell").groupBy("cell").agg(F.first("middle").alias("middle"), F.max(apart + F.col("radius")).alias("radius"), F.count("*").alias("blocks")).orderBy("cell").collect()
        return np.array([r["cell"] for r in rows]), np.array([r["middle"] for r in rows]), np.array([r["radius"] for r in rows]), np.array([r["blocks"] for r in rows])

    def search(self, queries: DataFrame, k: int = 30, query_key: str = "query_id", vector: str = "embedding", places: int | None = None, first: int = 2, block: int = 1 << 22) -> DataFrame:
        """As ``dense_topk`` over the stored vectors, with the same hits: exact, ties by key, ``places`` rounded first.

        Cells are read once in a first round (each query's ``first`` best) and once in a second, for each ``block``
        numbers of query vectors; in both, only those that a query needs. Tasks give only hits that reach the k-th
        best score of the first round. ``self.read`` tells what was read.
        """
        settings = self.spark.read.json(f"{self.path}/settings").first()
        distance, dimension = settings["distance"], settings["dimension"]
        layout = f"n int, centre array<double>, radius double, keys array<{settings['key']}>, vectors array<double>, cell int"
        blocks = self.spark.read.schema(layout).parquet(f"{self.path}/blocks")
        kind = blocks.schema["keys"].dataType.elementType
        schema = T.StructType([T.StructField("query_id", queries.schema[query_key].dataType), T.StructField("chunk_id", kind), T.StructField("score", T.DoubleType())])
        kinds = [to_arrow_type(f.dataType) for f in schema]
        numbers, centres, radii, counts = self._cells(blocks.select("cell", "n", "centre", "radius"))
        room = 0.0 if places is None else 10.0**-places
        scored = self.spark.sparkContext.accumulator(0)
        found, cells_read, n_queries = [], 0, 0

        def scan(keys: list, vectors: np.ndarray, needed: np.ndarray, least: np.ndarray | None) -> DataFrame:
            wanted = np.flatnonzero(needed.any(0))
            which = dict(zip(numbers[wanted].tolist(), (np.flatnonzero(needed[:, c]).astype(np.int32) for c in wanted.tolist()), strict=True))
            shared = self.spark.sparkContext.broadcast((keys, vectors, which, least))

            def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own_keys, own, asked, floor = shared.value
                best = Best(len(own_keys), k, floor)
                for batch in batches:
                    for at in range(batch.num_rows):
                        cell, radius = batch.column(0)[at].as_py(), batch.column(2)[at].as_py()
                        some = asked[cell]
                        centre = batch.column(1)[at].values.to_numpy()[None, :]
                        some = some[upper_bounds(own[some], centre, np.array([radius]), distance)[:, 0] + room >= best.cuts[some]]
                        if not len(some):
                            continue
                        ids = batch.column(3)[at].as_py()
                        matrix = batch.column(4)[at].values.to_numpy().reshape(len(ids), -1)
                        matrix = unit(matrix) if distance == "cosine" else matrix
                        for low in range(0, len(some), 1 << 12):
                            part = some[low : low + (1 << 12)]
                            scores = _scores(own[part], matrix, "dot" if distance == "cosine" else distance)
                            best.add(scores if places is None else np.round(scores, places), ids, part)
                        scored.add(len(some))
                yield from best.batches(own_keys, kinds)

            some = blocks.where(F.col("cell").isin(numbers[wanted].tolist())).select("cell", "centre", "radius", "keys", "vectors")
            return some.mapInArrow(look, schema)

        for keys, vectors in query_blocks(queries, query_key, vector, block, max(1, HITS // k)):
            if vectors.shape[1] != dimension:
                raise ValueError(f"the vectors have {dimension} dimensions, the queries {vectors.shape[1]}")
            vectors = unit(vectors.astype(np.float64)) if distance == "cosine" else vectors.astype(np.float64)
            if not len(numbers):
                continue
            n_queries += len(keys)
            bounds = upper_bounds(vectors, centres, radii, distance)
            early = np.zeros(bounds.shape, dtype=bool)
            np.put_along_axis(early, np.argsort(-bounds, axis=1)[:, :first], True, axis=1)
            tops = stored(scan(keys, vectors, early, None), "first-hits")
            least = kth_scores(tops, keys, k)
            late = (bounds + room >= least[:, None]) & ~early
            found.append(tops)
            if late.any():
                found.append(scan(keys, vectors, late, least))
            cells_read += int((early | late).any(0).sum())
        hits = stored(best_hits(found or [self.spark.createDataFrame([], schema)], k, distance), "hits")
        self.read = Read(cells_read, len(numbers), scored.value, n_queries * int(counts.sum()))
        return hits
