"""A collection of vector points as a Parquet table with versions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators.retrieval import DISTANCES, check_filter, dense_topk

#: A point's payload. Names of the point format.
PAYLOAD = ("parent_passage_id", "query_id", "language", "source_lang", "target_lang", "query_type", "chunk_strategy", "passage_index", "is_selected")


def as_points(chunks: DataFrame, vector: str = "embedding", also: Sequence[str] = ()) -> DataFrame:
    """point_id (uuid5 of the chunk id), chunk_id, the payload columns that are there, embedding, and the columns of ``also`` (such as an
    upsert's order). Never a text or an answer."""
    payload = [c for c in PAYLOAD if c in chunks.columns]
    return chunks.select(X.uuid5_url("chunk_id").alias("point_id"), "chunk_id", *payload, F.col(vector).cast("array<float>").alias("embedding"), *also)


def latest(rows: DataFrame, key: str = "point_id", version: str = "version") -> DataFrame:
    """The last version of each key; the key's other versions are ranked no further than the first place."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


#: Columns whose values have folders of their own inside a version, so that a filter on them reads no other's files.
ROUTED = ("chunk_strategy", "language", "query_type")
#: Pairs of superseded points that are sent to every task, at most; more are joined by a shuffle.
SENT = 1 << 21
#: Version numbers between two batches of a stream: room for the merges after a batch.
STEP = 32


class VectorCollection:
    """Points in a folder: each upsert appends a version, readers see the last of each point.

    Appending keeps an upsert from rewriting the collection, and repeating one (after a failure) changes
    nothing, since ids are derived from chunk ids and the version is the caller's. An upsert notes which points of
    which versions it supersedes, from ids alone, and readers leave those out, so that vectors stay where they lie and
    filters prune folders however many versions there are.

    ``distance`` and ``dimension`` (None: any; what every vector has to have) are kept with the collection. One that is
    opened again has its own distance, and refuses another; a dimension may be given for checks of one's own.
    """

    def __init__(self, spark: SparkSession, path: str, distance: str | None = None, create: bool = False, dimension: int | None = None):
        if distance is not None and distance not in DISTANCES:
            raise ValueError(f"distance is one of {', '.join(DISTANCES)}")
        self.spark, self.path = spark, path
        hadoop, system = self._folder()
        if create:
            system.delete(hadoop, True)
            system.mkdirs(hadoop)
            spark.createDataFrame([(json.dumps({"distance": distance or "cosine", "dimension": dimension}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_settings")
        elif not system.exists(hadoop):
            raise ValueError(f"there is no collection at {path}; build it first or pass create=True")
        kept = {"distance": "cosine", "dimension": None}
        if system.exists(self._path("_settings")):
            kept |= json.loads(spark.read.text(f"{path}/_settings").first()["value"])
        if distance is not None and distance != kept["distance"]:
            raise ValueError(f"the collection at {path} has distance {kept['distance']}, not {distance}")
        self.distance, self.dimension = kept["distance"], kept["dimension"] if dimension is None else dimension

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _folder(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop, hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The versions that are written whole; what a failed write left isn't read."""
        folder, system = self._folder()
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        numbers = sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))
        return [n for n in numbers if system.exists(self._path(f"version={n}/_SUCCESS"))]

    def _write(self, points: DataFrame, version: int) -> None:
        folders = {f"by_{c}": F.concat(F.lit("v_"), F.coalesce(c, F.lit(""))) for c in ROUTED if c in points.columns}
        points.withColumns(folders).write.mode("overwrite").partitionBy(*folders).parquet(f"{self.path}/version={version}")

    def _rows(self, versions: Sequence[int]) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("version").isin(list(versions)))

    def _ids(self) -> DataFrame:
        return self._rows(self.versions()).select("point_id", F.col("version").cast("long").alias("version"))

    def _note_superseded(self, version: int) -> None:
        """Of the points that this version shares with others, the older version of each pair. Ids alone move."""
        ids = self._ids()
        own, others = ids.where(F.col("version") == version).select("point_id"), ids.where(F.col("version") != version)
        older = others.join(own, "point_id", "left_semi").select("point_id", F.least("version", F.lit(version)).alias("version")).distinct()
        older.write.mode("overwrite").parquet(f"{self.path}/_superseded/by={version}")

    def upsert(self, points: DataFrame, version: int, order: str | None = None) -> None:
        """Add points; a point's last version wins. A version that is written again replaces itself.

        ``order`` names a column by which the last of a point's rows in this batch wins; without it a batch
        has to have each point once, or equal rows of it.
        """
        once = points.dropDuplicates(["point_id"]) if order is None else latest(points, "point_id", order).drop(order)
        if self.dimension is not None:
            wrong = F.raise_error(F.concat(F.lit(f"the collection has vectors of {self.dimension}, not "), F.size("embedding").cast("string"))).cast("array<float>")
            once = once.withColumn("embedding", F.when(F.size("embedding") == self.dimension, F.col("embedding")).otherwise(wrong))
        self._write(once, version)
        if len(self.versions()) > 1:
            self._note_superseded(version)

    def superseded(self) -> DataFrame | None:
        """``point_id, version`` of points that a newer version has, None where none is noted."""
        if len(self.versions()) < 2 or not self._folder()[1].exists(self._path("_superseded")):
            return None
        noted = self.spark.read.parquet(f"{self.path}/_superseded")
        return noted.where(F.col("by").isin(self.versions())).select("point_id", "version").distinct()

    def upsert_batch(self, points: DataFrame, number: int, order: str | None = None) -> None:
        """``upsert`` of a stream's batch (numbers from 0), after which versions are merged by powers of two: n batches leave
        as many versions as n has ones in binary, and a point is written again log n times at most.

        A batch that is run again after a failure ends in the same state: a merge that is whole isn't made anew, what it
        replaced goes, and until then readers leave the replaced points out.
        """
        version = (number + 1) * STEP
        self.upsert(points, version, order)
        level = ((number + 1) & -(number + 1)).bit_length() - 1
        if level:
            self._merge((number + 1 - (1 << level)) * STEP + STEP - 1, version + level)

    def _merge(self, after: int, into: int) -> None:
        """Write what the versions after one and before another hold as that other one, and drop them."""
        versions = self.versions()
        older = [v for v in versions if after < v < into]
        if into not in versions:
            self._write(self.points(versions=older), into)
        self._note_superseded(into)
        system = self._folder()[1]
        for number in older:
            system.delete(self._path(f"version={number}"), True)
            system.delete(self._path(f"_superseded/by={number}"), True)
        self._note_superseded(into)

    def points(self, query_filter: Mapping[str, str] | None = None, versions: Sequence[int] | None = None) -> DataFrame:
        """The last version of each point (of some versions'); with ``query_filter`` those whose columns have the given values.

        Filters name folders, before anything is joined. Up to ``SENT`` superseded points are sent to the tasks, which
        then need no shuffle; a filter looks at a point's last version alone.
        """
        given, rows = check_filter(query_filter), self._rows(self.versions() if versions is None else versions)
        folders = [c for c in rows.columns if c.startswith("by_")]
        for name, value in given.items():
            rows = rows.where(F.col(name) == value)
            rows = rows.where(F.col(f"by_{name}") == f"v_{value}") if f"by_{name}" in folders else rows
        old = self.superseded()
        if old is not None:
            old = F.broadcast(old) if self.spark.read.parquet(f"{self.path}/_superseded").count() <= SENT else old
            rows = rows.join(old, ["point_id", "version"], "left_anti")
        return rows.drop("version", *folders)

    def count(self) -> int:
        return self.points().count()

    def compact(self, version: int) -> None:
        """Write the current points as one version, newer than all others, and drop those."""
        older = self.versions()
        if older and version <= older[-1]:
            raise ValueError(f"version {version} isn't newer than {older[-1]}")
        self._write(self.points(), version)
        if older:
            self._note_superseded(version)
        folder, system = self._folder()
        for number in older:
            system.delete(self._path(f"version={number}"), True)
        system.delete(self._path("_superseded"), True)

    def search(self, queries: DataFrame, k: int = 30, query_filter: Mapping[str, str] | None = None, places: int | None = None) -> DataFrame:
        """Top k of each query; only routing columns may filter. For ``places`` see ``dense_topk``."""
        return dense_topk(queries, self.points(query_filter), k, self.distance, places=places)
