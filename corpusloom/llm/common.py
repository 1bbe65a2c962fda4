"""Helpers that several operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.frames import shared_folder, union_all


def checkpoint(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def send(spark: SparkSession, value) -> tuple[Broadcast, Callable[[], object]]:
    """Broadcast a value of any class of this library, and what gives it in a task. The class goes by value, as functions
    do, so that workers need no copy of the library."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return shared, lambda: pickle.loads(shared.value)


#: Rows of keys and numbers that are sent to every task, at most; more are joined by a shuffle.
SENT = 1 << 20


def sent(rows: DataFrame) -> DataFrame:
    """Narrow stored rows, marked for sending where they are counted to be few enough."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def without(docs: DataFrame, components: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` but those of a key that is nowhere its own component; the few keys that go are what is joined, and
    where they are few enough no text moves."""
    kept = F.max(F.col(key).eqNullSafe(F.col("component")).cast("int"))
    lost = checkpoint(components.groupBy(key).agg(kept.alias("kept")).where("kept = 0").select(F.col(key).alias("__loom_lost")))
    return docs.join(sent(lost), F.col(key).eqNullSafe(F.col("__loom_lost")), "left_anti")


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column's values."""
    return column.cast(pa.binary()).to_pylist()


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """As ``utf8``, one value at a time."""
    for value in column.cast(pa.binary()):
        yield value.as_py()


def row_slices(batch: pa.RecordBatch, text: str | int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most_bytes`` of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // most_bytes
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.array([], dtype=np.int64)
    for start, end in zip(starts, np.r_[starts[1:], len(group)], strict=True):
        yield batch.slice(int(start), int(end - start))


def key_type(docs: DataFrame, key: str) -> tuple[str, pa.DataType]:
    """The type of a key column, as Spark's DDL and as Arrow's; operators keep it."""
    kind = docs.schema[key].dataType
    return kind.simpleString(), to_arrow_type(kind)


def records(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    """A batch from one sequence per field of ``schema``."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Links that a task takes, about; so many or fewer are sent instead of shuffled.
LINKS = 1 << 16


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``: long); root is the component's smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a map-side combined minimum
    and an equality join. Edges are the only state; each round is checkpointed and nothing but two
    numbers comes to the driver. A round never has more edges than the one before, so the counted edges say how many
    partitions the next state needs: a task leaves files for each shuffle, however few its rows are. Self-links keep a
    node as its own root; null ends are dropped.
    """
    both = checkpoint(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    count, seen = both.count(), None
    both = both.coalesce(count // LINKS + 1)
    current = both.where("u > v")
    while True:
        few = F.broadcast if count <= LINKS else lambda rows: rows
        mirrored = _each(current, ("u", "v"), ("v", "u"))
        least = mirrored.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = mirrored.join(few(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = _each(large.join(few(lowest), "u"), ("u", "m"), ("v", "m")).where("u <> v").distinct()
        current = checkpoint(linked.coalesce(count // LINKS + 1))
        state = tuple(current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            break
        count, seen = state[0], state
    ended = union_all([current, both.where("u = v")])
    return _each(ended, ("u", "v"), ("v", "v")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """``u, v``: a row for each of the pairs of columns, from one reading of ``rows``."""
    both = F.array(*[F.struct(F.col(one).alias("u"), F.col(two).alias("v")) for one, two in pairs])
    return rows.select(F.explode(both).alias("pair")).select("pair.u", "pair.v")
