"""Helpers over whole DataFrames."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns by name.

    Spark 4.1 lets a union of equally partitioned inputs stand for one partitioned input, and then groups or
    joins it without a shuffle though the inputs' partitions don't match: rows of one key stay apart and
    results are wrong. That rule is switched off for the session; a union then says nothing of its layout.
    """
    if not frames:
        raise ValueError("no frame is given")
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(lambda a, b: a.unionByName(b), frames)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session's driver and executors share (``spark.checkpoint.dir``). Where none is named a local
    session, as in tests, gets its own; a cluster, whose executors can't see the driver's folders, is refused."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="corpusloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that later steps read again; it goes when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)
    system.deleteOnExit(hadoop)
    return path


def stored(frame: DataFrame, name: str) -> DataFrame:
    """A frame written once and read again, so that what uses it twice computes it once."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def running_total(frame: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column, name: str) -> DataFrame:
    """``frame`` with the sum of ``weight`` (whole numbers) over the rows before each in its group, in ``order``.

    Rows are sorted in ranges of (by, order), so a group that most rows belong to lies in many tasks; what
    meets across the ranges is one number for each range of a group. Pass narrow frames: every column is stored.
    """
    shared_folder(frame.sparkSession)
    ranged = frame.withColumn("_weight", weight.cast("long")).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    own = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn(name, F.coalesce(F.sum("_weight").over(own), F.lit(0)))
    same = F.col("_range") == F.col("_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return placed.join(offsets, same).withColumn(name, F.col(name) + F.col("_offset")).select(*frame.columns, name)
