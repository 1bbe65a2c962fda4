"""Resumable building of a vector collection from a folder of chunk files, as a Structured Streaming job."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.retrieval import embed, get_embedder
from ..sources.tables import with_place
from ..sources.vector_store import VectorCollection, as_points


def compatible(stored: dict, run: dict) -> bool:
    """Whether a stored run can be resumed: same corpus, model, collection and batch size, on a CPU or MPS device,
    and the files that the corpus had then are still as they were (others may have been appended)."""
    same = all(stored.get(k) == run.get(k) for k in ("corpus", "model", "collection", "batch_size"))
    return same and stored.get("device") in ("mps", "cpu") and set(stored.get("files", ())) <= set(run.get("files", ()))


def listing(spark: SparkSession, path: str) -> list[str]:
    """Name, bytes and time of each data file under ``path``: what an overwritten corpus can't have in common with the old one."""
    folder, system = _settings(spark, path)
    found, files = [], system.listFiles(folder, True)
    while files.hasNext():
        status = files.next()
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            found.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return sorted(found)


def _settings(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def build_index(spark: SparkSession, corpus: str, collection: str, progress: str, model: str = "TEST_ONLY:dim256", device: str = "cpu", batch_files: int = 16) -> int:
    """Embed and upsert the chunk files of ``corpus`` that earlier runs haven't, in batches of ``batch_files`` files.

    Batches' versions are merged by powers of two as they come, so that many batches leave few versions. Of a chunk's rows in one batch the last in file order wins; later batches win over earlier ones. The stream's checkpoint in ``progress`` notes a batch after its upsert. A batch that is run again writes
    the same version again, so an interrupted build goes on where it stopped and nothing counts twice. An
    incompatible earlier run, or one over files that have changed since, is dropped, and the collection made
    anew. Returns the number of points.
    """
    run = {"corpus": corpus, "model": model, "collection": collection, "device": device, "batch_size": batch_files, "files": listing(spark, corpus)}
    folder, system = _settings(spark, progress)
    note, _ = _settings(spark, f"{progress}/run")
    resumes = False
    if system.exists(note):
        resumes = compatible(json.loads(spark.read.text(f"{progress}/run").first()["value"]), run)
    if not resumes:
        system.delete(folder, True)
    spark.createDataFrame([(json.dumps(run),)], "value string").coalesce(1).write.mode("overwrite").text(f"{progress}/run")
    embedder = get_embedder(model, device)
    target = VectorCollection(spark, collection, create=not resumes, dimension=embedder.dimension)

    def upsert(batch: DataFrame, number: int) -> None:
        rows = embed(batch, embedder)
        target.upsert_batch(as_points(rows, also=["place"]), number, order="place")

    schema = spark.read.parquet(corpus).schema
    stream = with_place(spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_files).parquet(corpus), "place")
    query = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{progress}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return target.count()
