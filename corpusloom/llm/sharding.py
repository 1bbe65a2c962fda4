"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by leading bits of a key's hash. A bucket over the byte limit splits on its next bit and
no other does, so shards differ in depth and all fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import union_all
from .common import checkpoint

#: Bits of the hash, as many as fit a positive long with whole hex digits.
BITS = 60


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; a null key is the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _prefix(hash_: str | Column, bits: int | Column, of: int | Column = BITS) -> Column:
    """The leading ``bits`` of a number of ``of`` bits."""
    hash_ = F.col(hash_) if isinstance(hash_, str) else hash_
    return F.call_function("shiftright", hash_, (of if isinstance(of, Column) else F.lit(of)) - (bits if isinstance(bits, Column) else F.lit(bits)))


def _cells(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """``cell, depth`` and the totals of each ``high``-bit prefix; depth is over ``high`` where it must split on."""
    cell = _prefix("hash", high).alias("cell")
    cells = rows.groupBy(cell).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.min("hash").alias("least"), F.max("hash").alias("most"))
    cells = checkpoint(cells)
    above = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", _prefix("cell", F.col("depth"), high))
    full = above.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("least").alias("least"), F.max("most").alias("most"))
    full = full.where((F.col("bytes") > limit) & (F.col("least") < F.col("most"))).select("depth", "prefix")
    deepest = above.join(full, ["depth", "prefix"], "left_semi").groupBy("cell").agg((F.max("depth") + 1).alias("depth"))
    return checkpoint(cells.join(deepest, "cell", "left").select("cell", F.coalesce("depth", F.lit(low)).alias("depth"), "bytes", "docs"))


def shards(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, shard, local_depth, shard_bytes, shard_docs, oversized``: one row for each row of ``docs``.

    ``shard`` is the bucket's hash prefix in binary digits, empty at depth 0. Bytes are the texts' UTF-8
    bytes; null texts have none. Every shard has at most ``limit`` bytes unless all its rows share one hash:
    rows with the same key can't be told apart by hashing, stay together and are flagged ``oversized``, as is
    a single larger document. All rows are read once, as (hash, bytes); totals are added up at one prefix
    length a little finer than the limit needs, every level of the directory comes from those, and only rows
    of buckets that are still too large go on to longer prefixes. An empty table has no shards.
    """
    rows = checkpoint(docs.select(F.col(key).alias("key"), key_hash(F.col(key)).alias("hash"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("bytes")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 3)
    pending, placed = rows, []
    while True:
        cells = _cells(pending, low, high, limit)
        settled = cells.where(F.col("depth") <= high) if high < BITS else cells.withColumn("depth", F.least("depth", F.lit(BITS)))
        shard = settled.withColumn("prefix", _prefix("cell", F.col("depth"), high))
        sizes = shard.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        named = shard.join(sizes, ["depth", "prefix"]).select("cell", "depth", "prefix", "shard_bytes", "shard_docs")
        placed.append(pending.withColumn("cell", _prefix("hash", high)).join(named, "cell"))
        rest = cells.where(F.col("depth") > high).select("cell")
        if high == BITS or rest.isEmpty():
            break
        pending = checkpoint(pending.withColumn("cell", _prefix("hash", high)).join(rest, "cell", "left_semi").drop("cell"))
        low, high = high + 1, min(BITS, high + 8)
    every = union_all(placed)
    digits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return every.select(F.col("key").alias(key), digits.alias("shard"), F.col("depth").cast("int").alias("local_depth"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized"))
