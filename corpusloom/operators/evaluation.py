"""Retrieval metrics over ranked rows (query_id, rank, chunk_id) and relevance rows (query_id, chunk_id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import running_total


#: Values of ``by`` in an evaluation, at most: modes, models, strategies and the like.
MOST_KINDS = 256


def relevant_ids(by_strategy: str | Column, strategy: str | None = None) -> Column:
    """Chunk ids of a benchmark row's map, of one strategy or of all."""
    ids = F.map_values(by_strategy) if strategy is None else F.array(F.element_at(by_strategy, F.lit(strategy)))
    return F.array_distinct(F.flatten(F.filter(ids, lambda x: x.isNotNull())))


def relevance(benchmark: DataFrame, strategy: str | None = None) -> DataFrame:
    """``query_id, chunk_id`` from benchmark rows; a query without ids has no row and isn't evaluated."""
    return benchmark.select("query_id", F.explode(relevant_ids("ground_truth_chunk_ids_by_strategy", strategy)).alias("chunk_id")).distinct()


def ideal_dcg(relevant: Column, k: int) -> Column:
    """DCG of as many hits at the top as there are relevant ids, k at most."""
    return F.aggregate(F.sequence(F.lit(1), F.least(relevant, F.lit(k)).cast("int")), F.lit(0.0), lambda total, i: total + 1 / F.log2(i + 1.0))


def per_query(ranked: DataFrame, relevant: DataFrame, ks: Sequence[int] = (1, 3, 5, 10), mrr_k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """One row for each evaluated query (and each value of ``by``, such as mode): recall, hit, MRR and nDCG.

    Queries with relevant ids but no hit count zeros. ``by`` columns are of ``ranked``, of ``MOST_KINDS`` values at most.
    """
    last = max(*ks, mrr_k)
    sizes = relevant.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n_relevant"))
    hits = ranked.where(F.col("rank") <= last).join(relevant.distinct(), ["query_id", "chunk_id"], "left_semi").select("query_id", *by, "rank")
    if by:
        # a row for each query and value of ``by``: its distinct values are few, come to the driver and back as literals
        kinds = ranked.select(*by).distinct().limit(MOST_KINDS + 1).collect()
        if len(kinds) > MOST_KINDS:
            raise ValueError(f"{', '.join(by)} have more than {MOST_KINDS} values")
        every = [F.struct(*[F.lit(r[c]).cast(ranked.schema[c].dataType).alias(c) for c in by]) for r in kinds]
        kind = F.array(*every) if every else F.array().cast(T.ArrayType(ranked.select(*by).schema))
        sizes = sizes.withColumn("_kind", F.explode(kind)).select("query_id", "n_relevant", "_kind.*")
    joined = sizes.join(hits, ["query_id", *by], "left")
    rank, n = F.col("rank"), F.col("n_relevant")
    top = max(ks)
    metrics = []
    for k in ks:
        metrics += [(F.count_if(rank <= k) / n).alias(f"recall_{k}"), F.coalesce(F.max(F.when(rank <= k, 1.0)), F.lit(0.0)).alias(f"hit_{k}")]
    metrics += [F.coalesce(1 / F.min(F.when(rank <= mrr_k, rank)), F.lit(0.0)).alias(f"mrr_{mrr_k}"), (F.coalesce(F.sum(F.when(rank <= top, 1 / F.log2(rank + 1.0))), F.lit(0.0)) / ideal_dcg(n, top)).alias(f"ndcg_{top}")]
    return joined.groupBy("query_id", *by, "n_relevant").agg(*metrics)


def overall(results: DataFrame, by: Sequence[str] = ("mode",), within: str = "query_type") -> DataFrame:
    """Means (4 places) and number of queries by ``by``, and by ``by`` and ``within`` (null: all)."""
    names = [c for c in results.columns if c.startswith(("recall_", "hit_", "mrr_", "ndcg_"))]
    sets = [list(by), [*by, within]]
    return results.groupingSets(sets, *by, within).agg(*[F.round(F.avg(c), 4).alias(c) for c in names], F.count("*").alias("num_queries"))


def nearest_rank(values: str | Column, percent: float) -> Column:
    """The value at place round(percent / 100 x (n - 1)), half to even, of a sorted array; 0 if empty."""
    value = F.col(values) if isinstance(values, str) else values
    place = F.bround(F.lit(percent / 100) * (F.size(value) - 1), 0).cast("int")
    return F.when(F.size(value) == 0, 0.0).otherwise(F.round(F.get(value, F.greatest(F.lit(0), F.least(place, F.size(value) - 1))), 3))


PERCENTS = (50, 70, 90, 95, 99, 100)


def latency_summary(frame: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Nearest-rank percentiles, mean and count of a column by group.

    Places come from a running count over the distinct values, in ranges of (group, value): neither a group's
    values nor its counts ever meet in one task. Groups are few; their totals join as a small table.
    """
    rows = frame.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    counted = running_total(rows.groupBy(*by, "_v").agg(F.count("*").alias("_c")), by, ["_v"], F.col("_c"), "_before")
    totals = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.sum("_v").alias("_sum"))
    totals = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_n", "_sum")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    placed = counted.join(totals, same) if by else counted.crossJoin(totals)

    def at(percent: float) -> Column:
        place = F.bround(F.lit(percent / 100) * (F.col("_n") - 1), 0)
        return F.round(F.min(F.when(F.col("_before") + F.col("_c") > place, F.col("_v"))), 3)

    return placed.groupBy(*by).agg(*[at(p).alias(f"p{p}_ms") for p in PERCENTS], F.round(F.first("_sum") / F.first("_n"), 3).alias("mean_ms"), F.coalesce(F.first("_n"), F.lit(0)).alias("n"))
