"""Benchmark queries with ground truth, and corpora to search them in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import union_all

FIELDS = ("query_id", "query_target", "query_english", "query_type", "source_lang", "target_lang", "has_answer", "answer_status", "passages")


#: Types that a sample is drawn by, at most.
MOST_TYPES = 10_000


def eligible(records: DataFrame, require_answer: bool = False) -> DataFrame:
    """Records with a selected passage (and an answer, if required)."""
    rows = records.where(F.exists("passages", lambda p: p["is_selected"] == 1))
    return rows.where("has_answer") if require_answer else rows


def marks() -> Column:
    """Passages without their texts: all that sampling and ground truth read."""
    return F.transform("passages", lambda p: F.struct(p["passage_index"].alias("passage_index"), p["is_selected"].alias("is_selected")))


def draw_order(key: str, seed: int) -> Column:
    """A reproducible order that any engine gives alike: the MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def quotas(counts: dict[str, int], size: int) -> dict[str, int]:
    """Proportional shares (half to even) of ``size`` by type in sorted order; the last type takes what is left, as
    far as it has rows."""
    total = sum(counts.values())
    left = size = min(size, total)
    shares = {}
    for name in sorted(counts):
        own = left if name == max(counts) else min(round(size * counts[name] / total), counts[name], left)
        shares[name] = min(own, counts[name])
        left -= own
    return shares


def seeded_draw(rows: DataFrame, wanted: dict[str, int], seed: int, key: str, by: Column, most: int = 10_000) -> DataFrame:
    """The first ``wanted`` rows of each value of ``by`` (text) in ``draw_order``, ties by key.

    The last row of each draw is found by counting the order's prefixes, three hex digits a pass, until the
    prefix that holds it has at most ``most`` rows; the draw is then a filter. Nothing is sorted but those few.
    """
    wanted = {k: n for k, n in wanted.items() if n > 0}
    if not wanted:
        return rows.limit(0)
    narrow = rows.select(by.alias("_by"), draw_order(key, seed).alias("_draw"), F.col(key).alias("_key")).where(F.col("_by").isin(*wanted))
    prefix, left, step = dict.fromkeys(wanted, ""), dict(wanted), 3
    while True:
        size = len(next(iter(prefix.values())))
        inside = narrow.where(F.substring("_draw", 1, size) == F.element_at(F.create_map(*[F.lit(x) for pair in prefix.items() for x in pair]), F.col("_by")))
        counts: dict[str, list[tuple[str, int]]] = {k: [] for k in prefix}
        for row in inside.groupBy("_by", F.substring("_draw", size + 1, step).alias("_next")).count().collect():
            counts[row["_by"]].append((row["_next"], row["count"]))
        largest = 0
        for k in list(prefix):
            if sum(n for _, n in counts[k]) <= left[k]:  # all of them are drawn
                del prefix[k]
                continue
            for digits, n in sorted(counts[k]):
                if left[k] <= n:
                    prefix[k] += digits
                    largest = max(largest, n)
                    break
                left[k] -= n
        if not prefix or largest <= most or size + step >= 30:
            break
    last = {}
    if prefix:
        size = len(next(iter(prefix.values())))
        cell = narrow.where(F.substring("_draw", 1, size) == F.element_at(F.create_map(*[F.lit(x) for pair in prefix.items() for x in pair]), F.col("_by")))
        for k in prefix:
            last[k] = cell.where(F.col("_by") == k).orderBy("_draw", "_key").limit(left[k]).agg(F.max(F.struct("_draw", "_key"))).first()[0]
    kind, draw, inside = by, draw_order(key, seed), F.lit(False)
    for k in wanted:
        own = kind == k
        inside |= own & ((draw < last[k]["_draw"]) | ((draw == last[k]["_draw"]) & (F.col(key) <= last[k]["_key"]))) if k in last else own
    return rows.where(inside)


def stratified_sample(records: DataFrame, size: int, seed: int = 42, by: str = "query_type", key: str = "query_id") -> DataFrame:
    """Rows by quota of each type, in a seeded order: ``records`` with ``sample_place`` (1, 2, ... over the sample).

    Quotas come from one small aggregate, of ``MOST_TYPES`` types at most; see ``seeded_draw`` for the rows. Keys don't repeat.
    """
    counts = {r[by]: r["count"] for r in records.where(F.col(by).isNotNull()).groupBy(by).count().limit(MOST_TYPES + 1).collect()}
    if len(counts) > MOST_TYPES:
        raise ValueError(f"{by} has more than {MOST_TYPES} values")
    shares = {k: v for k, v in quotas(counts, size).items() if v > 0} if counts else {}
    if not shares:
        return records.limit(0).withColumn("sample_place", F.lit(None).cast("int"))
    drawn = seeded_draw(records, shares, seed, key, F.col(by))
    # the sample is of bounded size: one order over it is a sort of at most ``size`` rows
    return drawn.withColumn("sample_place", F.row_number().over(Window.orderBy(draw_order(key, seed + 1), key)))


def selected_passage_ids() -> Column:
    chosen = F.filter("passages", lambda p: p["is_selected"] == 1)
    return F.transform(chosen, lambda p: F.concat("query_id", F.lit("_p"), p["passage_index"]))


def ground_truth(sample: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Benchmark rows: query fields, selected passages' ids, and their chunks' ids by strategy.

    Answers are never among the columns, and is_selected serves for ground truth alone.
    """
    base = sample.select("query_id", F.col("query_target").alias("query"), F.col("query_english").alias("Eng_Query"), "query_type", "source_lang", "target_lang", "has_answer", "answer_status", selected_passage_ids().alias("ground_truth_parent_passage_ids"))
    if chunks is None:
        return base.withColumn("ground_truth_chunk_ids_by_strategy", F.create_map().cast("map<string,array<string>>"))
    wanted = base.select("query_id", F.posexplode("ground_truth_parent_passage_ids").alias("_at", "parent_passage_id"))
    found = chunks.where(F.col("is_selected") == 1).select("parent_passage_id", "chunk_strategy", "chunk_index", "chunk_id").join(wanted, "parent_passage_id")
    ids = found.groupBy("query_id", "chunk_strategy").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "chunk_index", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    maps = ids.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_strategy", "ids")))).alias("ground_truth_chunk_ids_by_strategy"))
    empty = F.create_map().cast("map<string,array<string>>")
    return base.join(maps, "query_id", "left").withColumn("ground_truth_chunk_ids_by_strategy", F.coalesce("ground_truth_chunk_ids_by_strategy", empty))


def corpus_subset(chunks: DataFrame, benchmark: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """All chunks of ground-truth passages (``positive``) and of the same records (``hard_negative``), and a seeded
    draw of others (``random_negative``) up to ``size``; ``origin`` says which. One row for each chunk_id.

    Positives and hard negatives are never trimmed. ``chunks`` and ``benchmark`` are read several times, by few
    columns: pass stored tables.
    """
    positives = benchmark.select(F.explode("ground_truth_parent_passage_ids").alias("parent_passage_id")).distinct()
    asked = benchmark.select("query_id").distinct()
    positive = chunks.join(positives, "parent_passage_id", "left_semi")
    hard = chunks.join(asked, "query_id", "left_semi").join(positives, "parent_passage_id", "left_anti")
    others = chunks.join(asked, "query_id", "left_anti")
    base = union_all([positive.withColumn("origin", F.lit("positive")), hard.withColumn("origin", F.lit("hard_negative"))])
    needed = max(0, size - base.count())
    drawn = seeded_draw(others, {"": needed}, seed, "chunk_id", F.lit("")).withColumn("origin", F.lit("random_negative"))
    return union_all([base, drawn.select(*base.columns)]).dropDuplicates(["chunk_id"])


def missing_ground_truth(benchmark: DataFrame, corpus: DataFrame) -> DataFrame:
    """Ground-truth passages without a chunk in the corpus."""
    wanted = benchmark.select(F.explode("ground_truth_parent_passage_ids").alias("parent_passage_id")).distinct()
    return wanted.join(corpus, "parent_passage_id", "left_anti")


def benchmark_manifest(pool: DataFrame, sample: DataFrame, by: str = "query_type") -> DataFrame:
    """``query_type, eligible, sampled`` for every type of the pool."""
    return pool.groupBy(by).agg(F.count("*").alias("eligible")).join(sample.groupBy(by).agg(F.count("*").alias("sampled")), by, "left").select(by, "eligible", F.coalesce("sampled", F.lit(0)).alias("sampled"))


def corpus_manifest(corpus: DataFrame) -> DataFrame:
    """``origin, chunk_strategy, n`` of a corpus."""
    return corpus.groupBy("origin", "chunk_strategy").agg(F.count("*").alias("n"))
