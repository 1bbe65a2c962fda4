"""SpotSigs document fingerprints, with DataFrame functions only.

A common word (an anchor) starts a chain of the content words that follow it; a document's fingerprint is its set of
hashed chains. Sets are partitioned by their length, and two are compared by a Jaccard that is pruned where the
lengths alone keep it under the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import stored, union_all
from .common import checkpoint, connected_components

#: Anchors: common words of English, French, German and Spanish. Fixed values.
ANCHORS = (
    "a an and are as at be by for from has have in is it not of on or that the this to was were with "
    "au aux ce dans de des du elle en est et il la le les ne par pas pour que qui sont sur un une "
    "als auch auf aus das dem den der die ein eine einen es ist mit nicht sich sie sind und von zu zum "
    "al como con del el lo los las mas no para por se ser su sus una y"
).split()
#: Rows of a table that is counted and then sent to all tasks, at most.
MOST_SENT = 10_000
SEPARATORS = r"[^\p{L}\p{N}]+"


def _is_anchor(word: Column) -> Column:
    return word.isin(*ANCHORS)


def with_signatures(docs: DataFrame, text: str, name: str, chain: int = 2) -> DataFrame:
    """``docs`` with the sorted set of signatures (array of int) of a text column as ``name``.

    A signature is the hash of an anchor and of the ``chain`` content words that follow it; other anchors
    between them are passed over, and of anchors in a row the last counts. A text without a whole chain has
    one signature, that of all its words; one without words has none. Null is empty.
    """
    words, content, chains = (f"__loom_{name}_{part}" for part in ("words", "content", "chains"))
    rows = docs.withColumn(words, F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS))
    rows = rows.withColumn(content, F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.get(words, i - 1)).alias("p"))), lambda s: (s["w"] != "") & ~_is_anchor(s["w"])))
    following = lambda i, n: F.get(content, i + n)["w"]
    hashed = F.transform(content, lambda s, i: F.when(_is_anchor(s["p"]) & (i + (chain - 1) < F.size(content)), F.hash(s["p"], s["w"], *[following(i, n) for n in range(1, chain)])))
    rows = rows.withColumn(chains, F.array_sort(F.array_distinct(F.array_compact(hashed))))
    held = F.array_remove(words, "")
    alone = F.when(F.size(held) > 0, F.array(F.hash(held))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn(name, F.when(F.size(chains) > 0, F.col(chains)).otherwise(alone)).drop(words, content, chains)


def fingerprint(signatures: str | Column) -> Column:
    """The signatures as text: eight hex digits each, in order."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def length_partition(signatures: str | Column, least: float = 0.8) -> Column:
    """The partition of a set by its length: sets in partitions that aren't equal or neighbours can't reach ``least``."""
    return F.floor(F.log(F.greatest(F.size(signatures), F.lit(1)).cast("double")) / F.lit(-math.log(least) * (1 + 1e-9))).cast("int")


def pruned_jaccard(one: str, two: str, least: float = 0.0) -> Column:
    """Jaccard of two sets; 0 without comparing them where their lengths keep it under ``least``. Two empty sets: 1."""
    small, large = F.least(F.size(one), F.size(two)), F.greatest(F.size(one), F.size(two))
    both = F.size(F.array_intersect(one, two))
    exact = both.cast("double") / (small + large - both)
    return F.when(large == 0, 1.0).when(small < F.lit(least) * large, 0.0).otherwise(exact)


def following(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, row, n, copies, next_key, next_row``: for each different row the next by descending key, after the last the first.

    ``row`` is the text's xxhash64, ``n`` its code points; rows that agree in both key and text are one, ties
    of a key go by ``row``, a null key comes last. Only keys are sorted, in ranges; what joins the ranges is
    one row for each.
    """
    narrow = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("row"), F.coalesce(F.char_length(text), F.lit(0)).alias("n"))
    narrow = narrow.groupBy("key", "row", "n").agg(F.count("*").alias("copies"))
    order = [F.desc_nulls_last("key"), F.asc("row")]
    ranged = checkpoint(narrow.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    own = Window.partitionBy("range").orderBy(*order)
    after = F.lead(F.struct("key", "row")).over(own)
    placed = ranged.select("*", after.alias("next"), F.row_number().over(own).alias("place"))
    placed = checkpoint(placed)
    heads = placed.where("place = 1").select("range", F.struct("key", "row").alias("head"))
    ranges = Window.orderBy("range")
    first = F.first("head").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("range", F.coalesce(F.lead("head").over(ranges), first).alias("head"))
    joined = placed.join(heads, "range").select("key", "row", "n", "copies", F.coalesce("next", "head").alias("next"))
    return joined.select("key", "row", "n", "copies", F.col("next.key").alias("next_key"), F.col("next.row").alias("next_row"))


def compare_with_edits(docs: DataFrame, chain: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its text, its edited text, both signature sets, and the next document's.

    The edited text has its last half replaced by as much of the next document's beginning. Each text moves
    once, to its key's partition, with its signatures; from there it sends its predecessor those and what
    the edit needs. Null and empty texts have no signatures and take nothing from the next; a single row is its
    own next document; rows that repeat a key and text count as one document and each return, a key's other
    texts follow each other in the order of their hashes, and a null key comes last. An empty table gives no
    rows. Very long texts are read whole.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chained = checkpoint(following(docs, key, text))
    signed = with_signatures(rows, "text", "signatures", chain)
    asked = chained.select(F.col("next_key").alias("k"), F.col("next_row").alias("r"), F.col("key").alias("to_key"), F.col("row").alias("to_row"), F.floor(F.col("n") / 2).cast("int").alias("half"))
    once = signed if chained.where("copies > 1").isEmpty() else signed.dropDuplicates(["key", "row"])
    sent = once.join(asked, F.col("key").eqNullSafe(F.col("k")) & (F.col("row") == F.col("r")))
    sent = sent.select("to_key", "to_row", F.expr("left(text, half)").alias("head"), "half", F.col("signatures").alias("next_signatures"))
    met = signed.join(sent, F.col("key").eqNullSafe(F.col("to_key")) & (F.col("row") == F.col("to_row")))
    edited = F.concat(F.expr("left(text, char_length(text) - half)"), "head")
    met = met.select("key", "text", edited.alias("edited"), "signatures", "next_signatures")
    return with_signatures(met, "edited", "edited_signatures", chain).withColumnRenamed("key", key)


#: Random sets of an index entry that all its others are compared with before the rest is.
HUBS = 3


def _sides(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of classes (``bucket, entry, class``) that share an index entry, by ``bucket, entry, l, r``.

    An entry with more than ``most`` classes is dealt out in blocks on either side, and each pair of blocks is a key of
    its own, so that no task holds more than about ``most`` rows of a side.
    """
    heavy = checkpoint(rows.groupBy("bucket", "entry").count().where(F.col("count") > most).select("bucket", "entry", F.ceil(F.col("count") / most).alias("n")))
    heavy = F.broadcast(heavy) if heavy.count() <= MOST_SENT else heavy

    def dealt(own: str, other: str) -> DataFrame:
        n = rows.join(heavy, ["bucket", "entry"], "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
        return n.withColumn(own, F.pmod(F.xxhash64("class"), F.col("n"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")

    return dealt("l", "r"), dealt("r", "l")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (``a, b``) those whose pruned Jaccard reaches ``least``, once each."""
    one, two = sets.select(F.col("set").alias("a"), F.col("s").alias("s_a")), sets.select(F.col("set").alias("b"), F.col("s").alias("s_b"))
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return once.join(one, "a").join(two, "b").where(pruned_jaccard("s_a", "s_b", least) >= least).select("a", "b")


def _star(members: DataFrame, least: float) -> DataFrame:
    """Of each bucket's entry ``HUBS`` random sets with all its others whose lengths allow ``least``: so many rows a set, at most."""
    hubs = [F.min_by(F.struct("set", "size"), F.xxhash64("set", F.lit(n))) for n in range(HUBS)]
    chosen = members.groupBy("bucket", "entry").agg(F.count("*").alias("n"), F.array(*hubs).alias("hubs")).where("n > 1")
    pairs = members.join(chosen.select("bucket", "entry", F.explode(F.array_distinct("hubs")).alias("hub")), ["bucket", "entry"])
    allowed = F.least("size", "hub.size") >= F.lit(least) * F.greatest("size", "hub.size")
    return pairs.where((F.col("set") != F.col("hub.set")) & allowed).select(F.col("set").alias("a"), F.col("hub.set").alias("b"))


def _between(members: DataFrame, least: float, most: int) -> DataFrame:
    """Pairs of sets that share an entry and are of different classes (``members`` with ``class``): what an entry's copies,
    in one class by now, have among themselves is no pair. Of two sets whose first common signature this is, no more
    than what follows it in either can be common; where that is too little the two are no pair either."""
    left, right = _sides(members.select("bucket", "entry", "class").distinct(), most)
    right = right.withColumnRenamed("class", "other")
    classes = left.join(right, ["bucket", "entry", "l", "r"]).where("class < other").select("bucket", "entry", "class", "other")
    other = members.select("bucket", "entry", F.col("class").alias("other"), F.col("set").alias("b"), F.col("size").alias("size_b"), F.col("part").alias("part_b"), F.col("place").alias("place_b"))
    pairs = classes.join(members, ["bucket", "entry", "class"]).join(other, ["bucket", "entry", "other"])
    near = (F.col("part") == F.col("bucket")) | (F.col("part_b") == F.col("bucket"))
    common = F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b"))
    near &= common * (1 + least) >= F.lit(least) * (F.col("size") + F.col("size_b")) - 1e-6
    return pairs.where(near & (F.least("size", "size_b") >= F.lit(least) * F.greatest("size", "size_b"))).select(F.col("set").alias("a"), "b")


def similar_documents(docs: DataFrame, least: float = 0.8, chain: int = 2, most: int = 1 << 12, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, component``: near-duplicate classes at Jaccard ``least`` of SpotSigs sets; component is the smallest key.

    Equal sets are one. A different set is indexed by the first |S| - ceil(least |S|) + 1 of its signatures,
    the rarest first (by the number of different sets that have them), under its length partition. Of sets of the
    same or neighbouring partitions that share an entry, and whose lengths allow ``least``, all are first compared
    with a few of them by the pruned Jaccard, which links an entry's near copies; then those that are still in different
    classes with each other; for ``most`` see ``_sides``. Null keys get component null, or their class's; documents without
    words are one class. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    signed = checkpoint(with_signatures(rows, "text", "s", chain).select("key", "s", F.xxhash64("s").alias("set")))
    sets = checkpoint(signed.groupBy("set").agg(F.first("s").alias("s"), F.min("key").alias("least")))
    single = sets.select("set", F.explode("s").alias("entry"))
    ranked = single.join(single.groupBy("entry").count(), "entry").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("count", "entry"))).alias("ranked"))
    size = F.size("ranked")
    prefix = F.slice("ranked", 1, (size - F.ceil(F.lit(least) * size) + 1).cast("int"))
    # a signature that no other set has brings nothing together
    placed = F.transform(prefix, lambda x, i: F.struct(x["entry"].alias("entry"), i.alias("place"), (x["count"] > 1).alias("shared")))
    entries = ranked.select("set", size.alias("size"), length_partition("ranked", least).alias("part"), F.explode(F.filter(placed, lambda x: x["shared"])).alias("x"))
    entries = stored(entries.select("set", "size", "part", "x.entry", "x.place"), "signature-index")
    # a bucket is a length partition; it holds its own sets and the next partition's
    members = entries.withColumn("bucket", F.explode(F.array("part", F.col("part") - 1)))
    first = checkpoint(_alike(_star(members, least), sets, least))
    classed = checkpoint(connected_components(first).withColumnRenamed("node", "set"))
    members = members.join(classed, "set", "left").select("bucket", "entry", "place", "set", "size", "part", F.coalesce("root", "set").alias("class"))
    roots = connected_components(union_all([first, _alike(_between(members, least, most), sets, least)]))
    known = sets.join(roots.withColumnRenamed("node", "set"), "set", "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    known = checkpoint(known)
    smallest = known.groupBy("root").agg(F.min("least").alias("component"))
    return signed.join(known.join(smallest, "root").select("set", "component"), "set").select(F.col("key").alias(key), "component")
