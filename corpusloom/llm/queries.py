"""The catalogue's queries for this subpackage: thin digests over its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, line_dedup, packing, private_data, quality, secret_scan, sharding, simhash, source_audit, spotsigs, token_counts, toxicity

#: Where the public tokenizer files lie; the operators take the path as a parameter.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir).select("doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir))
    base = secret_scan.spans_text("spans", secret_scan.KINDS[:3])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.spans_text("spans").alias("spans"))


def _remainder(modulus: int):
    """crc32 of the doc_id as text, by the modulus."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(_table(spark, sf_dir), _table(spark, sf_dir, "labels"), learn=_remainder(3) != 1)
    return scored.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spotsigs.compare_with_edits(_table(spark, sf_dir))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.fingerprint("signatures").alias("fingerprint"),
        spotsigs.fingerprint("edited_signatures").alias("edited_fingerprint"),
        spotsigs.pruned_jaccard("signatures", "edited_signatures").alias("near_edited"),
        spotsigs.pruned_jaccard("signatures", "next_signatures").alias("near_next"),
        spotsigs.length_partition("signatures").alias("length_partition"),
    )


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of the same fingerprints over the whole table, by length partition and pruned Jaccard."""
    return spotsigs.similar_documents(_table(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), starts AS (
  SELECT item_id, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS s FROM item_words WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[s : s + least(len(words), 10) - 1], ' ') AS win FROM starts
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM lowered, sizes WHERE len(words) >= size
), found AS (
  SELECT p.doc_id, p.s, p.size, w.item_id FROM places p JOIN windows w ON w.size = p.size AND w.win = array_to_string(p.words[p.s : p.s + p.size - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS word FROM found) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(l.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir), tokenizer_path(), with_ids=False).drop("ids")


#: Bytes of text in a shard, at most.
SHARD_BYTES = 1 << 20


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir), SHARD_BYTES)


OP7_SQL = f"""
WITH docs AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS b FROM documents
), levels AS (
  SELECT doc_id, h, b, d, h >> (60 - d) AS p FROM docs, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS d)
), buckets AS (
  SELECT d, p, sum(b) AS b, count(*) AS n, min(h) < max(h) AND sum(b) > {SHARD_BYTES} AS splits FROM levels GROUP BY d, p
), depths AS (
  SELECT l.doc_id, l.h, coalesce(max(l.d) FILTER (k.splits) + 1, 0) AS depth FROM levels l JOIN buckets k ON k.d = l.d AND k.p = l.p GROUP BY l.doc_id, l.h
)
SELECT t.doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(t.h >> (60 - depth)), depth, '0') END AS shard, CAST(depth AS INTEGER) AS local_depth,
       CAST(k.b AS BIGINT) AS shard_bytes, CAST(k.n AS BIGINT) AS shard_docs, k.b > {SHARD_BYTES} AS oversized
FROM depths t JOIN buckets k ON k.d = t.depth AND k.p = t.h >> (60 - depth)
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(_table(spark, sf_dir), _table(spark, sf_dir, "labels"), learn=_remainder(5) != 0)
    return scored.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir), tokenizer_path())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir).select("doc_id", "text"), counts="line_counts")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "line_counts.n_lines", "line_counts.n_dropped", digest.alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, parts, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, line, place, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), holders AS (
  SELECT k, min(doc_id) AS holder FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (holder IS NOT NULL AND holder <> doc_id) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (holder IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN holders USING (k) GROUP BY doc_id
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), counted AS (
  SELECT lang, source, term, count(*) AS docs, sum(n) AS n FROM (SELECT d, lang, source, term, count(*) AS n FROM (SELECT d, lang, source, unnest(words) AS term FROM docs) GROUP BY ALL) GROUP BY ALL
), kept AS (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS total FROM counted GROUP BY ALL HAVING sum(docs) >= 10
), langs AS (
  SELECT lang, count(term) AS v, CAST(coalesce(sum(total), 0) AS HUGEINT) AS size FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total, CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS HUGEINT) AS size
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k ON k.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), rated AS (
  SELECT s.lang, s.source, s.term, s.n, 1 + (1000000000 * (CAST(s.n AS HUGEINT) + 2)) // (s.size + 2 * l.v) AS p, 1 + (1000000000 * (s.total + 2)) // (l.size + 2 * l.v) AS q FROM shares s JOIN langs l ON l.lang = s.lang
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM rated a JOIN rated b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM (SELECT DISTINCT lang, source FROM docs) x JOIN (SELECT DISTINCT lang, source FROM docs) y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pairs p ON p.lang = x.lang AND p.source = x.source AND p.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM rated WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op12_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.find_private(_table(spark, sf_dir))
    counts = [f"n_{kind}" for kind in private_data.BASE]
    base = secret_scan.spans_text("spans", private_data.BASE)
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.spans_text("spans", private_data.KINDS).alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_secrets, op3_quality, op4_spotsigs, op5_decontamination, op6_packing, op7_sharding, op8_toxicity, op9_token_counts, op10_line_dedup, op11_source_divergence, op12_private_data, spotsigs_classes)
    return {f.__name__: f for f in found} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": OP5_SQL, "op7_sharding": OP7_SQL, "op10_line_dedup": OP10_SQL, "op11_source_divergence": OP11_SQL}
