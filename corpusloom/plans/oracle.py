"""DuckDB SQL equivalents of the catalogue's queries, built from shared WITH clauses."""

from __future__ import annotations

WS = r"^\s+|\s+$"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{WS}', '', 'g')"


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '\S+')"


def sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({strip(x)}, '([.!?।])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: {strip('p')}), lambda p: p <> '')"


def paragraphs(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({strip(x)}, '\n\s*\n', chr(1), 'g'), chr(1)), lambda p: {strip('p')}), lambda p: p <> '')"


def text_hash(x: str) -> str:
    return rf"sha256(lower({strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")}))"


MARKED = "marked AS (SELECT d.doc_id, d.lang, d.text, CAST(coalesce(l.quality, 0) AS INTEGER) AS is_selected FROM documents d LEFT JOIN labels l USING (doc_id))"

KINDS = "['DESCRIPTION', 'NUMERIC', 'ENTITY', 'PERSON', 'LOCATION']"

PASSAGES = f"""{MARKED}, passages AS (
  SELECT doc_id, doc_id // 10 AS record, CAST(doc_id // 10 AS VARCHAR) AS query_id, CAST(row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) - 1 AS INTEGER) AS passage_index, is_selected,
         CASE WHEN lang = 'en' THEN 'english' ELSE 'target' END AS language, text, {strip('text')} AS prim FROM marked
), ps AS (SELECT *, query_id || '_p' || passage_index AS parent, {KINDS}[record % 5 + 1] AS query_type FROM passages)"""

#: Raw records of ten documents with planted problems, one row a passage slot before the lists are cut.
BROKEN = f"""{MARKED}, slots AS (
  SELECT doc_id // 10 AS n, doc_id, CASE WHEN lang = 'en' THEN text ELSE '' END AS en, CASE WHEN lang = 'en' THEN '' ELSE text END AS tr, is_selected AS sel FROM marked
), listed AS (
  SELECT n, list(en ORDER BY doc_id) AS en0, list(tr ORDER BY doc_id) AS tr0, list(sel ORDER BY doc_id) AS sel0 FROM slots GROUP BY n
), raw AS (
  SELECT n AS record, CASE WHEN n % 31 = 13 THEN NULL ELSE n END AS query_id, n % 19 = 6 AS no_passages,
         CASE WHEN n % 17 = 3 THEN en0[1 : len(en0) - 1] WHEN n % 29 = 11 THEN [] ELSE en0 END AS en,
         CASE WHEN n % 29 = 11 THEN [] ELSE tr0 END AS tr,
         CASE WHEN n % 29 = 11 THEN [] WHEN n % 23 = 7 THEN list_transform(range(0, len(sel0)), lambda i: CAST(i AS INTEGER)) WHEN n % 37 = 5 THEN NULL ELSE sel0 END AS sel,
         CASE WHEN list_contains(sel0, 1) THEN 'yes' ELSE ' No Answer Present. ' END AS answer,
         CASE WHEN n % 4 = 0 THEN NULL WHEN n % 4 = 1 THEN '' ELSE 'm' || n END AS meta
  FROM listed
), checked AS (
  SELECT *, CASE WHEN query_id IS NULL THEN 'query_id is null' WHEN no_passages THEN 'passages is null' WHEN sel IS NULL THEN 'One or more passage sub-fields is null'
    WHEN len(en) <> len(tr) OR len(tr) <> len(sel) THEN 'Mismatched passage list lengths: English_passages=' || len(en) || ', Translated_passages=' || len(tr) || ', is_selected=' || len(sel) END AS reason FROM raw
), warned AS (
  SELECT *, CASE WHEN reason IS NOT NULL THEN [] ELSE list_concat(CASE WHEN len(en) = 0 AND len(tr) = 0 THEN ['empty_passages: both English_passages and Translated_passages are empty'] ELSE [] END,
    list_transform(list_filter(range(0, len(sel)), lambda i: sel[i + 1] NOT IN (0, 1)), lambda i: 'unexpected_is_selected_value:index=' || i || ':value=' || sel[i + 1])) END AS warnings FROM checked
)"""

INGEST = {
    "ingest_validate": f"WITH {BROKEN} SELECT record, reason AS corruption_reason, array_to_string(warnings, '|') AS warnings FROM warned",
    "ingest_warning_counts": f"WITH {BROKEN} SELECT string_split(w, ':')[1] AS kind, count(*) AS n FROM (SELECT unnest(warnings) AS w FROM warned) GROUP BY 1",
    "ingest_corrupt_examples": f"WITH {BROKEN} SELECT record, reason AS corruption_reason FROM warned WHERE reason IS NOT NULL ORDER BY record LIMIT 10",
    "ingest_answer_status": f"WITH {BROKEN} SELECT record, {strip('lower(answer)')} NOT IN ('no answer present.', 'no answer present', '') AS has_answer, CASE WHEN {strip('lower(answer)')} NOT IN ('no answer present.', 'no answer present', '') THEN 'ANSWER_PRESENT' ELSE 'NO_ANSWER' END AS answer_status FROM warned WHERE reason IS NULL",
    "ingest_meta": f"""WITH {BROKEN} SELECT record, CASE WHEN meta IS NOT NULL AND meta <> '' THEN '{{"raw":"' || meta || '"}}' END AS meta FROM warned WHERE reason IS NULL""",
    "ingest_passage_zip": f"WITH {BROKEN}, places AS (SELECT *, unnest(range(0, len(tr))) AS i FROM warned WHERE reason IS NULL) SELECT record, CAST(i AS INTEGER) AS passage_index, sel[i + 1] AS is_selected, md5(en[i + 1]) AS english_md5, md5(tr[i + 1]) AS target_md5 FROM places",
    "ingest_json_roundtrip": f"WITH {BROKEN} SELECT record, CAST(len(tr) AS INTEGER) AS n_passages, CAST(coalesce(list_sum(sel), 0) AS BIGINT) AS selected, md5(array_to_string(tr, '|')) AS target_md5, array_to_string(warnings, '|') AS warnings FROM warned WHERE reason IS NULL",
    "ingest_report": f"""WITH {BROKEN}, good AS (SELECT * FROM warned WHERE reason IS NULL), hashed AS (SELECT *, md5(concat_ws('~', array_to_string(en, '|'), array_to_string(tr, '|'), CAST(sel AS VARCHAR), record % 5, record)) AS h FROM good),
kept AS (SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY h ORDER BY record) = 1), ids AS (SELECT query_id, count(*) AS c FROM kept GROUP BY query_id)
SELECT (SELECT count(*) FROM warned) AS input_rows_examined, (SELECT count(*) FROM warned WHERE reason IS NOT NULL) AS malformed_records,
  (SELECT count(*) FROM warned WHERE len(list_filter(warnings, lambda w: starts_with(w, 'empty_passages'))) > 0) AS empty_passages_records, (SELECT count(*) FROM kept) AS normalized_records,
  (SELECT count(*) FROM kept WHERE answer = 'yes') AS answer_present_records, (SELECT count(*) FROM kept WHERE answer <> 'yes') AS no_answer_records, (SELECT CAST(coalesce(sum(len(tr)), 0) AS BIGINT) FROM kept) AS total_passages,
  (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) FROM ids) AS unique_source_record_hashes, (SELECT count(*) FROM hashed) - (SELECT count(*) FROM kept) AS exact_duplicates_dropped,
  (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM ids) AS content_distinct_duplicate_query_ids, (SELECT count(*) FROM ids WHERE c > 1) AS query_ids_with_multiple_occurrences""",
}

SINGLE = """firsts AS (SELECT doc_id AS record, doc_id % 300 AS raw_id, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS copy FROM documents), kept AS (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY record) - 1 AS nth FROM firsts WHERE copy = 1)"""

INGEST |= {
    "ingest_exact_dedup": f"WITH {SINGLE} SELECT record, copy > 1 AS is_exact_duplicate FROM firsts",
    "ingest_query_id_suffix": f"WITH {SINGLE} SELECT record, CAST(raw_id AS VARCHAR) || CASE WHEN nth > 0 THEN '__dup' || nth ELSE '' END AS query_id, nth > 0 AS is_duplicate_query_id FROM kept",
    "ingest_dedup_stats": f"WITH {SINGLE}, ids AS (SELECT raw_id, count(*) AS c FROM kept GROUP BY 1) SELECT (SELECT count(*) FROM kept) AS unique_source_record_hashes, (SELECT count(*) FROM firsts WHERE copy > 1) AS exact_duplicates_dropped, (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM ids) AS content_distinct_duplicate_query_ids, (SELECT count(*) FROM ids WHERE c > 1) AS query_ids_with_multiple_occurrences",
}

CLASS = "CASE WHEN n <= 40 THEN 'SHORT' WHEN n <= 120 THEN 'MEDIUM' WHEN n <= 250 THEN 'LONG' ELSE 'VERY_LONG' END"
BUCKET = "CASE WHEN c < 10 THEN '0-9' WHEN c < 50 THEN '10-49' WHEN c < 100 THEN '50-99' WHEN c < 200 THEN '100-199' WHEN c < 500 THEN '200-499' WHEN c < 1000 THEN '500-999' ELSE '1000+' END"

SCAN = {
    "scan_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "pages", "conversations", "benchmark")),
    "scan_first_rows": "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50",
    "ingest_bad_unicode": """WITH docs AS (SELECT doc_id // 10 AS record, doc_id, CASE WHEN lang = 'en' THEN '' ELSE text END AS tr FROM documents), places AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY doc_id) - 1 AS i FROM docs)
SELECT record, array_to_string(list_concat(CASE WHEN record % 7 = 2 THEN ['unicode_encode_issue:query'] ELSE [] END, coalesce(list('unicode_encode_issue:Translated_passages[' || i || ']' ORDER BY i) FILTER (record % 5 = 1 AND i % 4 = 3), [])), '|') AS warnings FROM places GROUP BY record""",
}

TEXT = {
    "text_tokens": f"SELECT doc_id, CAST(len({words('text')}) AS INTEGER) AS tokens, CAST(length(text) AS INTEGER) AS chars, CAST(len(list_distinct({words('lower(text)')})) AS INTEGER) AS distinct_words FROM documents",
    "text_sentences": f"SELECT doc_id, CAST(len({sentences('text')}) AS INTEGER) AS n_sentences, md5(array_to_string({sentences('text')}, '|')) AS sentences_md5 FROM documents",
    "text_paragraphs": f"SELECT page_id, CAST(len({paragraphs('html')}) AS INTEGER) AS n_paragraphs, md5(array_to_string({paragraphs('html')}, '|')) AS paragraphs_md5 FROM pages",
    "text_norm_hash": f"SELECT doc_id, {text_hash('text')} AS text_hash FROM documents",
    "text_nfc": "SELECT doc_id, CAST(length(nfc_normalize(text || ' e' || chr(769) || 'n' || chr(771))) AS INTEGER) AS chars, md5(nfc_normalize(text || ' e' || chr(769) || 'n' || chr(771))) AS nfc_md5 FROM documents",
    "text_classes": f"SELECT {CLASS} AS length_class, {BUCKET} AS bucket, count(*) AS n FROM (SELECT len({words('text')}) AS n, length(text) AS c FROM documents) GROUP BY 1, 2",
    "text_json_valid": "SELECT event_type, count(*) FILTER (json_valid(props)) AS n_valid, count(*) FILTER (NOT json_valid(left(props, length(props) - 1))) AS n_cut_invalid, count(*) AS n FROM events GROUP BY 1",
}

_CHUNK_HEAD = f"""{PASSAGES}, sl AS (SELECT parent, language, prim, {sentences('prim')} AS s, CAST(len({words('prim')}) AS INTEGER) AS total FROM ps
), sr AS (SELECT parent, total, unnest(s) AS txt, generate_subscripts(s, 1) AS j FROM sl
), st AS (SELECT *, len({words('txt')}) AS t, sum(len({words('txt')})) OVER (PARTITION BY parent ORDER BY j) AS p, count(*) OVER (PARTITION BY parent) AS n FROM sr
), rules AS (SELECT parent, 'sentence' AS strategy, 30 AS least_t, 100 AS target_t, 160 AS most_t FROM sl
  UNION ALL SELECT parent, 'adaptive', 20, 120, 150 FROM sl WHERE total > 40 AND total <= 120
  UNION ALL SELECT parent, 'adaptive', 60, 210, 250 FROM sl WHERE total > 120 AND total <= 250
), spans AS (SELECT r.parent, r.strategy, a.j AS i, a.n,
    min(b.j) FILTER (b.p - a.p + a.t >= r.target_t) AS et, max(b.j) FILTER (b.p - a.p + a.t <= r.most_t) AS em, min(b.j) FILTER (b.p - a.p + a.t >= r.least_t) AS el
  FROM rules r JOIN st a ON a.parent = r.parent JOIN st b ON b.parent = a.parent AND b.j BETWEEN a.j AND a.j + 400 GROUP BY r.parent, r.strategy, a.j, a.n
), ends AS (SELECT parent, strategy, i, n, greatest(least(coalesce(et, n), coalesce(em, i)), coalesce(el, n)) AS e FROM spans
), walk AS (SELECT parent, strategy, i, e, n FROM ends WHERE i = 1 UNION ALL
  SELECT e.parent, e.strategy, e.i, e.e, e.n FROM walk w JOIN ends e ON e.parent = w.parent AND e.strategy = w.strategy AND e.i = greatest(w.i + 1, w.e) WHERE w.e < w.n
), fit AS (SELECT a.parent, a.j AS o, max(b.j) AS last FROM st a JOIN st b ON b.parent = a.parent AND b.j >= a.j AND b.j <= a.j + 400 AND b.p - a.p + a.t <= 150 GROUP BY 1, 2
), back AS (SELECT b.parent, b.j AS e, min(a.j) AS q FROM st a JOIN st b ON b.parent = a.parent AND a.j <= b.j AND a.j >= b.j - 400 AND b.p - a.p + a.t <= 20 GROUP BY 1, 2
), group_walk AS (SELECT a.parent, CAST(1 AS BIGINT) AS o, greatest(1, coalesce(f.last, 1)) AS e, a.n FROM st a LEFT JOIN fit f ON f.parent = a.parent AND f.o = 1 WHERE a.j = 1 UNION ALL
  SELECT x.parent, x.o, greatest(x.e0 + 1, coalesce(f.last, 0)), x.n FROM (SELECT w.parent, least(greatest(coalesce(k.q, w.e + 1), w.o), w.e + 1) AS o, w.e AS e0, w.n FROM group_walk w LEFT JOIN back k ON k.parent = w.parent AND k.e = w.e WHERE w.e < w.n) x LEFT JOIN fit f ON f.parent = x.parent AND f.o = x.o
), halves AS (SELECT parent, CAST(0 AS BIGINT) AS a, n AS b FROM st WHERE total > 250 AND j = 1 UNION ALL
  SELECT h.parent, h.a + CASE WHEN side = 0 THEN 0 ELSE (h.b - h.a) // 2 END, CASE WHEN side = 0 THEN h.a + (h.b - h.a) // 2 ELSE h.b END
  FROM halves h JOIN st x ON x.parent = h.parent AND x.j = h.a + 1 JOIN st y ON y.parent = h.parent AND y.j = h.b, (VALUES (0), (1)) AS sides(side) WHERE y.p - x.p + x.t > 250 AND h.b - h.a > 1
), leaves AS (SELECT h.parent, h.a + 1 AS i, h.b AS e FROM halves h JOIN st x ON x.parent = h.parent AND x.j = h.a + 1 JOIN st y ON y.parent = h.parent AND y.j = h.b WHERE y.p - x.p + x.t <= 250 OR h.b - h.a <= 1
), cuts AS (SELECT parent, strategy, i, e FROM walk UNION ALL SELECT parent, 'adaptive', i, e FROM leaves
  UNION ALL SELECT g.parent, 'paragraph', g.o, g.e FROM group_walk g JOIN sl ON sl.parent = g.parent WHERE sl.total > 40 AND len({paragraphs('sl.prim')}) <= 1
), pieces AS (SELECT c.parent, c.strategy, CAST(row_number() OVER (PARTITION BY c.parent, c.strategy ORDER BY c.i, c.e) - 1 AS INTEGER) AS idx, string_agg(s.txt, ' ' ORDER BY s.j) AS text FROM cuts c JOIN sr s ON s.parent = c.parent AND s.j BETWEEN c.i AND c.e GROUP BY c.parent, c.strategy, c.i, c.e
  UNION ALL SELECT parent, 'passage', 0, text FROM ps
  UNION ALL SELECT parent, 'adaptive', 0, prim FROM sl WHERE total <= 40
  UNION ALL SELECT parent, 'paragraph', 0, prim FROM sl WHERE total <= 40
  UNION ALL SELECT parent, 'paragraph', CAST(k - 1 AS INTEGER), pp[k] FROM (SELECT parent, {paragraphs('prim')} AS pp, unnest(range(1, len({paragraphs('prim')}) + 1)) AS k FROM sl WHERE total > 40 AND len({paragraphs('prim')}) > 1)
)"""

_QUALITY = f"""bags AS (SELECT DISTINCT parent, strategy, idx, unnest({words('lower(text)')}) AS w FROM pieces
), bag_sizes AS (SELECT parent, strategy, idx, count(*) AS w FROM bags GROUP BY 1, 2, 3
), common AS (SELECT a.parent, a.strategy, a.idx, b.idx AS other, count(*) AS c FROM bags a JOIN bags b ON b.parent = a.parent AND b.strategy = a.strategy AND b.w = a.w AND b.idx <> a.idx GROUP BY 1, 2, 3, 4
), worst AS (SELECT parent, strategy, idx, max(c) AS c FROM common GROUP BY 1, 2, 3
), terms AS (SELECT p.*, len({sentences('p.text')}) AS ns, len({words('p.text')}) AS nw, coalesce(z.w, 0) AS nd, {strip('p.text')} AS own,
    round(CASE WHEN o.c IS NULL THEN 0::DOUBLE ELSE least(CAST(o.c AS DOUBLE) / z.w * 0.5::DOUBLE, 0.5::DOUBLE) END, 3) AS penalty
  FROM pieces p LEFT JOIN bag_sizes z USING (parent, strategy, idx) LEFT JOIN worst o USING (parent, strategy, idx)
), scored AS (SELECT *, round(CASE WHEN ns = 0 THEN 0::DOUBLE WHEN ns <= 6 THEN 1::DOUBLE ELSE greatest(0::DOUBLE, 1::DOUBLE - (ns - 6) * 0.08::DOUBLE) END, 3) AS coherence,
    round(CASE WHEN nw = 0 THEN 0::DOUBLE ELSE CAST(nd AS DOUBLE) / nw END, 3) AS density,
    CASE WHEN own = '' THEN 0::DOUBLE ELSE round(CASE WHEN regexp_matches(own, '[.!?।"''”]$') THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN regexp_matches(own, '^([A-Z]|[^\\x00-\\x7F])') THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END, 3) END AS boundary FROM terms
), rated AS (SELECT *, round(coherence + density + boundary - penalty, 3) AS quality_score FROM scored)"""

_FLAGS = f"""ids AS (SELECT p.parent || '_' || p.strategy || '_' || p.idx AS chunk_id, p.parent AS parent_passage_id, p.strategy AS chunk_strategy, p.idx AS chunk_index, p.text, ps.language, ps.query_id, ps.query_type, ps.passage_index, ps.is_selected,
    {text_hash('p.text')} AS chunk_text_hash, CAST(length(p.text) AS INTEGER) AS char_count, CAST(len({words('p.text')}) AS INTEGER) AS token_count_estimate FROM pieces p JOIN ps ON ps.parent = p.parent
), flagged AS (SELECT *, row_number() OVER g AS place, first_value(chunk_id) OVER g AS first_id, char_count < 10 AS below_min_length FROM ids
    WINDOW g AS (PARTITION BY parent_passage_id, language, chunk_text_hash ORDER BY list_position(['passage', 'paragraph', 'sentence', 'adaptive'], chunk_strategy), chunk_id)
), chunks AS (SELECT *, place > 1 AS is_duplicate_chunk, CASE WHEN place > 1 THEN first_id ELSE '' END AS duplicate_of_chunk_id FROM flagged)"""

CHUNKS = f"RECURSIVE {_CHUNK_HEAD}, {_FLAGS}"
RATED = f"RECURSIVE {_CHUNK_HEAD}, {_QUALITY}"


def strategy_sql(strategy: str) -> str:
    return f"WITH {RATED} SELECT r.parent || '_' || strategy || '_' || idx AS chunk_id, ps.language, CAST(nw AS INTEGER) AS tokens, CAST(length(r.text) AS INTEGER) AS chars, {text_hash('r.text')} AS chunk_text_hash, quality_score FROM rated r JOIN ps ON ps.parent = r.parent WHERE strategy = '{strategy}'"


CHUNK = {f"chunk_{s}": strategy_sql(s) for s in ("passage", "paragraph", "sentence", "adaptive")} | {
    "chunk_multiview": f"WITH {CHUNKS} SELECT chunk_id, query_type, is_duplicate_chunk, duplicate_of_chunk_id, below_min_length FROM chunks",
    "chunk_quality": f"WITH {RATED} SELECT parent || '_' || strategy || '_' || idx AS chunk_id, coherence, density, boundary, penalty FROM rated WHERE strategy = 'sentence'",
    "chunk_metadata": f"WITH {CHUNKS}, n AS (SELECT parent, strategy, CAST(count(*) AS VARCHAR) AS c FROM pieces GROUP BY 1, 2) SELECT x.chunk_id, CASE WHEN sl.total <= 40 THEN 'SHORT' WHEN sl.total <= 120 THEN 'MEDIUM' WHEN sl.total <= 250 THEN 'LONG' ELSE 'VERY_LONG' END AS length_class, CAST(sl.total AS VARCHAR) AS total, n.c AS pieces FROM chunks x JOIN sl ON sl.parent = x.parent_passage_id JOIN n ON n.parent = x.parent_passage_id AND n.strategy = 'adaptive' WHERE x.chunk_strategy = 'adaptive'",
    "chunk_canonical": f"WITH {CHUNKS} SELECT min(chunk_id) FILTER (place = 1) AS chunk_id, string_agg(chunk_id, ',' ORDER BY place) FILTER (place > 1) AS duplicate_chunk_ids, array_to_string(list_sort(list(DISTINCT chunk_strategy)), ',') AS contributing_strategies FROM chunks GROUP BY parent_passage_id, language, chunk_text_hash HAVING count(*) > 1",
    "chunk_dedup_summary": f"WITH {CHUNKS} SELECT count(*) AS total_chunks, count(DISTINCT parent_passage_id || language) AS passage_groups, count(*) FILTER (NOT is_duplicate_chunk) AS canonical_chunks, count(*) FILTER (is_duplicate_chunk) AS duplicate_chunks, count(*) FILTER (below_min_length) AS below_min_length_chunks, CAST(10 AS BIGINT) AS min_chars_threshold FROM chunks",
    "chunk_some_strategies": f"WITH {CHUNKS} SELECT chunk_strategy, language, count(*) AS n, CAST(sum(char_count) AS BIGINT) AS chars FROM chunks WHERE chunk_strategy IN ('sentence', 'passage') GROUP BY 1, 2",
    "chunk_text_views": f"WITH {CHUNKS} SELECT x.chunk_id, md5(CASE WHEN x.language = 'target' THEN '' ELSE x.text END) AS english_md5, md5(CASE WHEN x.language = 'target' THEN ps.text ELSE '' END) AS target_md5 FROM chunks x JOIN ps ON ps.parent = x.parent_passage_id",
    "chunk_drop_filters": f"WITH {CHUNKS} SELECT count(*) FILTER (NOT is_duplicate_chunk AND NOT below_min_length) AS kept, count(*) FILTER (is_duplicate_chunk) AS dropped_duplicates, count(*) FILTER (below_min_length AND NOT is_duplicate_chunk) AS dropped_below_min FROM chunks",
}

PCT = "round(CAST(count(*) FILTER (is_duplicate_chunk) AS DOUBLE) / count(*) * 100, 2)"

REPORT = {
    "report_chunk_counts": f"WITH {CHUNKS} SELECT 'chunk_strategy' AS dimension, chunk_strategy AS value, count(*) AS n FROM chunks GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM chunks GROUP BY 2 UNION ALL SELECT 'query_type', query_type, count(*) FROM chunks GROUP BY 2",
    "report_chunks": f"WITH {CHUNKS} SELECT count(*) AS output_chunks, count(*) FILTER (is_selected <> 0) AS selected_chunks, count(*) FILTER (is_selected = 0) AS non_selected_chunks, round(avg(char_count), 2) AS average_chunk_length_chars, CAST(min(char_count) AS BIGINT) AS min_chunk_length_chars, CAST(max(char_count) AS BIGINT) AS max_chunk_length_chars FROM chunks",
    "report_strategies": f"WITH {CHUNKS} SELECT chunk_strategy, count(*) AS total_chunks, count(*) FILTER (is_duplicate_chunk) AS duplicate_chunks, {PCT} AS duplicate_rate_pct, count(*) FILTER (below_min_length) AS below_min_chunks, round(avg(char_count), 2) AS average_length, count(DISTINCT parent_passage_id) FILTER (is_selected = 1) AS selected_passages FROM chunks GROUP BY 1",
    "report_comparison": f"""WITH {CHUNKS}, h AS (SELECT chunk_text_hash, count(*) AS c FROM chunks GROUP BY 1), g AS (SELECT chunk_strategy AS s, count(*) AS c, round(avg(char_count), 2) AS m FROM chunks GROUP BY 1)
SELECT count(*) AS total_chunks, count(*) FILTER (is_duplicate_chunk) AS duplicate_chunks, count(*) FILTER (NOT is_duplicate_chunk) AS canonical_chunks, round(CAST(count(*) FILTER (is_duplicate_chunk) AS DOUBLE) / count(*), 4) AS duplicate_ratio,
  count(DISTINCT parent_passage_id) AS unique_parent_passages, count(DISTINCT query_id) AS unique_source_records, CAST(sum(is_selected) AS BIGINT) AS selected, count(*) FILTER (below_min_length) AS below_min, CAST(count(*) - sum(is_selected) AS BIGINT) AS non_selected,
  round(CAST(count(*) AS DOUBLE) / count(DISTINCT parent_passage_id), 3) AS chunks_per_passage, round(CAST(count(*) AS DOUBLE) / count(DISTINCT query_id), 3) AS chunks_per_record, round(CAST(count(*) FILTER (below_min_length) AS DOUBLE) / count(*) * 100, 2) AS below_min_pct,
  (SELECT count(*) FROM h) AS unique_texts, (SELECT count(*) FROM h WHERE c > 1) AS texts_more_than_once, (SELECT CAST(sum(c - 1) AS BIGINT) FROM h) AS instances_beyond_first,
  (SELECT s FROM g ORDER BY c, s LIMIT 1) AS fewest_chunks, (SELECT s FROM g ORDER BY c DESC, s LIMIT 1) AS most_chunks, (SELECT s FROM g ORDER BY m, s LIMIT 1) AS most_compact, (SELECT s FROM g ORDER BY m DESC, s LIMIT 1) AS least_compact FROM chunks""",
    "report_histogram": f"WITH {CHUNKS}, b AS (SELECT chunk_strategy, char_count AS c FROM chunks) SELECT chunk_strategy, {BUCKET} AS bucket, count(*) AS n FROM b GROUP BY 1, 2 UNION ALL SELECT NULL, {BUCKET}, count(*) FROM b GROUP BY 2",
}

_PLANTED = """bent AS (SELECT chunk_strategy, CASE WHEN r = 10 THEN 'klingon' ELSE language END AS language, CASE WHEN r = 1 THEN NULL WHEN r = 2 THEN 'twice' ELSE chunk_id END AS chunk_id, CASE WHEN r = 3 THEN 'ODD' || seed % 13 ELSE query_type END AS query_type,
  CASE WHEN r = 4 THEN -1 ELSE passage_index END AS passage_index, CASE WHEN r = 5 THEN 7 ELSE is_selected END AS is_selected, CASE WHEN r = 6 THEN '  ' WHEN r = 7 THEN ' No answer present. ' ELSE text END AS text, parent_passage_id,
  CASE WHEN r = 9 THEN NULL ELSE query_id END AS query_id, CASE WHEN r = 8 THEN '{"a":' ELSE '{}' END AS metadata, r = 11 AS bad_text FROM (SELECT *, seed % 101 AS r FROM (SELECT *, CAST('0x' || substr(md5(chunk_id), 1, 7) AS BIGINT) AS seed FROM chunks)))"""
_CLEAN = "bent AS (SELECT *, '{}' AS metadata, false AS bad_text FROM chunks)"


def validation_sql(rows: str) -> str:
    """The validation report over a CTE ``bent``; DuckDB's texts are always valid Unicode, so ``bad_text`` marks where Spark's aren't."""
    checks = {
        "duplicate_chunk_id": "CAST(count(*) - count(DISTINCT coalesce(chunk_id, '~null')) AS BIGINT)",
        "null_chunk_id": "count(*) FILTER (chunk_id IS NULL)",
        "null_query_id": "count(*) FILTER (query_id IS NULL)",
        "invalid_language": "count(*) FILTER (language NOT IN ('target', 'english'))",
        "negative_passage_index": "count(*) FILTER (passage_index < 0)",
        "invalid_is_selected": "count(*) FILTER (is_selected NOT IN (0, 1))",
        "empty_text": f"count(*) FILTER ({strip('text')} = '')",
        "orphan_parent": "count(*) FILTER (parent_passage_id IS DISTINCT FROM query_id || '_p' || passage_index)",
        "leaked_no_answer": f"count(*) FILTER (lower({strip('text')}) = 'no answer present.')",
        "bad_unicode": "count(*) FILTER (bad_text)",
        "bad_metadata": "count(*) FILTER (NOT json_valid(metadata))",
    }
    counted = ", ".join(f"{v} AS {k}" for k, v in checks.items())
    odd = f"query_type NOT IN (SELECT unnest({KINDS}))"
    unknown = f"count(*) FILTER ({odd}) AS unknown_query_type, coalesce(array_to_string(list_sort(list(DISTINCT query_type) FILTER ({odd}))[1:10], ','), '') AS unknown_values"
    return f"WITH {CHUNKS}, {rows}, report AS (SELECT chunk_strategy, language, count(*) AS rows, {counted}, {unknown} FROM bent GROUP BY 1, 2) SELECT *, {' + '.join(checks)} = 0 AS passed FROM report"


_MERGED = ("input_rows_examined", "malformed_records", "empty_passages_records", "answer_present_records", "no_answer_records", "exact_duplicates_dropped", "content_distinct_duplicate_query_ids")
REPORT |= {
    "report_validation": validation_sql(_PLANTED),
    "report_validation_clean": validation_sql(_CLEAN),
    "report_merged": f"SELECT c.*, {', '.join(f'i.{n}' for n in _MERGED)} FROM ({REPORT['report_chunks']}) c, ({INGEST['ingest_report']}) i",
}

PROFILE = {
    "inspect_nulls": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null FROM (SELECT doc_id, nullif(text, '') AS text, lang, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source, n_chars FROM documents)" for c in ("doc_id", "text", "lang", "source", "n_chars")) + ")",
    "inspect_value_counts": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM (SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS l_linenumber FROM lineitem) GROUP BY 2" for c in ("l_returnflag", "l_linestatus", "l_linenumber")),
    "inspect_nested": f"WITH {BROKEN}, f AS (SELECT 'English_passages' AS field, len(en) AS n FROM raw WHERE NOT no_passages UNION ALL SELECT 'Translated_passages', len(tr) FROM raw WHERE NOT no_passages UNION ALL SELECT 'is_selected', len(sel) FROM raw WHERE NOT no_passages AND sel IS NOT NULL) SELECT field, CAST(min(n) AS INTEGER) AS min_length, CAST(max(n) AS INTEGER) AS max_length, array_to_string(list_sort(list(DISTINCT n))[1:20], ',') AS lengths FROM f GROUP BY 1",
    "inspect_selection": f"WITH {BROKEN}, f AS (SELECT len(en) AS n, CASE WHEN sel IS NOT NULL THEN len(list_filter(sel, lambda v: v = 1)) END AS s FROM raw WHERE NOT no_passages) SELECT CAST(min(n) AS INTEGER) AS min_passages, CAST(max(n) AS INTEGER) AS max_passages, CAST(min(s) AS INTEGER) AS min_selected, CAST(max(s) AS INTEGER) AS max_selected, count(*) FILTER (s = 0) AS records_with_zero_selected, count(*) FILTER (s >= 1) AS records_with_selected FROM f",
    "inspect_no_answer": f"WITH {BROKEN}, f AS (SELECT record, answer <> 'yes' AS none, CASE WHEN no_passages OR sel IS NULL THEN NULL ELSE len(list_filter(sel, lambda v: v <> 0)) = 0 END AS z FROM raw), t AS (SELECT * FROM f WHERE none ORDER BY record LIMIT 20) SELECT (SELECT count(*) FROM f WHERE none) AS no_answer_count, (SELECT round(CAST(count(*) FILTER (none) AS DOUBLE) / count(*), 4) FROM f) AS no_answer_ratio, (SELECT count(*) FROM t WHERE z IS NOT NULL) AS checked_sample_size, (SELECT count(*) FROM t WHERE z) AS confirmed_all_zero",
    "inspect_text_lengths": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min(length({c})) AS INTEGER) AS min_chars, CAST(max(length({c})) AS INTEGER) AS max_chars, round(avg(length({c})), 2) AS mean_chars, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY length({c})) AS DOUBLE) AS median_chars FROM documents" for c in ("text", "lang", "source")),
    "inspect_repeated_keys": "SELECT CAST(count(*) - count(DISTINCT coalesce(k, -1)) AS BIGINT) AS n_repeated FROM (SELECT CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id END AS k FROM events)",
}

_RECORDS = f"{PASSAGES}, recs AS (SELECT record, query_id, min(query_type) AS query_type, list(parent ORDER BY passage_index) FILTER (is_selected = 1) AS gt FROM ps GROUP BY record, query_id), elig AS (SELECT * FROM recs WHERE gt IS NOT NULL AND len(gt) > 0)"


def sample_sql(size: int, seed: int = 42) -> str:
    """The stratified sample as CTEs; quotas by a recursive walk over the types in order."""
    return f"""{_RECORDS}, tc AS (SELECT query_type, count(*) AS c FROM elig GROUP BY 1), tn AS (SELECT *, row_number() OVER (ORDER BY query_type) AS k, count(*) OVER () AS types, CAST(sum(c) OVER () AS BIGINT) AS total FROM tc
), quota AS (SELECT query_type, k, types, total, least({size}, total) AS goal, CASE WHEN types = 1 THEN least(least({size}, total), c) ELSE least(CAST(round_even(CAST(least({size}, total) * c AS DOUBLE) / total, 0) AS BIGINT), c, least({size}, total)) END AS q,
    least({size}, total) - CASE WHEN types = 1 THEN least({size}, total) ELSE least(CAST(round_even(CAST(least({size}, total) * c AS DOUBLE) / total, 0) AS BIGINT), c, least({size}, total)) END AS rest FROM tn WHERE k = 1 UNION ALL
  SELECT n.query_type, n.k, n.types, n.total, p.goal, CASE WHEN n.k = n.types THEN least(p.rest, n.c) ELSE least(CAST(round_even(CAST(p.goal * n.c AS DOUBLE) / n.total, 0) AS BIGINT), n.c, p.rest) END,
    p.rest - CASE WHEN n.k = n.types THEN p.rest ELSE least(CAST(round_even(CAST(p.goal * n.c AS DOUBLE) / n.total, 0) AS BIGINT), n.c, p.rest) END FROM quota p JOIN tn n ON n.k = p.k + 1
), drawn AS (SELECT e.*, row_number() OVER (PARTITION BY e.query_type ORDER BY md5('{seed}:' || e.query_id), e.query_id) AS place, q.q FROM elig e JOIN quota q ON q.query_type = e.query_type
), sample AS (SELECT *, CAST(row_number() OVER (ORDER BY md5('{seed + 1}:' || query_id), query_id) AS INTEGER) AS sample_place FROM drawn WHERE place <= q)"""


SAMPLE, CORPUS = 20, 3000
_SUBSET = f"""pos AS (SELECT DISTINCT unnest(gt) AS parent_passage_id FROM sample), base AS (SELECT c.*, CASE WHEN c.parent_passage_id IN (SELECT parent_passage_id FROM pos) THEN 'positive' WHEN c.query_id IN (SELECT query_id FROM sample) THEN 'hard_negative' ELSE 'random_negative' END AS origin FROM chunks c
), numbered AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY md5('42:' || chunk_id), chunk_id) AS nth FROM base), corpus AS (SELECT * FROM numbered WHERE origin <> 'random_negative' OR nth <= greatest(0, {CORPUS} - (SELECT count(*) FROM base WHERE origin <> 'random_negative')))"""


def _with_chunks(tail: str, size: int = SAMPLE) -> str:
    """Chunks and the sample in one WITH; both start from the same passages."""
    return f"WITH {CHUNKS}, {sample_sql(size).removeprefix(PASSAGES + ', ')}{tail}"


BENCH = {
    "bench_stratified": f"WITH RECURSIVE {sample_sql(SAMPLE)} SELECT query_id, query_type, sample_place FROM sample",
    "bench_manifest": f"WITH RECURSIVE {sample_sql(SAMPLE)} SELECT e.query_type, count(*) AS eligible, CAST((SELECT count(*) FROM sample s WHERE s.query_type = e.query_type) AS BIGINT) AS sampled FROM elig e GROUP BY 1",
    "bench_ground_truth": _with_chunks(", want AS (SELECT query_id, unnest(gt) AS parent_passage_id FROM sample) SELECT w.query_id, c.chunk_strategy, string_agg(c.chunk_id, ',' ORDER BY c.passage_index, c.chunk_index) AS chunk_ids FROM want w JOIN chunks c USING (parent_passage_id) WHERE c.is_selected = 1 GROUP BY 1, 2"),
    "bench_require_answer": f"WITH RECURSIVE {_RECORDS}, kept AS (SELECT * FROM elig WHERE record % 3 <> 0) SELECT query_id, array_to_string(gt, ',') AS passages FROM kept",
    "bench_json_lines": f"WITH RECURSIVE {sample_sql(SAMPLE)} SELECT query_id, query_type, CASE WHEN record % 2 = 0 THEN 'What is ' || record || '?' ELSE 'q ' || record END AS asked, true AS has_answer, 'ANSWER_PRESENT' AS answer_status, array_to_string(gt, ',') AS passages FROM sample",
    "bench_relevance": _with_chunks(", want AS (SELECT query_id, unnest(gt) AS parent_passage_id FROM sample) SELECT w.query_id, c.chunk_id FROM want w JOIN chunks c USING (parent_passage_id) WHERE c.is_selected = 1 AND c.chunk_strategy = 'adaptive'"),
    "corpus_subset": _with_chunks(f", {_SUBSET} SELECT chunk_id, origin FROM corpus"),
    "corpus_manifest": _with_chunks(f", {_SUBSET} SELECT origin, chunk_strategy, count(*) AS n FROM corpus GROUP BY 1, 2"),
    "corpus_missing_gt": _with_chunks(f", {_SUBSET} SELECT parent_passage_id FROM pos WHERE parent_passage_id NOT IN (SELECT parent_passage_id FROM corpus WHERE chunk_strategy = 'paragraph' AND passage_index < 7)"),
}


def dense_sql(expression: str, order: str, k: int = 10, where: str = "true", chunk_id: str = "c.vec_id") -> str:
    return f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, {chunk_id} AS chunk_id, {expression} AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND {where}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score {order}, chunk_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= {k}"""


#: Whose query type is T1 in its last version.
_TYPED = "(c.label = 1 OR (c.vec_id % 5 = 0 AND c.vec_id % 10 <> 0 AND c.vec_id % 7 <> 0))"

DENSE = {
    "dense_topk_cosine": dense_sql("list_cosine_similarity(q.e, c.e)", "DESC"),
    "dense_topk_dot": dense_sql("list_dot_product(q.e, c.e)", "DESC"),
    "dense_topk_euclid": dense_sql("list_distance(q.e, c.e)", "ASC"),
    "dense_cells_cosine": dense_sql("list_cosine_similarity(q.e, c.e)", "DESC"),
    "dense_cells_dot": dense_sql("list_dot_product(q.e, c.e)", "DESC"),
    "dense_cells_euclid": dense_sql("list_distance(q.e, c.e)", "ASC"),
    "dense_dirty": dense_sql("list_cosine_similarity(q.e, c.e)", "DESC", where="c.vec_id % 13 NOT IN (3, 5, 7, 9, 11)"),
    "collection_dot": dense_sql("list_dot_product(q.e, c.e)", "DESC", where=_TYPED, chunk_id="CAST(c.vec_id AS VARCHAR)"),
    "collection_euclid": dense_sql("list_distance(q.e, c.e)", "ASC", where=_TYPED, chunk_id="CAST(c.vec_id AS VARCHAR)"),
    "dense_filtered": dense_sql("list_cosine_similarity(q.e, c.e)", "DESC", where="c.label = 3"),
}


def bm25_ctes(corpus: str, queries: str, k: int) -> str:
    """CTEs down to ``sparse`` (query_id, rank, chunk_id, score); corpus has chunk_id, text, queries query_id, text."""
    return f"""cw AS (SELECT chunk_id, {words('lower(text)')} AS w FROM ({corpus})), cs AS (SELECT count(*) AS total, avg(len(w)) AS avgdl FROM cw), tf AS (SELECT chunk_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT chunk_id, w, unnest(w) AS term FROM cw) GROUP BY ALL),
df AS (SELECT term, ln(CAST((SELECT total FROM cs) AS DOUBLE) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf GROUP BY term), me AS (SELECT avg(idf) AS m FROM df),
qw AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({words('lower(text)')}) AS term FROM ({queries})) GROUP BY ALL),
sc AS (SELECT q.query_id, t.chunk_id, sum(CASE WHEN d.idf < 0 THEN 0.25 * (SELECT m FROM me) ELSE d.idf END * q.qtf * t.tf * 2.5::DOUBLE / (t.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * t.dl / (SELECT avgdl FROM cs)))) AS score FROM qw q JOIN tf t USING (term) JOIN df d USING (term) GROUP BY 1, 2),
al AS (SELECT q.query_id, c.chunk_id, coalesce(sc.score, 0::DOUBLE) AS score FROM (SELECT DISTINCT query_id FROM ({queries})) q CROSS JOIN cw c LEFT JOIN sc ON sc.query_id = q.query_id AND sc.chunk_id = c.chunk_id),
sparse AS (SELECT * FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM al) WHERE rank <= {k})"""


_TURNS = "SELECT conv_id * 100 + turn AS chunk_id, text FROM conversations WHERE role = 'assistant'"
_ASKED = "SELECT conv_id AS query_id, text FROM conversations WHERE role = 'user' AND conv_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1"


def ngrams_ctes(rows: str, name: str, dim: int) -> str:
    """CTE ``name`` (id, e): the hashing embedder's vectors of rows (id, text)."""
    places = f"""list_concat({", ".join(f"list_transform(range(1, greatest(length(x) - {n - 1}, 0) + 1), lambda i: list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(0, {n}), lambda j: CAST(unicode(substr(x, i + j, 1)) AS BIGINT))), lambda a, b: (a * 131 + b) % {dim}))" for n in (2, 3, 4))})"""
    return f"""{name}_w AS (SELECT id, ' ' || unnest({words('lower(text)')}) || ' ' AS x FROM ({rows})), {name}_v AS (SELECT x, {places} AS l, CASE WHEN length(x) = 3 THEN 1 ELSE 0 END AS whole FROM (SELECT DISTINCT x FROM {name}_w)),
{name}_c AS (SELECT w.id, p, count(*) AS c FROM (SELECT w.id, unnest(v.l) AS p FROM {name}_w w JOIN {name}_v v USING (x)) w GROUP BY ALL), {name}_n AS (SELECT id, sqrt(sum(c * c)) AS n FROM {name}_c GROUP BY id)"""


DIM = 64
_HYBRID = f"""{bm25_ctes(_TURNS, _ASKED, 30)}, {ngrams_ctes(f"SELECT chunk_id AS id, text FROM ({_TURNS})", "ce", DIM)}, {ngrams_ctes(f"SELECT query_id AS id, text FROM ({_ASKED})", "qe", DIM)},
dp AS (SELECT q.id AS query_id, c.id AS chunk_id, sum(CAST(q.c AS DOUBLE) / qn.n * c.c / cn.n) AS score FROM qe_c q JOIN qe_n qn ON qn.id = q.id JOIN ce_c c ON c.p = q.p JOIN ce_n cn ON cn.id = c.id GROUP BY 1, 2),
dn AS (SELECT * FROM (SELECT query_id, chunk_id, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, chunk_id) AS INTEGER) AS rank FROM dp) WHERE rank <= 30),
fs AS (SELECT query_id, chunk_id, sum(1::DOUBLE / (60 + rank)) AS score, min((l, rank)) AS seen FROM (SELECT query_id, chunk_id, rank, 0 AS l FROM dn UNION ALL SELECT query_id, chunk_id, rank, 1 FROM sparse) GROUP BY 1, 2),
fused AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS INTEGER) AS rank FROM fs)"""

_RANKED = f"""{_HYBRID}, ranked AS (SELECT 'dense' AS mode, query_id, chunk_id, rank FROM dn UNION ALL SELECT 'hybrid_rrf', query_id, chunk_id, rank FROM fused), rel AS (SELECT c.conv_id AS query_id, c.conv_id * 100 + c.turn AS chunk_id FROM conversations c WHERE role = 'assistant' AND conv_id IN (SELECT query_id FROM ({_ASKED}))),
nr AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY 1), hits AS (SELECT r.mode, r.query_id, r.rank FROM ranked r JOIN rel USING (query_id, chunk_id)),
per AS (SELECT n.query_id, m.mode, n.n_relevant, {", ".join(f"CAST(count(h.rank) FILTER (h.rank <= {k}) AS DOUBLE) / n.n_relevant AS recall_{k}, CASE WHEN count(h.rank) FILTER (h.rank <= {k}) > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS hit_{k}" for k in (1, 3, 5, 10))},
  coalesce(1::DOUBLE / min(h.rank) FILTER (h.rank <= 10), 0::DOUBLE) AS mrr_10, coalesce(sum(1::DOUBLE / log2(h.rank + 1)) FILTER (h.rank <= 10), 0::DOUBLE) / list_sum(list_transform(range(1, least(n.n_relevant, 10) + 1), lambda i: 1::DOUBLE / log2(i + 1))) AS ndcg_10
  FROM nr n CROSS JOIN (VALUES ('dense'), ('hybrid_rrf')) AS m(mode) LEFT JOIN hits h ON h.query_id = n.query_id AND h.mode = m.mode GROUP BY 1, 2, 3)"""
_METRICS = [f"{m}_{k}" for k in (1, 3, 5, 10) for m in ("recall", "hit")] + ["mrr_10", "ndcg_10"]

RETRIEVAL = DENSE | {
    "bm25_topk": f"WITH {bm25_ctes('SELECT doc_id AS chunk_id, text FROM documents', 'SELECT item_id AS query_id, text FROM benchmark', 10)} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM sparse",
    "embed_hash_ngrams": f"WITH {ngrams_ctes('SELECT item_id AS id, text FROM benchmark', 'b', DIM)} SELECT id AS item_id, CAST(p AS INTEGER) AS place, round(c / n, 5) AS value FROM b_c JOIN b_n USING (id)",
    "hybrid_topk": f"WITH {_HYBRID} SELECT query_id, rank, chunk_id, round(score, 9) AS score FROM fused WHERE rank <= 10",
    "rrf_fuse": """WITH o AS (SELECT o_orderpriority AS query_id, o_orderkey AS chunk_id, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS a, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS b FROM orders),
l AS (SELECT query_id, chunk_id, a AS rank, 0 AS l FROM o WHERE a <= 30 UNION ALL SELECT query_id, chunk_id, b, 1 FROM o WHERE b <= 30), f AS (SELECT query_id, chunk_id, sum(1::DOUBLE / (60 + rank)) AS score, min((l, rank)) AS seen FROM l GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS INTEGER) AS rank, chunk_id, round(score, 9) AS score FROM f""",
    "eval_per_query": f"WITH {_RANKED} SELECT query_id, mode, n_relevant, {', '.join(f'round({m}, 9) AS {m}' for m in _METRICS)} FROM per",
    "eval_overall_by_type": f"WITH {_RANKED}, typed AS (SELECT *, {KINDS}[query_id // 100 % 5 + 1] AS query_type FROM per) SELECT mode, query_type, {', '.join(f'round(avg({m}), 4) AS {m}' for m in _METRICS)}, count(*) AS num_queries FROM typed GROUP BY GROUPING SETS ((mode), (mode, query_type))",
    "latency_percentiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, " + ", ".join(f"round(max(value) FILTER (i = round_even({p / 100} * (n - 1), 0)), 3) AS p{p}_ms" for p in (50, 70, 90, 95, 99, 100)) + ", round(avg(value), 3) AS mean_ms, count(*) AS n FROM r GROUP BY event_type",
    "retrieve_single": f"""WITH {ngrams_ctes("SELECT item_id AS id, text FROM benchmark", "qe", DIM)}, {ngrams_ctes("SELECT doc_id AS id, text FROM documents WHERE lang = 'en'", "ce", DIM)},
dp AS (SELECT q.id AS query_id, c.id AS doc_id, round(sum(CAST(q.c AS DOUBLE) / qn.n * c.c / cn.n), 4) AS score FROM qe_c q JOIN qe_n qn ON qn.id = q.id JOIN ce_c c ON c.p = q.p JOIN ce_n cn ON cn.id = c.id GROUP BY 1, 2),
r AS (SELECT *, doc_id || '_p0_passage_0' AS chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id || '_p0_passage_0') AS INTEGER) AS rank FROM dp)
SELECT CAST(query_id AS VARCHAR) AS query_id, rank, chunk_id, score, md5(text) AS text_md5 FROM r JOIN documents USING (doc_id) WHERE rank <= 5""",
    "index_point_id": "SELECT doc_id, lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lpad(printf('%x', (CAST('0x' || substr(h, 17, 2) AS INTEGER) & 63) | 128), 2, '0') || substr(h, 19, 2) || '-' || substr(h, 21, 12)) AS point_id FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR) || '_p0_passage_0')) AS h FROM documents)",
    "index_upsert": "WITH p AS (SELECT vec_id, label, 0 AS version FROM embeddings UNION ALL SELECT vec_id, label + 100, 1 FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 1000000, label, 1 FROM embeddings WHERE vec_id % 10 = 0) SELECT vec_id, CAST(max_by(label, version) AS INTEGER) AS label, CAST(max(version) AS INTEGER) AS version FROM p GROUP BY vec_id",
}


def oracle_sql() -> dict[str, str]:
    return INGEST | SCAN | TEXT | CHUNK | REPORT | PROFILE | BENCH | RETRIEVAL
