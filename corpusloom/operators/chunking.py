"""Four chunk views of every passage, chunk dedup within a passage, and length flags."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import quality
from .windows import CUTTERS, AdaptiveRule, BudgetRule, WindowRule, bounds

STRATEGIES = ("passage", "paragraph", "sentence", "adaptive")
COLUMNS = (
    "chunk_id query_id source_lang target_lang language query_type passage_index is_selected chunk_strategy chunk_index parent_passage_id text text_english text_target "
    "has_answer answer_status source_record_hash token_count_estimate char_count quality_score metadata chunk_text_hash is_duplicate_chunk duplicate_of_chunk_id below_min_length"
).split()
#: What ``flagged_marks`` says of a chunk.
MARKS = tuple("chunk_id query_id language query_type passage_index is_selected chunk_strategy chunk_index parent_passage_id token_count_estimate char_count chunk_text_hash is_duplicate_chunk duplicate_of_chunk_id below_min_length".split())
KEPT = ("query_id", "source_lang", "target_lang", "query_type", "has_answer", "answer_status", "source_record_hash")
# Strategy names, split reasons, methods and metadata keys below are fixed values of the chunk format.
#: Passages of at most so many tokens aren't cut into paragraphs.
WHOLE = 40


def passages(records: DataFrame) -> DataFrame:
    """One row a passage with text: its language, its primary text, its id. Blank passages go."""
    # outer: else a filter on the size is inferred, which makes the passages a second time; the next filter drops nulls
    rows = records.select(*KEPT, F.explode_outer("passages").alias("p"))
    rows = rows.select(*KEPT, "p.passage_index", "p.is_selected", X.filled("p.text_english").alias("text_english"), X.filled("p.text_target").alias("text_target"))
    rows = rows.withColumn("_target", X.strip("text_target")).withColumn("_english", X.strip("text_english"))
    rows = rows.where("_target <> '' or _english <> ''")
    rows = rows.withColumn("language", F.when(F.col("_target") != "", "target").otherwise("english")).withColumn("primary", F.when(F.col("_target") != "", F.col("_target")).otherwise(F.col("_english")))
    return rows.withColumn("parent_passage_id", F.concat("query_id", F.lit("_p"), "passage_index")).drop("_target", "_english")


def _between(values: str, b: Column) -> Column:
    """What an array over ``_sentences`` has between bounds."""
    return F.slice(values, b["first"] + 1, b["last"] - b["first"] + 1)


def _bounded(bounded: str) -> Column:
    """The texts between bounds over ``_sentences``."""
    return F.transform(bounded, lambda b: F.array_join(_between("_sentences", b), " "))


Rule = WindowRule | BudgetRule | AdaptiveRule
#: Each strategy's rule where none is given; a passage has none.
RULES: dict[str, Rule | None] = {"passage": None, "paragraph": BudgetRule(), "sentence": WindowRule(), "adaptive": AdaptiveRule()}


def _pieces(strategy: str, rule: Rule | None, whole: int) -> tuple[Column, list[Column]]:
    """A strategy's pieces of a passage, and what the metadata says of it beside the quality."""
    total, cut = F.col("_total"), F.col(f"_cut_{strategy}") if rule else None
    number = F.size(f"_pieces_{strategy}")
    if strategy == "passage":
        return F.array(F.when(F.col("language") == "target", F.col("text_target")).otherwise(F.col("text_english"))), [F.lit("whole_passage").alias("split_reason")]
    if strategy == "sentence":
        return cut, [F.lit(rule.least).alias("min_tokens"), F.lit(rule.target).alias("target_tokens"), F.lit(rule.most).alias("max_tokens"), F.lit(rule.overlap).alias("overlap_sentences"), number.alias("num_windows_in_passage")]
    if strategy == "paragraph":
        literal = F.size("_paragraphs") > 1
        reason = F.when(total <= whole, "below_min_tokens_kept_whole").when(literal, "literal_paragraph_boundaries").otherwise("sentence_grouped_fallback_no_literal_paragraphs")
        pieces = F.when(total <= whole, F.array("primary")).when(literal, F.col("_paragraphs")).otherwise(cut)
        return pieces, [reason.alias("split_reason"), F.lit(rule.target).alias("target_tokens"), F.lit(rule.overlap).alias("overlap_tokens"), number.alias("num_pieces_in_passage")]
    kind = X.length_class("_total", rule.short, rule.medium, rule.long)
    method = F.when(kind == "SHORT", "kept_whole").when(kind == "MEDIUM", "sentence_window_medium").when(kind == "LONG", "sentence_window_long").otherwise("recursive_structural_split")
    about = [kind.alias("length_class"), method.alias("adaptive_method"), total.alias("passage_total_tokens_estimate"), number.alias("num_pieces_in_passage")]
    return F.when(kind == "SHORT", F.array("primary")).otherwise(cut), about


def _views(records: DataFrame, rules: dict[str, Rule | None], whole: int = WHOLE, least_chars: int | None = None, texts: bool = True) -> DataFrame:
    """Chunks of every passage by each strategy of ``rules``; with ``least_chars`` flagged as ``dedup_chunks`` does; without
    ``texts`` flagged and of ``MARKS`` alone.

    Passages are made, split into sentences and these into words once: a piece's words are those of its sentences. The
    strategies' pieces become rows together. Equal texts of a passage are found in its array of pieces, before they are
    rows, so that nothing is shuffled.
    """
    rows = passages(records)
    split = any(rules.values())
    if split:
        rows = rows.withColumn("_sentences", X.stripped_sentences("primary"))
        rows = rows.withColumn("_plain", _let(X.is_tidy("primary"), lambda tidy: F.transform("_sentences", lambda t: X.plain(t, tidy))))
        rows = rows.withColumn("_counts", F.transform("_plain", X.plain_count))
        rows = rows.withColumn("_total", F.aggregate("_counts", F.lit(0), lambda n, own: n + own))
    if "paragraph" in rules:
        rows = rows.withColumn("_paragraphs", X.stripped_paragraphs("primary"))
    if split:
        found = {f"_bounds_{s}": bounds(F.col("_counts"), rule) for s, rule in rules.items() if rule}
        rows = rows.withColumns(found | ({"_shared": _overlaps(rules, whole)} if texts else {}))
        rows = rows.withColumns({f"_cut_{s}": _bounded(f"_bounds_{s}") for s, rule in rules.items() if rule})
    made = {s: _pieces(s, rule, whole) for s, rule in rules.items()}
    rows = rows.withColumns({f"_pieces_{s}": pieces for s, (pieces, _) in made.items()})
    if split:
        rows = rows.withColumns({f"_spans_{s}": _spans(s, whole) for s in made})
    if not texts:
        return _marks(rows, list(made), split, least_chars)
    kept = [*KEPT, "passage_index", "is_selected", "text_english", "text_target", "language", "parent_passage_id"]
    # what only quality asks for are columns of their own, so that they aren't made where it isn't asked for
    flagged = least_chars is not None
    pieces = F.concat(*[_counted(f"_pieces_{s}", at, s, split, flagged) for at, s in enumerate(made)])
    sizes = [_sized(s, split) for s in made]
    # where nothing is grouped by them, hashes and counts are columns of their own, too
    plains = [F.array() if flagged else _plains(s, split) for s in made]
    abouts = F.array(*[F.struct(F.lit(s).alias("strategy"), F.to_json(F.struct(*about)).alias("about")) for s, (_, about) in made.items()])
    # a text of one byte a character is as long as its bytes, and so are its pieces: nothing has to be counted
    raw = F.when(F.col("language") == "target", F.col("text_target")).otherwise(F.col("text_english"))
    simple = (F.octet_length(raw) == F.char_length(raw)).alias("_simple")
    every = pieces if least_chars is None else _groups(pieces, F.col("parent_passage_id"), list(made))
    # before the rows are made: what stands beside an explode is evaluated for each of its rows
    rows = rows.select(*kept, simple, abouts.alias("_abouts"), (F.col("_shared") if split else _different(list(made))).alias("_shared"), F.array(*sizes).alias("_sizes"), F.array(*plains).alias("_plains"), F.array(*[F.col(f"_pieces_{s}") for s in made]).alias("_texts"), every.alias("_every"))
    # outer: else a filter on the size is inferred, which makes the pieces a second time; the next filter drops nulls
    rows = rows.select(*kept, "_simple", "_abouts", "_shared", "_sizes", "_plains", "_texts", F.explode_outer("_every").alias("_piece" if least_chars is None else "_group"))
    if least_chars is not None:
        rows = rows.select(*kept, "_simple", "_abouts", "_shared", "_sizes", "_plains", "_texts", F.col("_group.ids").alias("_ids"), F.col("_group.strategies").alias("_strategies"), F.posexplode_outer("_group.pieces").alias("_place", "_piece"))
    own_view = F.get("_abouts", F.col("_piece.view"))
    own_text = F.get(F.get("_texts", F.col("_piece.view")), F.col("_piece.index"))
    own_size = F.get(F.get("_sizes", F.col("_piece.view")), F.col("_piece.index"))
    own_plain = F.col("_piece") if flagged else F.get(F.get("_plains", F.col("_piece.view")), F.col("_piece.index"))
    own_shared = F.get(F.get("_shared", F.col("_piece.view")), F.col("_piece.index"))
    flags = [] if least_chars is None else ["_ids", "_strategies", "_place"]
    rows = rows.select(*kept, *flags, own_view["strategy"].alias("chunk_strategy"), own_view["about"].alias("_about"), F.col("_piece.index").alias("chunk_index"), own_text.alias("text"), F.when(F.col("_simple"), F.octet_length(own_text)).otherwise(F.char_length(own_text)).alias("_n_chars"), own_plain["n_words"].alias("_n_words"), own_plain["hash"].alias("_text_hash"), own_size.alias("_size"), own_shared["n_different"].alias("_n_different"), quality.penalty(own_shared["shared"], own_shared["n_different"]).alias("_penalty")).where("text is not null")
    # a whole passage's quality is that of the target text unless that is empty; where it isn't the chunk's text it is blank
    scored = F.when(F.col("chunk_strategy") != "passage", F.col("text")).when(F.col("text_target") != "", F.col("text_target")).otherwise(F.col("text_english"))
    rows = rows.withColumn("_scored", scored)
    blank = F.col("_scored") != F.col("text")
    coherent = F.when(blank, 0.0).otherwise(quality.coherence_of(F.col("_size.n_sentences")))
    dense = F.when(blank, 0.0).otherwise(quality.density_of(F.col("_n_words"), F.col("_n_different")))
    bounded = F.when(blank, 0.0).otherwise(F.col("_size.boundary"))
    chunks = quality.with_breakdown(rows, coherent, dense, bounded, F.col("_penalty"), "_quality")
    split, own = F.col("language") == "target", F.col("chunk_strategy") == "passage"
    duplicate, canonical, short, end = F.lit(False), F.lit(""), F.lit(False), F.lit("}")
    if least_chars is not None:
        duplicate = F.col("_place") > 0
        canonical = F.when(duplicate, F.get("_ids", F.lit(0))).otherwise("")
        short = F.col("_n_chars") < least_chars
        end = F.when((F.size("_ids") > 1) & ~duplicate, F.concat(F.lit(","), _copies(F.col("_ids"), F.col("_strategies")))).otherwise(end)
    # each part is named once, as a filter on the metadata makes a part anew wherever it is named
    metadata = F.concat(F.lit('{"quality_breakdown":'), quality.breakdown_json("_quality"), F.lit(","), F.substring("_about", F.lit(2), F.length("_about") - 2), end)
    return chunks.select(
        F.concat_ws("_", "parent_passage_id", "chunk_strategy", "chunk_index").alias("chunk_id"),
        *KEPT,
        "language",
        "passage_index",
        "is_selected",
        "chunk_strategy",
        "chunk_index",
        "parent_passage_id",
        "text",
        F.when(own | split, F.col("text_english")).otherwise(F.col("text")).alias("text_english"),
        F.when(own, F.col("text_target")).when(split, F.col("text_target")).otherwise(F.lit("")).alias("text_target"),
        F.col("_n_words").alias("token_count_estimate"),
        F.col("_n_chars").alias("char_count"),
        F.col("_quality.quality_score").alias("quality_score"),
        metadata.alias("metadata"),
        F.col("_text_hash").alias("chunk_text_hash"),
        duplicate.alias("is_duplicate_chunk"),
        canonical.alias("duplicate_of_chunk_id"),
        short.alias("below_min_length"),
    ).select(*COLUMNS)


def _marks(rows: DataFrame, strategies: list[str], split: bool, least_chars: int) -> DataFrame:
    """``MARKS`` of the chunks of ``rows``, passages with their pieces: a piece is its length and hash from here on."""
    kept = ["query_id", "query_type", "language", "passage_index", "is_selected", "parent_passage_id"]
    every = _groups(F.concat(*[_counted(f"_pieces_{s}", at, s, split, texts=False) for at, s in enumerate(strategies)]), F.col("parent_passage_id"), strategies)
    rows = rows.select(*kept, every.alias("_every")).select(*kept, F.explode_outer("_every").alias("_group"))
    rows = rows.select(*kept, F.col("_group.ids").alias("_ids"), F.posexplode_outer("_group.pieces").alias("_place", "_piece")).where("_piece is not null")
    strategy, duplicate = F.get(F.array(*map(F.lit, strategies)), F.col("_piece.view")), F.col("_place") > 0
    return rows.select(
        F.concat_ws("_", "parent_passage_id", strategy, "_piece.index").alias("chunk_id"),
        *kept,
        strategy.alias("chunk_strategy"),
        F.col("_piece.index").alias("chunk_index"),
        F.col("_piece.n_words").alias("token_count_estimate"),
        F.col("_piece.n_chars").alias("char_count"),
        F.col("_piece.hash").alias("chunk_text_hash"),
        duplicate.alias("is_duplicate_chunk"),
        F.when(duplicate, F.get("_ids", F.lit(0))).otherwise("").alias("duplicate_of_chunk_id"),
        (F.col("_piece.n_chars") < least_chars).alias("below_min_length"),
    ).select(*MARKS)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once: whatever a lambda names from outside is made anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(strategy: str, whole: int) -> Column:
    """The bounds over ``_sentences`` of each of a strategy's pieces; null where they are paragraphs as they stand."""
    every = F.array(F.struct(F.lit(0).alias("first"), (F.size("_sentences") - 1).alias("last")))
    if strategy == "passage":
        return every
    bounded = F.col(f"_bounds_{strategy}")
    if strategy == "paragraph":
        return F.when(F.col("_total") <= whole, every).when(F.size("_paragraphs") <= 1, bounded)
    return F.when(F.size(f"_pieces_{strategy}") == 1, every).otherwise(bounded)


def _measure(strategy: str, split: bool) -> list[Callable[[Column, Column], Column]]:
    """Of a piece (text, place): its plain text (words in lower case, one blank between them) with their number, how many
    sentences it has. Where passages are split these come from its sentences."""
    of_text = [
        lambda text, i: _let(X.plain(text), lambda own: F.struct(own.alias("plain"), X.plain_count(own).alias("n_words"))),
        lambda text, i: F.size(X.sentences(text)),
    ]
    if not split:
        return of_text
    spans = f"_spans_{strategy}"
    own = lambda i: F.get(spans, i)
    of_span = [
        lambda text, i: F.struct(F.array_join(_between("_plain", own(i)), " ").alias("plain"), F.aggregate(_between("_counts", own(i)), F.lit(0), lambda n, more: n + more).alias("n_words")),
        lambda text, i: own(i)["last"] - own(i)["first"] + 1,
    ]
    if strategy != "paragraph":
        return of_span

    def either(a: Callable[[Column, Column], Column], b: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        return lambda text, i: F.when(F.col(spans).isNull(), a(text, i)).otherwise(b(text, i))

    return [either(a, b) for a, b in zip(of_text, of_span, strict=True)]


def _overlaps(rules: dict[str, Rule | None], whole: int) -> Column:
    """Of each piece: how many different words it has, and how many the piece of its strategy that shares most has; the
    strategies are in the order of ``rules``."""

    def cutter(strategy: str, rule: Rule | None) -> Callable[[list[int]], list[tuple[int, int]]]:
        if rule is None:
            return lambda tokens: [(0, len(tokens) - 1)]
        cut = CUTTERS[type(rule)]
        if strategy != "paragraph":
            return lambda tokens: cut(tokens, rule)
        return lambda tokens: [(0, len(tokens) - 1)] if sum(tokens) <= whole else cut(tokens, rule)

    none = F.lit(None).cast("array<int>")
    literal = F.when((F.col("_total") > whole) & (F.size("_paragraphs") > 1), F.transform("_paragraphs", lambda t: X.plain_count(X.plain(t)))) if "paragraph" in rules else none
    numbers = F.transform(X.plain_words(F.array_join("_plain", " ")), lambda w: F.xxhash64(w))
    at = list(rules).index("paragraph") if "paragraph" in rules else -1
    return quality.overlaps(numbers, F.col("_counts"), literal, at, [cutter(s, rule) for s, rule in rules.items()])


def _different(strategies: list[str]) -> Column:
    """What ``_overlaps`` gives, of pieces that are whole passages."""
    own = lambda text: F.struct(F.size(F.array_distinct(X.lower_words(text))).cast("long").alias("n_different"), F.lit(0).cast("long").alias("shared"))
    return F.array(*[F.transform(f"_pieces_{s}", own) for s in strategies])


def _sized(strategy: str, split: bool) -> Column:
    """Of each of a strategy's pieces the number of its sentences and its boundary's quality.

    They are made before the pieces are rows: what follows then reads numbers only, and a filter on a chunk's metadata,
    which Spark moves in front of what makes it, reads no text again.
    """
    sentences, stripped = _measure(strategy, split)[1], (lambda text: F.col("primary")) if strategy == "passage" else (lambda text: text)
    return F.transform(f"_pieces_{strategy}", lambda text, i: F.struct(sentences(text, i).alias("n_sentences"), quality.stripped_boundary(stripped(text)).alias("boundary")))


def _plains(strategy: str, split: bool) -> Column:
    """Of each of a strategy's pieces the hash of its plain text and the number of its words."""
    own = lambda text, i: _let(_measure(strategy, split)[0](text, i), lambda own: F.struct(F.sha2(own["plain"], 256).alias("hash"), own["n_words"].alias("n_words")))
    return F.transform(f"_pieces_{strategy}", own)


def _counted(pieces: str, view: int, strategy: str, split: bool, flagged: bool = True, texts: bool = True) -> Column:
    """A strategy's pieces by their places, where they are to be flagged with their counts and hash; a sort then puts equal
    texts side by side, the preferred one first. Texts stay out: each step over an array copies what is in it."""
    if not flagged:
        return F.transform(pieces, lambda text, i: F.struct(i.cast("int").alias("index"), F.lit(view).alias("view")))

    def piece(text: Column, i: Column) -> Column:
        size = () if texts else (F.char_length(text).alias("n_chars"),)
        return _let(
            _measure(strategy, split)[0](text, i),
            lambda own: F.struct(
                F.sha2(own["plain"], 256).alias("hash"), F.lit(STRATEGIES.index(strategy)).alias("order"), i.cast("string").alias("name"),
                i.cast("int").alias("index"), F.lit(view).alias("view"), *size, own["n_words"].alias("n_words"),
            ),
        )

    return F.transform(pieces, piece)


def _groups(pieces: Column, parent: Column, strategies: Sequence[str]) -> Column:
    """A passage's pieces by equal text: the pieces in order of preference, their chunk ids, the strategies that gave them.

    The array is sorted once and cut where the hash changes, so a passage of many pieces takes no more than its sort.
    """
    strategy = lambda p: F.get(F.array(*map(F.lit, strategies)), p["view"])

    def heads(ordered: Column) -> Column:
        new = lambda p, i: (i == 0) | (p["hash"] != F.get(ordered, i - 1)["hash"])
        return F.filter(F.transform(ordered, lambda p, i: F.when(new(p, i), i)), lambda i: i.isNotNull())

    def group(own: Column) -> Column:
        ids = F.transform(own, lambda p: F.concat_ws("_", parent, strategy(p), p["index"]))
        return F.struct(own.alias("pieces"), ids.alias("ids"), F.array_sort(F.array_distinct(F.transform(own, strategy))).alias("strategies"))

    def cut(ordered: Column) -> Column:
        end = lambda at, n: F.coalesce(F.get(at, n + 1), F.size(ordered))
        return _let(heads(ordered), lambda at: F.transform(at, lambda h, n: _let(F.slice(ordered, h + 1, end(at, n) - h), group)))

    return _let(F.array_sort(pieces), cut)


def _copies(ids: Column, strategies: Column) -> Column:
    """What metadata says of a canonical chunk's copies and the strategies that gave its text, as JSON without its first brace."""
    more = F.to_json(F.struct(F.slice(ids, 2, F.size(ids)).alias("duplicate_chunk_ids"), strategies.alias("contributing_strategies")))
    return F.substring(more, 2, 1 << 30)


def _with_copies(metadata: Column, ids: Column, strategies: Column) -> Column:
    """Metadata with a canonical chunk's copies and the strategies that gave its text."""
    body = F.regexp_replace(F.coalesce(metadata, F.lit("")), r"^\{|\}$", "")
    return F.concat(F.lit("{"), body, F.when(body != "", ",").otherwise(""), _copies(ids, strategies))


def passage_chunks(records: DataFrame) -> DataFrame:
    """The whole passage as it stands. Its quality is that of the target text unless that is empty."""
    return _views(records, {"passage": None})


def paragraph_chunks(records: DataFrame, rule: BudgetRule = BudgetRule(), whole: int = WHOLE) -> DataFrame:
    """Blank-line paragraphs; where there is but one, groups of sentences by a token budget; short passages whole."""
    return _views(records, {"paragraph": rule}, whole)


def sentence_chunks(records: DataFrame, rule: WindowRule = WindowRule()) -> DataFrame:
    """Overlapping windows of sentences."""
    return _views(records, {"sentence": rule})


def adaptive_chunks(records: DataFrame, rule: AdaptiveRule = AdaptiveRule()) -> DataFrame:
    """Whole, windows or halves by the passage's length class."""
    return _views(records, {"adaptive": rule})


def chunk_views(records: DataFrame, strategies: Sequence[str] = STRATEGIES) -> DataFrame:
    """The chunks of the chosen strategies, from one pass over the passages."""
    unknown = set(strategies) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies: {', '.join(sorted(unknown))}")
    if not strategies:
        raise ValueError("no strategy is chosen")
    return _views(records, {s: RULES[s] for s in STRATEGIES if s in strategies})


def flagged_views(records: DataFrame, strategies: Sequence[str] = STRATEGIES, least_chars: int = 10) -> DataFrame:
    """``dedup_chunks`` of ``chunk_views``, found inside each passage: no shuffle. Records' ids have to differ, as
    ``ingest.dedup`` makes them."""
    unknown = set(strategies) - set(STRATEGIES)
    if unknown or not strategies:
        raise ValueError(f"strategies are {', '.join(STRATEGIES)}")
    return _views(records, {s: RULES[s] for s in STRATEGIES if s in strategies}, least_chars=least_chars)


def flagged_marks(records: DataFrame, strategies: Sequence[str] = STRATEGIES, least_chars: int = 10) -> DataFrame:
    """``flagged_views`` without texts, quality and metadata: the columns of ``MARKS``, equal to those there."""
    unknown = set(strategies) - set(STRATEGIES)
    if unknown or not strategies:
        raise ValueError(f"strategies are {', '.join(STRATEGIES)}")
    return _views(records, {s: RULES[s] for s in STRATEGIES if s in strategies}, least_chars=least_chars, texts=False)


def dedup_chunks(chunks: DataFrame, least_chars: int = 10) -> DataFrame:
    """Flag equal texts within (parent_passage_id, language), never across passages, and texts under ``least_chars``.

    The canonical chunk is that of the preferred strategy, then of the smallest id as text; its metadata
    lists the others and all strategies that gave the text.
    """
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("chunk_strategy")), F.lit(0)), F.lit(len(STRATEGIES) + 1))
    rows = chunks.withColumn("_order", order)
    group = Window.partitionBy("parent_passage_id", "language", "chunk_text_hash").orderBy("_order", "chunk_id")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_ids", F.collect_list("chunk_id").over(whole)).withColumn("_strategies", F.array_sort(F.collect_set("chunk_strategy").over(whole))).withColumn("_place", F.row_number().over(group))
    enriched = _with_copies(F.col("metadata"), F.col("_ids"), F.col("_strategies"))
    rows = rows.withColumn("metadata", F.when((F.size("_ids") > 1) & (F.col("_place") == 1), enriched).otherwise(F.col("metadata")))
    rows = rows.withColumn("is_duplicate_chunk", F.col("_place") > 1).withColumn("duplicate_of_chunk_id", F.when(F.col("_place") > 1, F.get("_ids", F.lit(0))).otherwise(F.lit("")))
    rows = rows.withColumn("below_min_length", F.col("char_count") < least_chars)
    return rows.select(*chunks.columns)


def dedup_summary(chunks: DataFrame, least_chars: int = 10) -> DataFrame:
    """Totals of ``dedup_chunks``, in one row."""
    return chunks.agg(
        F.count("*").alias("total_chunks"),
        F.count_distinct("parent_passage_id", "language").alias("passage_groups"),
        F.count_if(~F.col("is_duplicate_chunk")).alias("canonical_chunks"),
        F.count_if("is_duplicate_chunk").alias("duplicate_chunks"),
        F.count_if("below_min_length").alias("below_min_length_chunks"),
        F.lit(least_chars).cast("long").alias("min_chars_threshold"),
    )


def drop_flagged(chunks: DataFrame, duplicates: bool = False, short: bool = False) -> DataFrame:
    """Leave flagged chunks out."""
    if duplicates:
        chunks = chunks.where("not is_duplicate_chunk")
    return chunks.where("not below_min_length") if short else chunks


def drop_counts(chunks: DataFrame) -> DataFrame:
    """How many rows each drop takes; a chunk that is both duplicate and short counts as duplicate."""
    return chunks.agg(F.count_if("is_duplicate_chunk").alias("dropped_duplicates"), F.count_if(F.col("below_min_length") & ~F.col("is_duplicate_chunk")).alias("dropped_below_min"))
