"""Column expressions over text. All but ``nfc`` stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.split sees it: characters, and a regex class of them. Fixed values. In the class those below
#: U+0100 are named one by one (Java looks these up in a table) and the others stand behind a range that most texts lack:
#: Java tries the ranges of a class one after the other on each character.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]]"
#: Normalised answers that mean none. Fixed values.
NO_ANSWER_MARKERS = ("no answer present.", "no answer present", "")
#: Half-open length buckets of the reports. Fixed values.
LENGTH_BUCKETS = ((10, "0-9"), (50, "10-49"), (100, "50-99"), (200, "100-199"), (500, "200-499"), (1000, "500-999"))


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def filled(value: str | Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(_column(value), F.lit(""))


def strip(value: str | Column) -> Column:
    """White space of any kind off both ends. ``btrim`` looks at every character, so a column is spared it where its first
    byte shows that no blank is there and its last character is a sign that texts often end with."""
    text = filled(value)
    cut = F.btrim(text, F.lit(BLANKS))
    if not isinstance(value, str):  # it might be made anew for each look
        return cut
    ends = reduce(lambda a, b: a | b, [text.endswith(c) for c in ".!?\"')"])
    return F.when((text >= "!") & (text < "\x7f") & ends, text).otherwise(cut)


#: What a look at each character alone tells to be in NFC: nothing below U+0300 changes.
LATIN = r"^[\x00-\u02FF]*$"


def _other(text: Column) -> Column:
    """Whether Python has to look at a text. Its own quick check of one takes less than a pattern that knows other scripts."""
    return ~text.rlike(LATIN)


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(value: str | Column) -> Column:
    """Unicode NFC, null as the empty string. Spark has no function for it; Latin texts never reach Python."""
    text = filled(value)
    # null where Python has nothing to do, so that the text is looked at once
    return F.coalesce(F.pandas_udf(_nfc, T.StringType())(F.when(_other(text), text)), text)


def _nfc_all(rows: pd.Series) -> pd.Series:
    return rows.map(lambda texts: None if texts is None else [None if t is None else unicodedata.normalize("NFC", t) for t in texts])


def nfc_all(values: str | Column) -> Column:
    """``nfc`` of every text of an array."""
    texts = F.transform(_column(values), filled)
    return F.coalesce(F.pandas_udf(_nfc_all, T.ArrayType(T.StringType()))(F.when(F.exists(texts, _other), texts)), texts)


def words(value: str | Column) -> Column:
    """Runs of anything but white space."""
    return F.array_remove(F.split(filled(value), f"{SPACE}+"), "")


def lower_words(value: str | Column) -> Column:
    return words(F.lower(filled(value)))


#: A blank that is neither U+0020 nor a line feed, or a second one in a row. The blank first, as in ``stripped_sentences``.
ODD_SPACE = f"{SPACE}(?<=[^ \\n]|[ \\n][ \\n])"


def is_tidy(stripped: str | Column) -> Column:
    """Whether a stripped text's words are parted by single blanks and line feeds alone, as most texts' are."""
    return ~_column(stripped).rlike(ODD_SPACE)


def plain(value: str | Column, tidy: Column | None = None) -> Column:
    """A text's words in lower case with one blank between them. What is known to be ``tidy`` (see ``is_tidy``) isn't split."""
    split = F.array_join(lower_words(value), " ")
    return split if tidy is None else F.when(tidy, F.lower(F.replace(_column(value), F.lit("\n"), F.lit(" ")))).otherwise(split)


def plain_words(value: str | Column) -> Column:
    """The words of a ``plain`` text. One blank as the separator is no pattern to Java."""
    return F.array_remove(F.split(_column(value), " "), "")


def plain_count(value: str | Column) -> Column:
    """How many words a ``plain`` text has."""
    text = _column(value)
    return F.when(text == "", 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "))) + 1)


def token_count(value: str | Column) -> Column:
    """The estimate of tokens: white-space words."""
    return F.size(words(value))


def sentences(value: str | Column) -> Column:
    """Split after . ! ? or danda where white space follows; pieces come stripped, empty ones are dropped."""
    return stripped_sentences(strip(value))


def stripped_sentences(text: str | Column) -> Column:
    """``sentences`` of a text that is stripped."""
    # the white space first: a look back from every character takes most of the time
    return F.array_remove(F.split(_column(text), f"{SPACE}(?<=[.!?।]{SPACE}){SPACE}*"), "")


def paragraphs(value: str | Column) -> Column:
    """Split at blank lines; pieces stripped, empty ones dropped."""
    return stripped_paragraphs(strip(value))


def stripped_paragraphs(text: str | Column) -> Column:
    """``paragraphs`` of a text that is stripped; one without a blank line is left as it is."""
    parts = F.array(F.split(_column(text), f"\\n{SPACE}*\\n"))
    return F.array_remove(F.get(F.transform(parts, lambda own: F.when(F.size(own) > 1, F.transform(own, strip)).otherwise(own)), F.lit(0)), "")


def dedup_text(value: str | Column) -> Column:
    """The form in which chunks are compared: white space collapsed, stripped, lower case."""
    return F.lower(strip(F.regexp_replace(filled(value), f"{SPACE}+", " ")))


def text_hash(value: str | Column) -> Column:
    return F.sha2(dedup_text(value), 256)


def has_answer(value: str | Column) -> Column:
    return ~F.lower(strip(value)).isin(*NO_ANSWER_MARKERS)


def answer_status(value: str | Column) -> Column:
    return F.when(has_answer(value), "ANSWER_PRESENT").otherwise("NO_ANSWER")


def length_bucket(value: str | Column) -> Column:
    length, out = _column(value), None
    for end, name in LENGTH_BUCKETS:
        inside = (length >= 0) & (length < end)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise("1000+")


def length_class(tokens: str | Column, short: int = 40, medium: int = 120, long: int = 250) -> Column:
    n = _column(tokens)
    return F.when(n <= short, "SHORT").when(n <= medium, "MEDIUM").when(n <= long, "LONG").otherwise("VERY_LONG")


def json_valid(value: str | Column) -> Column:
    """Null and empty count as valid."""
    text = _column(value)
    return text.isNull() | (text == "") | F.try_parse_json(text).isNotNull()


def uuid5_url(value: str | Column) -> Column:
    """uuid5 in the URL namespace, from SHA-1."""
    namespace = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    digest = F.lower(F.sha1(F.concat(namespace, F.encode(_column(value), "UTF-8"))))
    variant = F.lpad(F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128))), 2, "0")
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))
