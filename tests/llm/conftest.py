import pytest

#: Names that operators use inside or give out.
CLASHES = "key row rest fp component hits items spans n_words n_hit n_lines n_dropped keep places lost line_counts x score label predicted ids sections hash bytes cell depth shard run block a b u v".split()
LONG = " ".join(f"word{i % 977} and the thing{i % 31}." + ("\n" if i % 9 == 0 else "") for i in range(12_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, LONG),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (7, "unique first line of text\nshared line that many have\n\nshared line that many have"),
    (8, "  SHARED line that many have\t\nanother unique ending here"),
    (8, "  SHARED line that many have\t\nanother unique ending here"),
    (None, "shared line that many have"),
    (None, None),
    (11, "ça où é 日本語 🙂 \u0000 weird"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    from pyspark.sql import functions as F

    return frame.select("doc_id", "text", F.lit(1).alias("lang"), *[F.lit(f"c_{c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def none(spark, docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 1), (7, 0, 1), (8, None, None), (None, 1, 1), (99, 0, 0), (11, 7, 7)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river and more"), (2, None), (3, ""), (None, "unique first line"), (4, "Unique FIRST line"), (4, "unique first line"), (5, "no such words at all here")], "item_id long, text string")
