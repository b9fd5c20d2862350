"""Small tables with the awkward cases that every operator meets."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", block long, n long, key long, word string, rank int, kept string, score double"

PROSE = ("The committee met on Tuesday to look at the plans for the river bank and heard what the engineers had found about the "
         "old wall before the members asked how long the work would take and who was going to pay for all of it in the end.")


def awkward_rows():
    """Nulls, empty and blank texts, repeats, ties, one very long text, one very long word."""
    long_text = " ".join(f"{PROSE.split()[i % 40]}{i % 97}" for i in range(20_000))
    return [
        (1, PROSE, "en", "a", 1), (2, PROSE, None, None, None), (3, None, "en", "a", 0), (4, "", "", "", 0), (5, " \t\n ", "en", "b", 4),
        (6, "one", "en", "b", 3), (7, "one", "en", "b", 3), (7, "one", "en", "b", 3), (8, "word " * 300, "en", "b", 1500),
        (9, long_text, "en", "a", len(long_text)), (10, "x" * 100_000, "en", "a", 100_000), (11, long_text + " end", "en", "a", 1),
        (None, PROSE, "en", "a", 1), (None, None, None, None, None), (12, PROSE.upper() + "\n" + PROSE, "en", "c", 1),
        (13, "déjà vu ▁ ☃ \x00 \U0001f600 fin", "fr", "c", 1), (14, "a b c d", "en", "c", 7), (15, "A B  C\tD", "en", "c", 8),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """The same documents with columns of names that the operators use inside."""
    from pyspark.sql import functions as F

    names = ("block", "n", "key", "word", "rank", "kept", "score", "fid", "path", "unit", "size", "data", "bucket", "component", "s1", "__key")
    df = spark.createDataFrame(awkward_rows(), SCHEMA).where("doc_id IS NOT NULL")
    return df.select("*", *[F.lit("x").alias(c) for c in names])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
