import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Names that the operators use inside; a table may have them as extra columns.
CLASHING = ["score", "rank", "node", "n", "tokens", "hash", "line", "lines", "text_hash", "key", "n_values", "kept", "n_removed", "label"]

PROSE = (
    "The river ran slowly past the old mill, and nobody in the village could remember a summer as dry as this one. "
    "Children walked along the stones that had been under water for years, while their parents counted the days "
    "until the harvest and spoke in low voices about the price of grain, the state of the roads and the new bridge."
)


def schema():
    return StructType(
        [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())]
        + [StructField(c, StringType()) for c in CLASHING]
    )


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["own"] * len(CLASHING))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    return [
        row(1, PROSE),
        row(1, PROSE),  # the same row again
        row(2, PROSE + " One more sentence ends this copy."),
        row(3, None),
        row(4, ""),
        row(5, " \n\t\n "),
        row(6, long),
        row(None, PROSE),
        row(None, "A short one."),
        row(7, "x", None, None),
        (8, "y" * 50_000, None, None, None, *[None] * len(CLASHING)),
        row(9, "Dup\nDup\nDup"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, schema()).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], schema())


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2, "own") for i in range(1, 10)] + [(None, 1, 1, None), (1, None, None, None), (99, 0, 1, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")
