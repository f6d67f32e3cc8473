"""Fixtures of the training-data operators: small tables with every odd case."""

import pytest
from pyspark.sql import types as T

WORDS = ["river", "stone", "cloud", "amber", "violet", "copper", "meadow", "lantern", "harbour", "thistle", "saffron", "willow",
         "granite", "falcon", "juniper", "marble", "orchid", "pebble", "quartz", "raven", "silver", "timber", "umbra", "velvet"]
# names that the operators use for columns of their own
CLASHES = ["row", "rejected", "d", "s", "n", "t", "k", "r", "shard", "score", "size", "key", "bucket", "label", "w"]


def sentence(seed: int, n: int) -> str:
    """n words without an order that repeats soon."""
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def frame(spark, rows, clashes=True):
    """documents rows (doc_id, text, lang, source, n_chars) with clashing extra columns."""
    names = CLASHES if clashes else []
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                           *[T.StructField(c, T.StringType()) for c in names]])
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["x"] * len(names)) for i, t, s in rows], schema)


ODD = [
    (1, None, "b"), (2, "", "b"), (3, "   \n\t ", "a"), (4, "one", "a"), (5, "One two three four", None),
    (6, sentence(6, 30), "a"), (7, sentence(6, 30), "a"), (7, sentence(6, 30), "a"), (8, sentence(8, 5000), "c"),
    (None, sentence(9, 40), None), (None, None, None), (10, "Straße İstanbul ΣΑΣ naïve 日本語 👍", "ß"), (11, sentence(11, 40), "c"),
    (11, sentence(12, 40), "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")
