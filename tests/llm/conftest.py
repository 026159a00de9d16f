import random

import pytest
from pyspark.sql import types as T

#: Columns with names that the operators use themselves.
CLASHING = ["row", "run", "doc", "id", "digest", "check", "first", "kept", "node", "n", "h1", "bands", "bits", "shard", "copy", "rate", "count", "ids", "both", "score", "predicted", "margin", "accepted", "lang_pred", "found", "base", "m", "symbols", "component_id", "shuffle_key", "start"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def rows_of(texts):
    return [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], *(["x"] * len(CLASHING))) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with clashing columns, in several partitions, from texts or whole rows."""

    def build(texts, parts=4, rows=None):
        return spark.createDataFrame(rows if rows is not None else rows_of(texts), SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ties."""
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "schön", "été", "naïve"]) + str(rng.randrange(50)) for _ in range(30_000))
    texts = [None, "", "   ", "\n\t", "one", "one two three four five six", "one  two three\nfour five six", long, long + " end", "$$$ !!", "word " * 4_000, "é" * 3_000, "x" * 50_000, "<|endoftext|> a <|endoftext|>", "two words"]
    rows = rows_of(texts)
    rows += [rows[5], rows[5], rows[7]]
    rows += [(None, "one two three four five six", None, None, *([None] * len(CLASHING))), (None, None, None, None, *([None] * len(CLASHING)))]
    return make(None, rows=rows)


@pytest.fixture(scope="session")
def empty(make):
    return make([]).limit(0)
