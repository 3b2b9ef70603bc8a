import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])

#: Rows that every operator must take: nulls, empty, blank, one word, long, repeated rows.
ODD = [(None, None), (None, "alone"), (900, None), (901, ""), (902, " \n\t "), (903, "word"),
       (904, "lang " * 30_000), (905, "x" * 100_000), (906, "twice the same row"), (906, "twice the same row")]


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def clashing(spark):
    """Columns that the operators use inside, in the input."""
    names = ("doc_id", "text", "n_chars", "kept", "rep", "key", "spans", "_base", "_id", "ids", "start", "bits")
    return spark.createDataFrame([(1, "some words of a text", *names[2:]), (2, "other words of a text", *names[2:])],
                                 ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))


@pytest.fixture(scope="session")
def given(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


@pytest.fixture
def prose():
    """Random prose that is equal for equal seeds."""
    def make(seed, words, vocabulary=5_000):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary):x}q" for _ in range(words))

    return make
