import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use for results of their own
    T.StructField("score", T.StringType()), T.StructField("component_id", T.LongType()),
    T.StructField("key", T.StringType()), T.StructField("shard", T.DoubleType())])

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, words: int, per_line: int = 12) -> str:
    draw = random.Random(seed)
    # two random letters keep texts of different seeds apart
    out = [draw.choice(WORDS) + draw.choice("bcdfg") + draw.choice("aeiou") for _ in range(words)]
    return "\n".join(" ".join(out[i:i + per_line]) + "." for i in range(0, words, per_line))


def near(text: str, every: int) -> str:
    """The text with each so-manieth word changed."""
    words = text.split(" ")
    return " ".join(w if i % every else f"new{i}" for i, w in enumerate(words))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "src", None if text is None else len(text), "x", 7, "k", 0.5)


BASE = prose(1, 400)
PASSAGE = " ".join(prose(2, 70).split())
LONG = prose(3, 40_000)
ROWS = [
    row(0, BASE), row(1, BASE), row(2, near(BASE, 60)), row(3, near(BASE, 8)), row(4, None), row(5, ""), row(6, " \n\t "),
    row(7, "one"), row(8, "one two"), row(None, prose(4, 90)), row(9, prose(5, 90), None), row(9, prose(5, 90), None),
    row(10, prose(6, 60) + "\n" + PASSAGE + "\n" + prose(7, 60)), row(11, prose(8, 60) + "\n" + PASSAGE),
    row(12, LONG), row(13, "Ünï çödé ß " * 30), row(14, "a\n" * 300), row(15, prose(9, 120))]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame(
        [(0, PASSAGE), (1, "never seen " * 20), (2, None), (3, ""), (4, "tiny"), (0, PASSAGE)],
        "item_id bigint, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 2)) for i in range(16)] + [(0, None, None), (None, 1, 1)],
                                 "doc_id bigint, quality int, toxic int")
