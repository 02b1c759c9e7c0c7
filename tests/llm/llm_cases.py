"""Small odd tables for the training-data operators: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = [a + b for a in "ba ce di fo gu ka le mi no pu ra se ti vo zu".split() for b in "lan mer tos vin dor kes pal rum".split()]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """(doc_id, text): prose, exact and near copies, shared passages, and the odd cases."""
    rng = random.Random(7)
    base = [prose(rng, rng.choice([3, 12, 40, 90, 200, 400])) for _ in range(40)]
    rows = list(enumerate(base))
    hub = prose(rng, 120)
    rows += [(100 + i, edited(rng, hub, 0.01)) for i in range(30)]              # a large group of near copies
    rows += [(200 + i, base[i % 3]) for i in range(15)]                          # exact copies
    rows += [(300 + i, edited(rng, base[i], 0.04)) for i in range(20)]
    passage = prose(rng, 70)
    rows += [(400 + i, f"{prose(rng, 30 + i)} {passage}\n{prose(rng, 50 + i)}") for i in range(12)]
    rows += [(500, None), (501, ""), (502, "  \t \n "), (503, "one"), (504, "ONE"), (505, "one two"), (506, "la " * 300),
             (507, "la " * 260), (508, "x" * 5000), (509, "été naïve 日本語 \U0001f600 " * 9),
             (510, prose(rng, 6000)), (511, "!!! ??? ..."), (600, "same id one text " + base[5]), (600, "same id other text " + base[6]),
             (601, base[7]), (601, base[7]), (None, base[8]), (None, None), (None, prose(rng, 25))]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark, texts):
    """The texts with the other columns of documents and some whose names clash with results."""
    rows = [(i, t, "en", "src", None if t is None else len(t), 1, "x", 2.0) for i, t in texts]
    shape = T.StructType([*DOCS.fields, T.StructField("n", T.IntegerType()), T.StructField("component_id", T.StringType()),
                          T.StructField("n_words", T.DoubleType())])
    return spark.createDataFrame(rows, shape).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def groups(nodes, links):
    """Smallest node of each node's component."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
