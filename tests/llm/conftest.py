import random

import pytest
from pyspark.sql import functions as F

SYLLABLES = "th er on an in ed re ha en ti or st ou le ing and".split()


def prose(draws: random.Random, n: int) -> str:
    word = lambda: "".join(draws.choice(SYLLABLES) for _ in range(draws.randint(1, 4)))
    return " ".join(draws.choice(["the", "of", "and", word(), word(), word()]) + draws.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank, tied, repeated and very long texts, copies and near copies."""
    draws = random.Random(4)
    base = [prose(draws, n) for n in (4, 5, 60, 200, 300)]
    edited = base[4].split()
    edited[150] = "changed"
    texts = [*base, base[3], "  ".join(base[3].split()), " ".join(edited), " ".join([*edited, "tail", "words"]), base[2].upper()]
    texts += ["", "   \t\n", None, "!!! ???", "日本語 のテキスト", "a" * 70_000, prose(draws, 20_000), "x y z", "X Y z"]
    rows = [(i, t, draws.choice(["en", "de", None]), draws.choice(["s1", "s2", None])) for i, t in enumerate(texts, 10)]
    return [*rows, rows[3], rows[3], (None, base[4], "en", "s1"), (None, None, None, None), (10, base[3], None, "s1")]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows in several partitions, with columns whose names an operator might use itself."""
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string").repartition(3, "doc_id")
    for name in ("n_chars", "kept", "_run", "_own", "score", "component", "row", "key", "size", "_statistics0"):
        df = df.withColumn(name, F.lit(7).cast("bigint"))
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
