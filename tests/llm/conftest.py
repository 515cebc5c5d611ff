import random

import pytest

WORDS = ["the", "of", "and", "rain", "stone", "river", "light", "market", "paper", "green", "window", "seven", "north", "glass", "bread", "cloud", "wheel", "table", "iron", "silver"]


@pytest.fixture(scope="session")
def prose():
    """A text of n words from a seed."""

    def make(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def hard_docs(spark, prose):
    """Nulls, empty and very long texts, copies, ties, repeated rows, clashing column names."""
    a = prose(120, 1)
    near = a.split()
    near[60] = "changed"
    rows = [
        (0, a, "en", "s1"), (1, a, "en", "s1"), (2, " ".join(near), "en", None), (3, None, None, "s1"), (4, "", "en", "s2"), (5, "  \n\t ", "de", "s2"), (6, "Two Words", "en", "s2"), (7, "two words", "en", "s2"),
        (8, prose(60000, 2), "en", "s3"), (9, "12 34 !!", None, "s3"), (None, a, "en", "s1"), (0, a, "en", "s1"), (10, prose(40, 3), "fr", "s1"), (11, "Ünïcode çafé " + prose(20, 4), "fr", "s1"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "'x' as node", "1 as key", "2 as part", "3 as k1", "4 as shard", "5 as score", "6 as rate", "7 as seed", "8 as tokens", "9 as content_digest", "10 as size")


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.limit(0)
