import random

import pytest

from wardline.llm.common import write_table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, digest string, key string, leaf int, n int, target string"
EXTRA = (1, "d", "k", 2, 3, "t")  # columns whose names the operators use inside


def sentence(rng, count, words=None):
    words = words or ["river", "stone", "lamp", "garden", "winter", "paper", "engine", "yellow", "mountain", "letter", "signal", "copper", "window", "harbor", "thread", "violet"]
    return " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(count))


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source) with further columns of clashing names."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *EXTRA) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in every column, empty and blank texts, repeated rows, one very long text."""
    rng = random.Random(3)
    long = sentence(rng, 30_000)
    plain = sentence(rng, 80)
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, plain, "en", "a"), (4, plain, "en", "a"), (None, plain, None, "b"),
        (5, plain.replace("river", "river "), "de", "b"), (6, long, "en", "b"), (7, long + " tail", "xx", "c"), (8, "!!! 123 ###", "en", None), (9, "one", "en", "c"),
    ]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return write_table(documents(spark, odd_rows), "odd")


@pytest.fixture(scope="module")
def none(spark):
    return write_table(documents(spark, []), "none")
