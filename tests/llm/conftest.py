import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, label string, key string, rank int, score double, n_lines int, u string"


def doc(i, text, lang="en", source="s", **more):
    return (i, text, lang, source, None if text is None else len(text), more.get("size", 9), "x", "k", 1, 0.5, 3, None)


@pytest.fixture(scope="session")
def frame(spark):
    """docs(rows) with extra columns whose names clash with the operators' own."""
    return lambda rows: spark.createDataFrame(rows, DOC).repartition(2) if rows else spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls in every column, empty, blank and long texts, repeated rows, equal texts."""
    r = random.Random(3)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(r.randrange(500)) for _ in range(30_000))
    rows = [
        doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(4, "one"), doc(5, "one"), doc(6, long), doc(7, long + " tail"), doc(None, "one"), doc(None, None, None, None),
        doc(8, "a b c d e f g", None, None), doc(8, "a b c d e f g", None, None), doc(9, "1234 5678"), (10,) + (None,) * 11,
    ]
    return frame(rows)


@pytest.fixture(scope="session")
def nothing(frame):
    return frame([])


def words(r, n, stem="w", of=5000):
    return " ".join(f"{stem}{r.randrange(of)}" for _ in range(n))
