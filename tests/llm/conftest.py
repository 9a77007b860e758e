import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, size int, label string, key string"


def make(spark, rows):
    """documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), 1, 2, "x", None) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return lambda rows: make(spark, [(*r, "s")[:3] if len(r) < 3 else r for r in rows])


@pytest.fixture(scope="session")
def labels(spark):
    def build(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")

    return build


def words(n, seed, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


EDGE = [
    (None, "a row without an id", "s"),
    (1, None, "s"),
    (2, "", None),
    (3, " \n\t ", "s"),
    (4, "one", "s"),
    (5, "one", "t"),
    (6, "very long " + "ü#x " * 60_000, "s"),
    (7, "twice the same row of text here", "s"),
    (7, "twice the same row of text here", "s"),
    (8, "日本語 テキスト “quotes” 🙂 \x00 end", "s"),
]


def fold(i):
    return zlib.crc32(str(i).encode()) % 3
