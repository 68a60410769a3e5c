"""Small tables of documents with the awkward cases."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, _key string, range string"


def rows_of(texts, start=0):
    """Rows with columns whose names clash with those the operators use inside."""
    return [(start + i, t, ("en", "de", None)[i % 3], ("a", "b", "c", None)[i % 4], None if t is None else len(t), i, "k", "r") for i, t in enumerate(texts)]


def texts_of(seed=5, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["é", "naïve", "一丁", "x\ny", "<s>", "A.B", "%%%", "▁"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 150))) for _ in range(n)]
    near = []
    for t in base[:20]:
        parts = t.split(" ")
        for _ in range(r.randint(0, 4)):
            parts[r.randrange(len(parts))] = r.choice(words)
        near.append(" ".join(parts))
    passage = " ".join(r.choice(words) for _ in range(70))
    shared = [f"{t} {passage} {t[::-1]}" for t in base[20:30]]
    odd = [None, "", " ", "\n\n", "one", "a b c d", "  lead  and  trail  ", "same line\n" * 80, "word " * 400, "".join(chr(0x4E00 + i % 500) for i in range(9000)), "x" * 30000]
    return base + near + shared + odd + base[:5]


@pytest.fixture(scope="session")
def texts():
    return texts_of()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = rows_of(texts)
    rows += [(None, "no id at all " * 20, "en", "a", 1, 1, "k", "r"), (3, rows[3][1], "en", "a", 1, 1, "k", "r"), (4, "another text under a used id " * 9, "de", "b", 1, 1, "k", "r")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
