import random

import pytest

SYLLABLES = ["ka", "to", "mi", "re", "sol", "ven", "da", "lu", "pri", "ost", "ne", "qui"]


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def corpus():
    """doc_id and text: originals, copies, near copies, shared passages, periodic and odd texts."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 70))
    base = words(rng, 150)
    texts = {}
    for i in range(12):
        texts[i] = " ".join(words(rng, rng.randint(20, 140)))
    for i in range(12, 16):
        texts[i] = " ".join(words(rng, 30)) + "\n" + passage + "\n" + " ".join(words(rng, 25))
    for i in range(16, 22):
        near = list(base)
        near[rng.randrange(len(near))] = f"word{i}"
        texts[i] = " ".join(near)
    texts[22] = texts[3]
    texts[23] = "la " * 120
    texts[24] = "Ünï çödé – " * 60
    texts[25] = " ".join(words(rng, 30_000))
    texts[26], texts[27], texts[28], texts[29] = "", "   \n\t ", None, "one two"
    return texts


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names clash with inner ones, and a row without an id."""
    rows = [(i, t, "x", i, "y", 1.0, 2) for i, t in texts.items()] + [(None, texts[0], "x", 0, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, anchor string, node long, body string, score double, text_key int").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
