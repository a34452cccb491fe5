import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, k long, sig long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): nulls, empties, ties, repeats, near copies, a long text."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(30, 200)) for _ in range(20)]
    passage = words(rng, 90)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[0]) for i in range(12)]
    for i in range(25):  # near copies of one text, with a few words changed
        w = base[1].split(" ")
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, words(rng, 40) + " " + passage + " " + words(rng, 30)) for i in range(8)]
    rows += [(400, None), (401, ""), (402, "  \n\t "), (403, "One"), (404, "one"), (405, "two words"), (406, "é" * 1500 + " ß"), (407, "a" * 3000), (408, words(rng, 6000)), (5, base[5]), (None, base[6]), (409, "\x00nul\x00 " + base[2])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With more columns than asked for, some with names that operators use inside."""
    return spark.createDataFrame([(i, t, None, None, len(t) if t is not None else None, "x", 1, 2) for i, t in corpus], DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
