import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _salt int, digest string"


def make_docs(spark, rows):
    """rows of (doc_id, text, source); the other columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, nulls, empty and long texts, repeated rows, a hot source and a hot text."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    rows = [(i, say(rnd.randint(1, 200)), f"s{min(i % 9, 3)}") for i in range(120)]
    for i in range(120, 160):
        words = rows[i - 120][1].split(" ")
        words[rnd.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "s3"))
    rows += [(i, "One and  the same\ttext,\nmany times over " + "again " * 20, "s1") for i in range(160, 220)]
    rows += [(220, None, None), (221, "", "s1"), (222, " \n\t", "s2"), (223, say(20_000), None), (224, "Tie", "s0"), (224, "Tie", "s0"), (225, "tie", "s0")]
    rows += [(226, "word\x1cone\xa0two \x85 ÄÖ Straße İı ſ Σς", "s2"), (227, "x" * 30_000, "s9"), (None, rows[3][1], "s3"), (None, None, None)]
    return rows


@pytest.fixture()
def docs(spark, corpus):
    return make_docs(spark, corpus)


@pytest.fixture()
def no_docs(spark):
    return make_docs(spark, [])
