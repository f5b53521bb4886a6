from __future__ import annotations

import random

import pytest

WORDS = "river stone cloud paper engine violet marble candle forest signal harbor copper meadow lantern orbit quartz".split()


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): plain texts, exact and near copies, edge cases; ids are not dense."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))
    rows = []
    add = lambda t, src="a", lang="en": rows.append((len(rows) * 3 + 1, t, lang, src, None if t is None else len(t)))
    for _ in range(30):
        add(text(rng.randrange(5, 80)), rng.choice(["a", "b", "c", None]))
    base = text(120).split(" ")
    for k in range(25):
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        add(" ".join(w), "hot")
    for _ in range(6):
        add(rows[0][1])
    add(rows[0][1].replace(" ", "\t \n", 1))
    add(rows[0][1].upper())
    for t in (None, "", " \n\t ", "one", "ONE", "one two", "x" * 9000, "y " * 4000):
        add(t, None, None)
    return rows


@pytest.fixture(scope="session")
def frame(spark, corpus):
    """The corpus with extra columns, some with names that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"size": F.lit(7), "zone": F.lit("z"), "u": F.lit(1), "digest": F.lit("d"), "host": F.lit("h")}).repartition(5)
