import random

import pytest

LONG = "lorem ipsum dolor " * 20_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and very long texts, repeated rows, and columns named like the operators' own."""
    rng = random.Random(4)
    words = ["the", "und", "der", "you", "idiot", "a", "éà", "x1", "<|", "\\"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 30]))) + ("\nsame line here" if i % 2 else ""), "en" if i % 3 else "de", f"s{i % 7}", i) for i in range(60)]
    rows += [(None, "no id", None, None, None), (None, None, None, None, None), (70, None, "en", "s1", 0), (71, "", "en", None, 0), (72, LONG, "en", "s2", 1), (73, "y" * 300_000, None, "s2", 1), (5, *rows[5][1:]), (5, *rows[5][1:]), (74, "...\n\n \n", "de", "s3", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("ids", "node", "n", "line", "gram", "label", "words", "held_out", "score", "lines", "window", "keeper", "size"):
        df = df.withColumn(name, df["n_chars"])
    return df.coalesce(3)


@pytest.fixture(scope="session")
def nothing(spark, odd):
    return odd.where("false")
