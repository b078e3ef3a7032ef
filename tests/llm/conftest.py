import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty and blank texts, ties, repeated rows, one very long text, extra columns with clashing names."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(60)
    rows = [(1, base), (2, base), (3, base + " tail"), (4, ""), (5, None), (6, " \t\n\x0b"), (7, say(9000)), (8, "one"), (9, "one two"), (None, base), (None, None), (10, "日本語 テキスト ☃"), (10, "日本語 テキスト ☃"), (11, base.replace("a", "A")), (12, say(30))]
    return spark.createDataFrame([(i, t, None if k % 2 else "en", "s" if k % 3 else None, None, 1.0, "x") for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
