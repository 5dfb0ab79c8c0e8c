import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, rank long, size string, `_part` int, `length` string, `key` string"
WORDS = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta,", "eta.", "Theta", "iota", "kappa", "lambda|", "mu#", "nu", "xi", "omicron", "pi"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n))


def rows_of(texts):
    """Documents rows: nulls in the other columns and extra columns whose names clash with inner ones."""
    return [(i, t, None if i % 5 == 0 else ["en", "fr"][i % 2], None if i % 7 == 0 else f"s{i % 3}", i, "x", 1, None, "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def edge_texts():
    """Null, empty, blank and very long texts, copies, near copies and odd characters."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    return [
        None, "", "   \n\t ", "one", "two words", base, base, " ".join(near), base.upper(),
        "a" * 5000, sentence(rng, 6000), "x y z w v u", "ünï cödé 𝔘𝔫𝔦 日本語 é <|endoftext|> don't",
        "line\nline\nline\n\nother", sentence(rng, 15), None, "\x00 nul \x1f sep", sentence(rng, 60) + "\n" + base,
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_texts):
    rows = rows_of(edge_texts)
    rows += [rows[5], (None, "a document without id " * 4, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
