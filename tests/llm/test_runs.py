"""Periodic runs against brute force."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA, rows_of
from turnmill.llm import runs


def brute_runs(words, min_length=6, min_exponent=4):
    """Every period is tried at every place."""
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(min_length, min_exponent * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute(doc_id, text, rewrite=False):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if rewrite and h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(words), len(found), *shown, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def seeded(docs):
    from pyspark.sql import functions as F

    return docs.withColumn("seed", F.crc32(F.col("doc_id").cast("string").cast("binary")))


def periodic_texts():
    rng, out = random.Random(3), []
    for _ in range(250):
        words = [f"w{rng.randrange(rng.choice([1, 2, 3, 30]))}" for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            unit = [f"u{rng.randrange(4)}" for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * 7)[: rng.randrange(7 * len(unit))]
        out.append(rng.choice([" ", "\n", " \t"]).join(words))
    return out


@pytest.mark.parametrize("rewrite", [False, True])
def test_equals_brute_force(spark, edge_texts, rewrite):
    texts = periodic_texts() + edge_texts
    rows = rows_of(texts)
    docs = spark.createDataFrame([*rows, rows[3], rows[3], (None, "a a a a a a b", *rows[0][2:])], SCHEMA).repartition(5)
    found = runs.periodic_runs(seeded(docs), rewrite=runs.repeated_tail if rewrite else None, seed_col="seed")
    want = Counter(brute(r[0], r[1], rewrite) for r in docs.collect())
    assert Counter(map(tuple, found.collect())) == want and sum(n for r, n in want.items() if r[2]) > 100


def test_runs_and_texts_come_out(spark):
    docs = spark.createDataFrame([(1, "x a b a b a b a b y"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.periodic_runs(docs, with_text=True).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 8, 2)] and got[1].collapsed == "x a b y"
    assert got[2].runs == [] and got[2].collapsed == ""


@pytest.mark.parametrize("length, exponent", [(2, 2), (3, 3), (9, 2), (6, 5)])
def test_other_limits(length, exponent):
    rng = random.Random(length)
    for _ in range(150):
        texts = [[rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(60))] for _ in range(5)]
        hashes = np.array([x * 0x9E3779B97F4A7C15 % 2**64 for t in texts for x in t], dtype=np.uint64)
        found = runs.runs_of(hashes, np.cumsum([0, *map(len, texts)]), length, exponent)
        assert [found.get(i, []) for i in range(5)] == [brute_runs(t, length, exponent) for t in texts]


def test_long_repetitive_texts_take_no_square_of_their_length():
    period = list(range(1000))
    for words in ([1] * 300_000, [1, 2] * 150_000, period * 300, [x for k in range(300) for x in [5000 + k, *[1] * 300]]):
        began = time.perf_counter()
        found = runs.runs_of(np.array(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array([0, len(words)]), 6, 4)
        assert found[0] and time.perf_counter() - began < 60


def test_no_documents(spark, no_docs):
    assert runs.periodic_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(no_docs, min_exponent=1)
