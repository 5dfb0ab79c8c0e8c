import hashlib
import random
import re
from collections import Counter

import pytest

from turnmill.llm import decontamination
from tests.llm.conftest import SCHEMA, rows_of, sentence


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(None if item is None else str(item))
    out = Counter()
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(g) for g in windows}:
            for p in range(len(w) - k + 1):
                own = windows.get(tuple(w[p : p + k]))
                if own is not None:
                    hit |= set(range(p, p + k))
                    found |= own
        found.discard(None)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[(doc, len(w), len(hit), len(found), sha, bool(hit))] += 1
    return out


@pytest.mark.parametrize("bound", [10**6, 0])
def test_both_ways_equal_brute_force(spark, edge_texts, bound):
    rng = random.Random(6)
    items = [(i, sentence(rng, n)) for i, n in enumerate([3, 9, 10, 11, 25, 40, 12, 1])] + [(10, None), (11, ""), (None, sentence(rng, 14)), (3, sentence(rng, 12)), (2, "twice said " * 8)]
    texts = list(edge_texts)
    for _ in range(80):
        w = sentence(rng, rng.randint(0, 50)).split()
        item = rng.choice(items)[1] or ""
        own = item.split()
        lo, hi = sorted(rng.choices(range(len(own) + 1), k=2))
        w[rng.randint(0, len(w)) : 0] = own[lo:hi] if rng.random() < 0.6 else own
        texts.append((" " if rng.random() < 0.5 else "-").join(w).upper())
    docs = spark.createDataFrame([*rows_of(texts), *rows_of(texts)[30:33]], SCHEMA).repartition(4)
    bench = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, `window` string")
    got = decontamination.contamination(docs, bench, broadcast_postings=bound)
    assert Counter(map(tuple, got.collect())) == brute([(r.doc_id, r.text) for r in docs.collect()], items)
    kept = decontamination.contamination(docs, bench, broadcast_postings=bound, keep=("text", "source"))
    assert Counter((r.doc_id, r.text, r.source, r.contaminated) for r in kept.collect()) == Counter((r.doc_id, r.text, r.source, c.contaminated) for r, c in zip(sorted(docs.collect(), key=str), sorted(docs.join(got.dropDuplicates(["doc_id"]), "doc_id").collect(), key=str), strict=True))


@pytest.mark.parametrize("bound", [10**6, 0])
def test_empty_sides(spark, no_docs, edge_docs, bound):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert decontamination.contamination(no_docs, bench, broadcast_postings=bound).count() == 0
    none = decontamination.contamination(edge_docs, bench.limit(0), broadcast_postings=bound - 1)
    assert not none.filter("contaminated").count() and none.count() == edge_docs.count()


@pytest.mark.parametrize("bound", [10**6, 0])
def test_words_of_equal_arithmetic_are_no_hits(spark, bound):
    from tests.llm.test_wordhash import mirrored

    a, b = mirrored(1024)
    items, texts = [(1, f"one two {a} four five six seven eight nine ten"), (2, b)], [f"one two {b} four five six seven eight nine ten", a, f"x one two {a} four five six seven eight nine ten"]
    docs, bench = spark.createDataFrame(rows_of(texts), SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs, bench, broadcast_postings=bound)
    assert Counter(map(tuple, got.collect())) == brute([(r.doc_id, r.text) for r in docs.collect()], items)
