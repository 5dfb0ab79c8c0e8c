import random
import time
import re
from collections import Counter

import numpy as np
import pytest

from turnmill.llm import jaccard
from tests.llm.conftest import SCHEMA, rows_of, sentence


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b, key=key)] = min(a, b, key=key)
    return Counter((rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows)))


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, jaccard.similar_components(docs).collect())) == brute(rows)


def check_links(docs):
    rows = [(r.doc_id, shingles(r.text)) for r in docs.select("doc_id", "text").collect()]
    want = Counter((k, sum(i != j and bool(a & b) and 100 * len(a & b) >= 80 * len(a | b) for j, (_, b) in enumerate(rows))) for i, (k, a) in enumerate(rows))
    got = jaccard.similar_components(docs, with_links=True).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == want
    return got


def test_edges(edge_docs):
    check(edge_docs)


def test_links_of_edges(edge_docs, no_docs):
    check_links(edge_docs)
    assert jaccard.similar_components(no_docs, with_links=True).count() == 0


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_every_link_counts_once(spark, monkeypatch, block):
    """Dense clusters, chains whose ends don't link, exact copies and pairs that meet in several groups."""
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", block)
    rng = random.Random(block)
    texts = []
    for size in (4, 9, 12, 30, 60, 150):
        w = sentence(rng, size).split()
        for _ in range(25):
            w = list(w)
            w[rng.randrange(len(w))] = f"w{rng.randrange(9)}"
            texts += [" ".join(w)] * rng.choice([1, 1, 1, 3])
            near = w + ["end"]
            texts.append(" ".join(near[rng.randrange(2):]))
    rows = rows_of(texts) + [(None, texts[40], *[None] * 7), (7, texts[80], *[None] * 7)]
    got = check_links(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert max(r.n_links for r in got) > 5


@pytest.mark.parametrize("block", [1_000_000, 700])
def test_near_copies_at_every_size_and_distance(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", block)
    rng = random.Random(block)
    line = "this very common line stands in a great many documents of all kinds"
    texts = []
    for size in (3, 5, 6, 8, 9, 10, 11, 12, 13, 20, 34, 36, 40, 130, 140, 520):
        base = sentence(rng, size).split()
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randint(0, 1 + size // 45)):
                at = rng.randrange(len(w))
                rng.choice([lambda: w.insert(at, "new"), lambda: w.__setitem__(at, "odd"), lambda: w.append("end"), lambda: w.pop(at) if len(w) > 1 else None])()
            if rng.random() < 0.2:
                w += line.split()
            texts.append(" ".join(w))
        texts += [line, line.upper() + " " + sentence(rng, 3)]
    rng.shuffle(texts)
    rows = rows_of(texts) + [(3, texts[10] + " tail", *[None] * 7), (None, texts[11], *[None] * 7)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_linked_sets_share_enough_keys():
    """The pigeonhole promise, over random sets at the threshold and every size up to several bands."""
    rng = np.random.default_rng(7)
    for n in [*range(4, 140), 300, 511, 512, 640, 1000, 2047, 2500]:
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for _ in range(3):
            drop = rng.integers(0, n // 5 + 1)
            room = int((n - drop) / 0.8 - n)
            b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 2**63, rng.integers(0, max(room, 0) + 1)).astype(np.uint64)])
            if not jaccard.linked(a, b) or len(a) == len(b) == len(np.intersect1d(a, b)):
                continue
            keys = np.intersect1d(jaccard.sketch_keys(a), jaccard.sketch_keys(b))
            small = max(jaccard._band(len(a)), jaccard._band(len(b))) == 0
            assert len(keys) >= (1 if small else jaccard.COMMON), (len(a), len(b))


def test_bit_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, int(k)).astype(np.uint64)) for k in rng.integers(1, 300, 20)]
    sets += [np.unique(np.r_[s[5:], rng.integers(0, 2**63, 9).astype(np.uint64)]) for s in sets]
    sketch = jaccard.bit_sketches(sets, 512)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.bitwise_count(sketch[i] ^ sketch[j]).sum() <= len(np.setxor1d(a, b))


def test_no_rows(no_docs):
    assert jaccard.similar_components(no_docs).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    from turnmill.llm.components import connected_components

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (-5, 300), (300, 301), (301, -5)]
    edges += [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_near_copies_in_a_group_take_little_memory():
    """Screening and comparing hold a row of pairs at a time, not all of them."""
    import tracemalloc

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.r_[base[5:], rng.integers(0, 2**63, 5).astype(np.uint64)]) for _ in range(3000)]
    size, side = np.array([len(s) for s in sets]), np.zeros(len(sets), dtype=int)
    sketch = [jaccard.bit_sketches([s], jaccard.sketch_bits(len(s)))[0] for s in sets]
    names = np.array([jaccard.set_name(s) for s in sets]).view(np.int64)
    tracemalloc.start()
    assert jaccard.near_members(size, sketch, side, False).all()
    edges, found = jaccard.group_links(names, sets, side, False, np.ones(len(sets), dtype=int), [[1]] * len(sets), 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(edges) == len(sets) - 1 and (found == len(sets) - 1).all() and peak < 40 << 20


def test_words_of_equal_arithmetic_are_no_copies(spark):
    from tests.llm.test_wordhash import mirrored

    check(spark.createDataFrame(rows_of([*mirrored(1024), *mirrored(4096)]), SCHEMA))


def test_first_rows_are_rows_not_ids(spark):
    rng = random.Random(2)
    a, b, c, d = (sentence(rng, 40) for _ in range(4))
    rows = [(7, a), (9, b), (9, a + " more"), (None, c), (None, c + " more"), (None, c), (12, None), (12, None), (None, None), (13, ""), (9, b), (2**63 - 1, d)]
    docs = spark.createDataFrame([(i, t, k, k, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, key1 int, node int, `row` string, first int").repartition(3)
    got = jaccard.first_rows(docs)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert {k: n for k, n in kept.items() if k[1] and k[1][:9] == c[:9]} in ({(None, c): 1}, {(None, c + " more"): 1})
    assert {k: n for k, n in kept.items() if not (k[1] and k[1][:9] == c[:9])} == {(7, a): 1, (9, b): 1, (12, None): 1, (None, None): 1, (13, ""): 1, (2**63 - 1, d): 1}
    assert jaccard.first_rows(docs.limit(0)).count() == 0


def test_connected_sets_without_counts():
    rng = np.random.default_rng(7)
    for n in (1, 2, 40):
        base = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(4)]
        sets = [np.unique(np.r_[np.delete(b, rng.integers(0, len(b), rng.integers(0, 4))), rng.integers(0, 60, 2)]).astype(np.uint64) for b in (base[rng.integers(4)] for _ in range(n))]
        names, side, copies, centers = np.arange(n) + 5, np.zeros(n, dtype=int), np.ones(n, dtype=np.int64), [[1]] * n
        stars = [sorted(jaccard.group_links(names, sets, side, False, copies, centers, 1, counts)[0]) for counts in (True, False)]
        assert stars[0] == stars[1]


def test_near_copies_without_counts_take_linear_time():
    rng = np.random.default_rng(8)
    base, spent = rng.integers(0, 1 << 62, 60).astype(np.uint64), []
    for n in (5_000, 20_000):
        sets = []
        for _ in range(n):
            own = base.copy()
            own[rng.integers(0, 60, 3)] = rng.integers(0, 1 << 62, 3)
            sets.append(np.unique(own))
        began = time.perf_counter()
        assert set(jaccard.connected_sets(sets).tolist()) == {0}
        spent.append(time.perf_counter() - began)
    assert spent[1] < 10 * spent[0] + 1
