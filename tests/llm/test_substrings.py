import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from turnmill.llm import substrings
from turnmill.llm.wordhash import Texts, Words
from tests.llm.conftest import SCHEMA, rows_of, sentence

K = substrings.WINDOW


def brute(rows):
    key = lambda i: (i is None, i or 0)
    least = {}
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - K + 1):
            g = tuple(w[p : p + K])
            least[g] = min(least.get(g, key(i)), key(i))
    out = Counter()
    for i, w in words:
        gone = {q for p in range(len(w) - K + 1) if least[tuple(w[p : p + K])] < key(i) for q in range(p, p + K)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def check(docs):
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert Counter(map(tuple, substrings.remove_repeats(docs).collect())) == want


def test_edges(edge_docs):
    check(edge_docs)


def test_planted_passages_runs_and_shifts(spark):
    rng = random.Random(11)
    passages = [sentence(rng, n).split() for n in (12, 13, 14, 20, 60)] + [["la"] * 40, ["a", "b"] * 25]
    texts = []
    for _ in range(120):
        w = sentence(rng, rng.randint(0, 60)).split()
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            lo = rng.randint(0, 3)
            w[at:at] = p[lo : len(p) - rng.randint(0, 3)]
        texts.append("\n".join(w) if rng.random() < 0.3 else " ".join(w))
    rows = rows_of(texts) + [(5, "another text of an id that stands twice " + " ".join(passages[4]), *[None] * 7), (None, " ".join(passages[4]), *[None] * 7)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(7))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    core = sentence(rng, 200).split() + ["x"] * 30 + ["y", "z"] * 20
    texts = [" ".join(sentence(rng, rng.randint(0, 30)).split() + core + sentence(rng, rng.randint(0, 30)).split()) for _ in range(12)]
    words = Words(Texts(pa.array(texts)))
    key, start, n = substrings.anchors(words)
    own = dict(zip(np.concatenate([np.arange(s, s + k) for s, k in zip(start, n, strict=True)]).tolist(), np.repeat(key, n).tolist(), strict=True))
    assert sorted(own) == np.flatnonzero(words.gram_ok(K)).tolist()
    by = {}
    for at, k in own.items():
        assert by.setdefault(tuple(words.hash[at : at + K].tolist()), k) == k
    assert len(key) < 0.45 * len(own)


def test_equal_windows_have_equal_anchors_in_repetitive_text():
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abc", weights=(6, 2, 1), k=rng.randint(10, 400))) for _ in range(200)]
    words = Words(Texts(pa.array(texts)))
    key, start, n = substrings.anchors(words)
    by = {}
    for k, s, m in zip(key.tolist(), start.tolist(), n.tolist(), strict=True):
        for at in range(s, s + m):
            assert by.setdefault(tuple(words.hash[at : at + K].tolist()), k) == k


def test_blocks_do_not_change_anchors(monkeypatch):
    rng = random.Random(6)
    words = Words(Texts(pa.array([sentence(rng, rng.randint(0, 300)) + " x" * rng.randint(0, 40) for _ in range(40)])))
    whole = substrings.anchors(words)
    for block in (1, 7, 64):
        monkeypatch.setattr(substrings, "BLOCK_WORDS", block)
        assert all((a == b).all() for a, b in zip(whole, substrings.anchors(words), strict=True))


def test_windows_beyond_two_to_the_24_words_keep_their_own_symbols():
    n = (1 << 24) + 2000
    at = np.arange(n)
    names = substrings.mix(at.astype(np.uint64) % np.uint64(1000))  # words come again each 1000
    symbols = substrings.Symbols(names, names, None, at, at + 1)
    starts = np.r_[np.arange(1000), np.arange(1000) + (1 << 24) // 1000 * 1000 + 1000]
    found, some = substrings._least_inside(symbols, 0, n, starts)
    assert some.all() and ((found >= starts) & (found < starts + K)).all()
    assert (found[:1000] - starts[:1000] == found[1000:] - starts[1000:]).all()


def test_no_rows(no_docs):
    assert substrings.remove_repeats(no_docs).count() == 0


def test_a_window_of_a_third_of_all_documents_and_words_of_equal_arithmetic(spark):
    """One passage in every third document; words whose polynomial hashes agree aren't equal."""
    from tests.llm.test_wordhash import mirrored

    rng = random.Random(3)
    hot, (a, b) = sentence(rng, 16), mirrored(1024)
    texts = [sentence(rng, 20) + " " + (hot if i % 3 == 0 else sentence(rng, 12)) for i in range(300)]
    texts += [f"{a} {sentence(random.Random(1), 14)}", f"{b} {sentence(random.Random(1), 14)}", f"x {a} {hot}"]
    check(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(6))
