import random
import re
from collections import Counter

import pytest

from turnmill.llm import quality
from tests.llm.conftest import SCHEMA, rows_of, sentence


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {q for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for q in range(i, i + 3)}
    symbols, chars = sum(c in "#*$%&|<>" for c in t), sum(map(len, w))
    dup = len(lines) - len(set(lines))
    base = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    up, low = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    lettered = sum(any(c >= "\x80" or c.isascii() and c.isalpha() for c in x) for x in w)
    bad = 100 * symbols > 10 * len(w) or 100 * dup > 30 * len(lines) or not 2 * len(w) <= chars <= 15 * len(w) or 100 * up > 60 * (up + low) or 100 * lettered < 70 * len(w)
    return len(w), chars, symbols, dup, len(repeat), base, not base and not bad


@pytest.fixture(scope="module")
def docs(spark, edge_texts):
    rng = random.Random(12)
    texts = [*edge_texts, "\n".join(sentence(rng, 8) for _ in range(12)), "same line here\n" * 6 + sentence(rng, 80), sentence(rng, 90).upper(), " ".join(["12", "word"] * 40) + sentence(rng, 60), sentence(rng, 100).replace(" ", " | "), "x\n\ny\n \nx"]
    for _ in range(60):
        w = sentence(rng, rng.randint(30, 120)).split()
        texts.append(rng.choice([" ", "\n", " $ "]).join(w + w[: rng.randint(0, len(w))]))
    return spark.createDataFrame([*rows_of(texts), *rows_of(texts)[20:22]], SCHEMA).repartition(3)


def test_counts_and_verdicts_equal_brute_force(docs):
    got = Counter(tuple(r)[:8] for r in quality.quality_rules(docs).collect())
    assert got == Counter((r.doc_id, *brute(r.text)) for r in docs.collect())


def test_the_order_of_rules_does_not_matter(docs, monkeypatch):
    want = Counter(tuple(r)[:8] for r in quality.quality_rules(docs).collect())
    monkeypatch.setattr(quality, "order_rules", lambda e: [x for x, *_ in reversed(e)])
    assert Counter(tuple(r)[:8] for r in quality.quality_rules(docs, sample_rows=3).collect()) == want


def test_rules_are_ordered_by_rejection_per_cost():
    assert quality.order_rules([("a", 1.0, 0.1), ("b", 0.1, 0.05), ("c", 1.0, 0.0)]) == ["b", "a", "c"]


def test_a_rule_costs_what_it_adds():
    """Facts that the result states are free; the others are asked of the remaining rows alone."""
    import numpy as np
    import pyarrow as pa

    texts = [sentence(random.Random(i), 60) for i in range(9)] + ["short", None, "a | " * 80, sentence(random.Random(1), 80).upper()]
    facts, failed = quality._base(pa.array(texts))
    asked, read = [], quality.Facts.get
    quality.Facts.get = lambda self, name: (asked.append((name, len(self))) if name not in self._known else None, read(self, name))[1]
    try:
        for name in ("many_symbols", "repeated_lines", "odd_word_length"):
            quality.RULES[name](facts.only(~failed))
        assert not asked
        kept = quality.cascade(facts, failed, ["many_symbols", "mostly_capitals", "few_letter_words", "repeated_lines", "odd_word_length"])
        upper, letters = (next(n for x, n in asked if x == f) for f in ("upper", "letter_words"))
        assert upper == int((~failed).sum()) - int((quality.RULES["many_symbols"](facts) & ~failed).sum()) and letters < upper
    finally:
        quality.Facts.get = read
    assert kept.tolist() == [brute(t)[-1] for t in texts]
    part = facts.only(np.arange(len(texts)) % 2 == 0)
    assert part.get("letter_words").tolist() == facts.get("letter_words")[::2].tolist() and len(part) == 7


def test_words_and_lines_of_equal_arithmetic_are_no_repeats(spark):
    from tests.llm.test_wordhash import mirrored

    a, b = mirrored(1024)
    docs = spark.createDataFrame(rows_of([f"x y {a} x y {b}", f"{a}\n{b}\n{a}"]), SCHEMA)
    assert Counter(tuple(r)[:8] for r in quality.quality_rules(docs).collect()) == Counter((r.doc_id, *brute(r.text)) for r in docs.collect())


def test_no_rows(no_docs):
    assert quality.quality_rules(no_docs).count() == 0
