"""Texts beyond a slice (3 MB) go through every operator whole."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA, WORDS, rows_of
from tests.llm.test_decontamination import brute as brute_contamination
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_native_scans import brute_pii, brute_secrets
from tests.llm.test_quality import brute as brute_quality
from tests.llm.test_substrings import brute as brute_repeats
from turnmill.llm import decontamination, jaccard, language, packing, pii, quality, secrets, sharding, substrings


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(1)
    words = [f"{rng.choice(WORDS)}{rng.randrange(100_000)}" for _ in range(330_000)]
    near = list(words)
    near[150_000:150_000] = ["password=abcdefgh12", "a@b.co"]
    return [(0, " ".join(words)), (1, " ".join(near)), (2, " ".join(words[200_000:200_200])), (3, "short"), (4, None)]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    assert len(long_rows[0][1].encode()) > 3 << 20
    return spark.createDataFrame([(i, *r[1:]) for (i, _), r in zip(long_rows, rows_of([t for _, t in long_rows]), strict=True)], SCHEMA).repartition(3)


def test_components_and_repeats(long_docs, long_rows):
    assert Counter(map(tuple, jaccard.similar_components(long_docs).collect())) == brute_components(long_rows)
    assert Counter(map(tuple, substrings.remove_repeats(long_docs).collect())) == brute_repeats(long_rows)


@pytest.mark.parametrize("bound", [10**6, 0])
def test_contamination(spark, long_docs, long_rows, bound):
    items = [(7, long_rows[2][1]), (8, "short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, decontamination.contamination(long_docs, bench, broadcast_postings=bound).collect())) == brute_contamination(long_rows, items)


def test_rules_spans_pieces_and_shards(long_docs, long_rows):
    assert Counter(tuple(r)[:8] for r in quality.quality_rules(long_docs).collect()) == Counter((i, *brute_quality(t)) for i, t in long_rows)
    for scan, brute in ((secrets.scan_secrets, brute_secrets), (pii.find_pii, brute_pii)):
        got = {r.doc_id: r.spans.split(",") for r in scan(long_docs).collect()}
        assert all(set(filter(None, brute(t or "").split(","))) <= set(got[i]) for i, t in long_rows) and brute(long_rows[1][1])
    tokenizer = packing.WordIds(packing.default_tokenizer()).tokenizer
    want = Counter()
    for i, t in long_rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.SEPARATOR], dtype="<u4")
        want.update((i, k // 2048, zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in packing.pack_documents(long_docs).collect()) == want
    assert {r.doc_id: r["size"] for r in sharding.shard_by_bytes(long_docs, 3).collect()} == {i: len((t or "").encode()) + 16 for i, t in long_rows}
    assert {r.doc_id: r.lang_pred == "und" for r in language.language_id(long_docs).collect()} == {i: t is None for i, t in long_rows}
