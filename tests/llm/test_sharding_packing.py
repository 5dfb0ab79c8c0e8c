import zlib
from collections import Counter, defaultdict

import numpy as np

from turnmill.llm import packing, sharding


def test_shards_are_contiguous_gapless_and_balanced(edge_docs):
    rows = sharding.shard_by_bytes(edge_docs, 7).collect()
    source = edge_docs.select("doc_id", "text").collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in source)
    total, longest, by = sum(r["size"] for r in rows), max(r["size"] for r in rows), defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(7))
    for shard in by.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
        assert abs(sum(r["size"] for r in shard) - total / 7) <= longest
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    runs = [sorted(map(key, by[s])) for s in sorted(by)]
    assert all(a[-1] <= b[0] for a, b in zip(runs, runs[1:], strict=False))


def test_shards_of_many_small_rows(spark):
    docs = spark.range(0, 3000).selectExpr("id as doc_id", "repeat('ab', int(id % 50)) as text").repartition(6)
    by = Counter()
    for r in sharding.shard_by_bytes(docs, 40).collect():
        by[r.shard] += r["size"]
    assert len(by) == 40 and max(by.values()) - min(by.values()) <= 2 * (16 + 98)


def test_empty_table(no_docs):
    assert sharding.shard_by_bytes(no_docs, 5).count() == 0
    assert packing.pack_documents(no_docs, 16).count() == 0


def _whole_text_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    return [[*tok.encode(t or "", add_special_tokens=False).ids, packing.SEPARATOR] for t in texts]


def test_pieces_equal_whole_text_tokenisation(edge_docs):
    size = 64
    got = packing.pack_documents(edge_docs, size).collect()
    want = Counter()
    for r in edge_docs.select("doc_id", "text").collect():
        ids = _whole_text_ids([r.text])[0]
        for k, at in enumerate(range(0, len(ids), size)):
            cut = np.array(ids[at : at + size], dtype="<u4")
            want[(r.doc_id, k, at, len(cut), zlib.crc32(cut.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.sequence_id].append((r.offset, r.length))
    for s in slots.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    assert len(slots) <= -(-sum(r.length for r in got) // size) + 2


def test_a_full_cache_starts_anew(edge_docs, monkeypatch):
    want = packing.tokenised_pieces(edge_docs, 64).collect()
    words = packing.WordIds(packing.default_tokenizer())
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    import pyarrow as pa

    texts = [r.text for r in edge_docs.select("text").collect()]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    again = packing._pieces(part, words, 64, False, ["doc_id", "piece", "start", "length", "ids_crc32"])
    assert sorted(again.column("ids_crc32").to_pylist()) == sorted(r.ids_crc32 for r in want)


def test_plan_covers_every_piece_once_and_is_tight():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 4000)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    room, seen = defaultdict(list), defaultdict(list)
    for length, lo, hi, base, offset in packing.plan_best_fit(histogram, 100):
        seen[length] += range(lo, hi)
        for i in range(hi - lo):
            room[base + i].append((offset, length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(v)) for k, v in histogram.items()}
    for s in room.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 100
    assert len(room) <= int(lengths.sum() / 100) + 3


def test_words_are_encoded_as_the_tokenizer_does():
    import random

    rng = random.Random(1)
    letters = "abzAZéÀßÿÖø×÷'s.$09|<>-’中²µªº\x1c\xa0ſİ'll'd"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(20000)] + ["a<|endoftext|>b", "don't", "zuß,"]
    ids = packing.WordIds(packing.default_tokenizer())
    flat, sizes = ids._encode(words)
    want = [e.ids for e in ids.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    assert sizes == [len(x) for x in want] and flat == [i for x in want for i in x]


def test_other_vocabularies_encode_whole_texts(spark, edge_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.WordIds(packing.default_tokenizer()).by_word and not packing.WordIds(path).by_word
    tok = Tokenizer.from_file(path)
    got = packing.tokenised_pieces(edge_docs, 10**6, path, with_ids=True).collect()
    want = Counter((r.doc_id, (*tok.encode(r.text or "", add_special_tokens=False).ids, packing.SEPARATOR)) for r in edge_docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want


def test_words_of_equal_arithmetic_keep_their_own_ids():
    import pyarrow as pa

    from tests.llm.test_wordhash import mirrored
    from turnmill.llm.wordhash import Texts

    texts = [" ".join(mirrored(1024)), mirrored(1024)[1]]
    ids, ends = packing.WordIds(packing.default_tokenizer()).of(Texts(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == _whole_text_ids(texts)
