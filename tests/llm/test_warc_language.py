import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from turnmill.llm import language, warc
from tests.llm.conftest import SCHEMA, rows_of, sentence

PAGES = "page_id long, url string, html string, offset int, digest string, first long"


def brute_types(rows):
    """(page id, bytes, digest, type, refers to) of each record."""
    by, out = {}, []
    for page, _, html in rows:
        payload = (html or "").encode()
        by.setdefault(payload, []).append(page)
    for payload, pages in by.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        known = sorted(p for p in pages if p is not None)
        first = known[0] if known and len(pages) > 1 else None
        left = 1
        for p in sorted(pages, key=lambda p: (p is None, p)):
            response = first is None or (p == first and left)
            left -= bool(response and first is not None)
            out.append((p, len(payload), digest, "response" if response else "revisit", None if response else first))
    return sorted(out, key=str)


@pytest.mark.parametrize("twice, bound", [(True, 100), (False, 100), (False, 0)])
def test_round_trip(spark, twice, bound):
    rows = [(1, "http://a/%20x", "<p>é𝔘</p>"), (2, None, None), (3, "u\r\nX: y", ""), (7, "http://b", "same"), (5, "http://c", "same"), (5 if twice else 6, "http://c", "same"),
            (None, "http://d", "same"), (None, "http://e", "alone"), (None, "http://f", "alone"), (9, "http://g", "long " * 60000), (4, "h", "a\r\n\r\nb")]
    pages = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], PAGES).repartition(4)
    got = warc.round_trip(pages, broadcast_repeats=bound).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute_types(rows)
    assert all(r.intact for r in got)
    want = {p: h or "" for p, _, h in rows}
    assert all(r.payload == want[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "longer"), (4, "d", "longer")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages, revisit_bytes=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_an_archive_is_plain_gzip_members(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "z" * 100)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(pages, f"file://{tmp_path}/w").collect()
    for r in index:
        data = (tmp_path / "w" / r.file).read_bytes()[r.offset : r.offset + r.length]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_languages_are_told_apart(spark):
    import random

    rng = random.Random(2)
    sounds = {"aa": ["bra", "ko", "mi", "ta"], "bb": ["sch", "ung", "er", "ein"], "cc": ["eau", "oi", "é", "tion"]}
    rows = []
    for i in range(240):
        lang = list(sounds)[i % 3]
        text = " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(30))
        rows.append((i, text, lang if i % 11 else None, "s", i, "x", 1, None, "k"))
    rows += [(900, None, "aa", *[None] * 6), (901, "123 !?", "bb", *[None] * 6), (902, "", None, *[None] * 6), (903, "日本", None, *[None] * 6), (904, "ko " * 40000, "aa", *[None] * 6)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.doc_id: r for r in language.language_id(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == list(sounds)[i % 3] for i in range(240)) and got[904].lang_pred == "aa"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred in sounds
    assert all(0 <= r.score <= 1 for r in got.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())


def test_empty_and_tiny_labelled_rows_leave_the_landmarks_to_texts(spark):
    import random

    rng = random.Random(3)
    sounds = {"aa": ["bra", "ko", "mi", "ta"], "bb": ["sch", "ung", "er", "ein"], "cc": ["eau", "oi", "lu", "tion"]}
    said = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, said(list(sounds)[i % 3], 30), list(sounds)[i % 3]) for i in range(180)]
    rows += [(1000 + i, [None, "", "12 34", "  "][i // 3 % 4], list(sounds)[i % 3]) for i in range(900)]
    rows += [(3000 + i, "x", list(sounds)[i % 3]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r.lang_pred for r in language.language_id(docs).collect()}
    assert [got[i] for i in range(180)] == [list(sounds)[i % 3] for i in range(180)]
    assert {got[1000 + i] for i in range(900)} == {"und"}
    assert language.train(docs.filter("doc_id >= 1000 and doc_id < 3000")) is None


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = spark.createDataFrame(rows_of([sentence(__import__("random").Random(i), 30) for i in range(60)]), SCHEMA)
    flipped = docs.withColumn("lang", F.when(language.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    a, b = (sorted(map(tuple, language.language_id(d).collect())) for d in (docs, flipped))
    assert a == b


def test_without_labels_or_rows(spark, no_docs):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.language_id(docs).collect()] == [("und", 0.0)]
    assert language.language_id(no_docs).count() == 0


def test_parts_of_a_long_text_give_its_presence(monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa

    from turnmill.llm.wordhash import Texts

    rng = random.Random(4)
    texts = Texts(pa.array([sentence(rng, rng.randint(0, 60)) for _ in range(20)] + ["", None, "é", "ab", sentence(rng, 900)]))
    whole = language.presence(texts, 3, 25)
    for size in (1, 2, 3, 50, 1000):
        monkeypatch.setattr(language, "_BYTES_AT_ONCE", size)
        assert (language.presence(texts, 3, 25) == whole).all()
    row = set()
    for n in (1, 2, 3):  # "ab", from its own n-grams alone
        codes = [98, 99][:3]
        for i in range(len(codes) - n + 1):
            gram = 0
            for c in codes[i : i + n]:
                gram = (gram * 263 + c) % 2**32
            row.add(((gram + n) * 2654435761 % 2**32) >> 17)
    assert set(np.flatnonzero(whole[20]).tolist()) == row


def test_a_long_text_takes_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from turnmill.llm.wordhash import Texts

    texts = Texts(pa.array(["some words of a long text " * 400_000]))
    tracemalloc.start()
    language.presence(texts, 0, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
