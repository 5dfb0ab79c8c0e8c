import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from turnmill.llm import packing
from tests.llm.conftest import sentence
from tests.llm.test_decontamination import brute as brute_contamination
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_native_scans import brute_secrets


def redacted(text):
    out, at = "", 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in brute_secrets(text).split(",") if s):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(8)
    item = sentence(rng, 20)
    rows = []
    for i in range(60):
        w = sentence(rng, rng.randint(20, 60)).split()
        if i % 6 == 0:
            w[5:5] = ["token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "password=abcdefgh12"]
        if i % 9 == 0:
            w[3:3] = item.split()[2:16]
        rows.append((i, " ".join(w), ["en", "fr", None][i % 3], f"s{i % 4}", 3))
    rows += [(100 + i, rows[i][1] + " more", "en", None, None) for i in range(10)] + [(200, None, "en", "s", 0), (201, "12 34", "en", "s", 5), rows[1], (None, sentence(rng, 30), None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    lettered = list(dict.fromkeys((r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])))
    component = {d: c for d, _, c in brute_components(lettered)}
    single = [(d, t) for d, t in lettered if component[d] == d]
    clean = {d for d, *_, bad in brute_contamination(single, [(1, item)]) if not bad}
    want = Counter()
    tokenizer = packing.WordIds(packing.default_tokenizer()).tokenizer
    for d, t in single:
        if d in clean:
            ids = [*tokenizer.encode(redacted(t), add_special_tokens=False).ids, 0]
            want[(d, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert 5 < len(got) < len(lettered)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    """Names that the operators use themselves, and the session's settings afterwards."""
    clashing = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "lang_pred", "score", "_spans", "_id", "_hash", "spans", "row", "rest", "key1", "key2", "text_hash", "doc", "id", "hash", "a.b", "node", "component"]
    rng = random.Random(5)
    texts = [sentence(rng, 40) for _ in range(12)] + ["password=abcdefgh12 " + sentence(rng, 20), None, "12"]
    rows = [(i, t, "en", "s", 3, *[f"{c}{i}" for c in clashing]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clashing))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, sentence(rng, 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, read, str(tmp_path))
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        assert all(got[i][5:] == rows[i][5:] for i in got) and len(got) == (13 if name == "language" else 15)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 777)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 13
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "777"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_near_duplicates_of_equal_and_null_ids_do_not_leak(spark):
    rng = random.Random(6)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows = [(7, a), (9, b), (9, a + " more"), (None, c), (None, c + " more"), (9, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert len(got) == 3 and {(7, a), (9, b)} < set(got)


def test_paths_are_noted_by_the_thread_that_takes_them(spark):
    import threading

    from turnmill.llm import scratch

    with scratch.noting_paths() as mine:
        other = threading.Thread(target=lambda: scratch.new_path(spark, "theirs"))
        other.start()
        other.join()
        with scratch.noting_paths() as inner:
            path = scratch.new_path(spark, "own")
    scratch.new_path(spark, "later")
    assert mine == inner == [path]


def test_a_run_leaves_other_tables_alone(spark, tmp_path):
    from turnmill.llm.scratch import materialise

    rng = random.Random(9)
    spark.createDataFrame([(i, sentence(rng, 30), "en", "s", 3) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, sentence(rng, 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tables = []
    own = corpus_pipeline.STAGES[0]

    def with_another(spark, docs, sf_dir):
        """While a stage runs, another thread writes a table of its own."""
        import threading

        thread = threading.Thread(target=lambda: tables.append(materialise(spark.range(5), "another")))
        thread.start()
        thread.join()
        return own[1](spark, docs, sf_dir)

    corpus_pipeline.STAGES[0] = (own[0], with_another)
    try:
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 6
    finally:
        corpus_pipeline.STAGES[0] = own
    assert tables[0].count() == 5
