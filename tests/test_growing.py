"""Logs that grow while they are ingested."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from turnmill.streaming import growing, ingest


def entry(ts, text, kind="user"):
    return json.dumps({"type": kind, "timestamp": ts, "message": {"role": kind, "content": text}}, ensure_ascii=False)


def keys(df):
    return df.select(F.lit("a").alias("origin"), F.lit("p").alias("project"), F.regexp_extract("source_path", r"([^/]+)\.jsonl$", 1).alias("session_id"), "source_path", "line_key", "value")


def ingested(spark, folder, table, check, **more):
    ingest.stream_ingest(spark, f"{folder}/*.jsonl", "a", str(table), str(check), keys, **more).awaitTermination()
    return sorted(tuple(r) for r in ingest.owners(spark, str(table)).select("timestamp", "text_hash", "earliest", "session_id", "pos").collect())


@pytest.mark.parametrize("more", [{}, {"compact_after": 2, "split": 70}])
def test_a_log_that_grows_gives_what_one_read_gives(spark, tmp_path, more):
    rng, folder = random.Random(1), tmp_path / "in"
    folder.mkdir()
    for step in range(4):
        for name in "abc":
            with (folder / f"{name}.jsonl").open("a") as f:
                for i in range(rng.randrange(4)):
                    f.write(entry(str(rng.randrange(10) if name != "c" or step == 3 else 50), f"text é {rng.randrange(6)}", rng.choice(["user", "user", "assistant"])) + "\n")
        got = ingested(spark, folder, tmp_path / "grown", tmp_path / "check", **more)
    assert got == ingested(spark, folder, tmp_path / "once", tmp_path / "check1") and got


def test_a_half_line_waits(spark, tmp_path):
    folder, names = tmp_path / "in", {hashlib.sha256(t.encode()).hexdigest(): t for t in ("one", "two", "three")}
    folder.mkdir()
    log = folder / "s.jsonl"

    def add(text):
        with log.open("a") as f:
            f.write(text)
        return [(names[h], pos) for _, h, _, _, pos in ingested(spark, folder, tmp_path / "t", tmp_path / "check")]

    whole = entry("2", "two")
    assert add(entry("1", "one") + "\n" + whole[:20]) == [("one", 0)]
    assert add(whole[20:]) == [("one", 0), ("two", 1)]  # a whole object, though no line feed has come yet
    assert add("\n" + entry("3", "three") + "\n") == [("one", 0), ("two", 1), ("three", 2)]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    lines = keys(spark.createDataFrame([(entry("1", "one"), "/x/s.jsonl", 0), (entry("2", "two"), "/x/s.jsonl", 60)], "value string, source_path string, row long")
                 .select("value", "source_path", F.struct(F.lit(0).alias("block"), "row").alias("line_key")))
    from turnmill.sources import dialects

    events, table = dialects.timeline(dialects.parse_lines(lines, "a")), str(tmp_path / "t")
    ingest.append_batch(lines, events, table)
    first = sorted(map(tuple, ingest.owners(spark, table).collect()))
    ingest.append_batch(lines, events, table)
    assert sorted(map(tuple, ingest.owners(spark, table).collect())) == first
    ingest.compact(spark, table)
    ingest.append_batch(lines, events, table)
    assert sorted(map(tuple, ingest.owners(spark, table).collect())) == first and len(first) == 2


@pytest.mark.parametrize("split", [1, 7, 50, 10_000])
def test_stretches_give_each_line_once(tmp_path, split):
    log = tmp_path / "f.jsonl"
    body = "".join(f"line {i} é\n" + "\n" * (i % 3 == 0) for i in range(40)) + '{"last": 1}'
    log.write_text(body)
    size = len(body.encode())
    assert growing.whole_bytes(str(log), size) == size and growing.files(f"{tmp_path}/*.jsonl") == {f"file://{log}": size}
    for first in (0, len("line 0 é\n".encode())):
        parts = growing._Reader(str(tmp_path), split).partitions({f"file://{log}": first}, {f"file://{log}": size})
        got = [line for part in parts for line in growing.lines_of(part)]
        assert [g[0] for g in got] == body.encode()[first:].decode().split("\n")
        assert all(body.encode()[at:].startswith(line.encode()) for line, _, at in got)
    log.write_text('half {"a"')
    assert growing.whole_bytes(str(log), 9) == 0
