import json

import pytest
from pyspark.sql import functions as F

from turnmill.plans import export
from turnmill.sources import artifacts


def line(text, ts):
    return json.dumps({"type": "user", "timestamp": ts, "message": {"content": text}})


def test_export_end_to_end(spark, tmp_path):
    a = tmp_path / "a" / "projects"
    for project, session, rows in [("-x-one", "aaaaaaaa-1", [line("hello", "1"), line("go", "2"), "bad"]), ("-y-one", "bbbbbbbb-2", [line("hello", "1"), line("go", "2"), line("more", "3"), json.dumps({"type": "assistant", "message": {"content": "done"}})]), ("-x-one", "cccccccc-3", [])]:
        (a / project).mkdir(parents=True, exist_ok=True)
        (a / project / f"{session}.jsonl").write_text("\n".join(rows))
    k3 = tmp_path / "k" / "sessions" / "h" / "sess_d"
    k3.mkdir(parents=True)
    (k3 / "messages.jsonl").write_text(json.dumps({"timestamp": "9", "payload": {"type": "user", "content": "k three"}}))
    homes = {"a": str(tmp_path / "a"), "k3": str(tmp_path / "k")}
    old = spark.createDataFrame([("one-aaaaaaaa.md",), ("gone.md",)], "export string")
    got = export.run_export(spark, homes, str(tmp_path / "out"), existing=old)
    assert [(r.export, r.messages, r.first_ts, r.last_ts) for r in got["manifest"].orderBy("export").collect()] == [("one-2-bbbbbbbb.md", 1, "3", "3"), ("one-aaaaaaaa.md", 2, "1", "2"), ("unknown-sess_d.md", 1, "9", "9")]
    docs = {r.export: r.content for r in got["documents"].collect()}
    assert docs["one-aaaaaaaa.md"].endswith("     messages: 2 -->\n\n### 1\n\nhello\n\n### 2\n\ngo\n")
    assert {r.export: r.final_assistant_tail for r in got["outcomes"].collect()}["one-2-bbbbbbbb.md"] == "done"
    assert got["outcomes"].schema["final_assistant_tail"].metadata["comment"] == export.OUTCOME_NOTE
    counts = {r["counter"]: r["n"] for r in got["statistics"].collect()}
    assert counts == {"exported": 3, "messages": 4, "duplicates": 2, "filtered": 0, "zero_message": 0, "automation": 0, "below_minimum": 0, "read_errors": 0, "bad_lines": 1, "short_turns": 4, "with_decision": 0, "outcome_sessions": 1, "stale_outputs": 1, "exported:a": 2, "exported:k3": 1}
    assert [r.export for r in got["stale_outputs"].collect()] == ["gone.md"]
    again = export.run_export(spark, homes, str(tmp_path / "out2"), source="a", project="ONE", min_messages=2, existing=old)
    assert [r.export for r in again["manifest"].collect()] == ["one-aaaaaaaa.md"] and again["stale_outputs"].count() == 0


def test_three_stores(spark, tmp_path):
    """Classification, the newer store's copy, projects of folders, history files and every counter."""
    ids = {x: f"{x * 8}-0000-0000-0000-000000000000" for x in "abcdef"}
    k = tmp_path / "k" / "sessions"
    (k / "cli").mkdir(parents=True)
    prompt = lambda *texts, ts=1_700_000_000: "\n".join(json.dumps({"kind": "Prompt", "data": {"content": [{"kind": "text", "data": x}], "meta": {"timestamp": ts + i}}}) for i, x in enumerate(texts))
    flat = {
        "a": (prompt("first one", "second one"), {"cwd": "/w/src"}, False), "b": (prompt("[AGENT SYSTEM PROMPT] do"), {"cwd": "/w/src", "parent_session_id": "x"}, False),
        "c": (prompt("[AGENT SYSTEM PROMPT] do", "a human came"), {"cwd": "/v/src"}, True), "d": (prompt("old copy"), {"cwd": "/w/src"}, False), "e": (prompt("<system>", ""), None, False),
    }
    for x, (body, meta, history) in flat.items():
        (k / "cli" / f"{ids[x]}.jsonl").write_text(body)
        if meta:
            (k / "cli" / f"{ids[x]}.json").write_text(json.dumps(meta))
        if history:
            (k / "cli" / f"{ids[x]}.history").write_text("h")
    (k / "cli" / "gone.history").write_text("h")
    (k / "cli" / f"sess_{ids['d']}.history").write_text("h")
    said = lambda *texts: "\n".join(json.dumps({"timestamp": f"2024-0{i + 1}", "payload": {"type": "user", "content": x}}) for i, x in enumerate(texts))
    tree = {f"sess_{ids['d']}": (said("new copy", "yes"), {"workspacePaths": ["/w/src"], "rootPaths": ["/no"]}), f"sess_{ids['f']}": (said("You are a session naming agent. x"), {"workspacePaths": [], "rootPaths": ["/no"]}), "cli_odd": (said("by the machine of ours"), {"rootPaths": ["/w/app"]})}
    for name, (body, meta) in tree.items():
        (k / "h1" / name).mkdir(parents=True)
        (k / "h1" / name / "messages.jsonl").write_text(body)
        (k / "h1" / name / "session.json").write_text(json.dumps(meta))
    (tmp_path / "a" / "projects" / "-w-src").mkdir(parents=True)
    (tmp_path / "a" / "projects" / "-w-src" / "s1.jsonl").write_text(line("hello", "1"))
    homes = {"a": str(tmp_path / "a"), "k2": str(tmp_path / "k"), "k3": str(tmp_path / "k")}

    got = export.run_export(spark, homes, str(tmp_path / "out"), own_mark="by the machine")
    status = {(r.origin, r.session_id): (r.project, r.status) for r in got["discovered"].collect()}
    assert status == {
        ("a", "s1"): ("src", "read"), ("k2", ids["a"]): ("src-2", "read"), ("k2", ids["b"]): ("src-2", "automation"), ("k2", ids["c"]): ("src", "read"), ("k2", ids["e"]): ("unknown", "read"),
        ("k3", f"sess_{ids['d']}"): ("src-2", "read"), ("k3", f"sess_{ids['f']}"): ("unknown", "automation"), ("k3", "cli_odd"): ("app", "automation")}
    counts = {r["counter"]: r["n"] for r in got["statistics"].collect()}
    assert counts == {"exported": 4, "messages": 6, "duplicates": 0, "filtered": 0, "zero_message": 1, "automation": 3, "below_minimum": 0, "read_errors": 0, "bad_lines": 0, "short_turns": 6, "with_decision": 0, "outcome_sessions": 0, "stale_outputs": 0, "exported:a": 1, "exported:k2": 2, "exported:k3": 1}
    assert sorted(r.export for r in got["manifest"].collect()) == ["src-2-aaaaaaaa.md", "src-2-sess_ddd.md", "src-cccccccc.md", "src-s1.md"]
    filtered = export.run_export(spark, homes, str(tmp_path / "out3"), project="SRC-2", min_messages=2)
    counts = {r["counter"]: r["n"] for r in filtered["statistics"].collect()}
    assert (counts["exported"], counts["filtered"], counts["automation"], counts["below_minimum"]) == (2, 5, 1, 0)
    from turnmill.sources import lines, sessions

    found = sessions.discover(spark, homes)
    stems = sessions.history_stems(spark, homes["k2"])
    old, new = (found.filter(f"origin = '{o}'") for o in ("k2", "k3"))
    assert [r.stem for r in lines.orphan_histories(stems, old, new).collect()] == ["gone"]
    blind = sessions.unreadable(found, spark.createDataFrame([(r.source_path,) for r in found.collect()[1:]], "source_path string"))
    assert blind.count() == 1


def test_artifacts_are_read_with_defaults(spark, tmp_path):
    for slug, body in {"a": '{"slug":"a","members":["m",1],"confidence":"high","preferences":[{"text":"t"},{"x":1}],"authored_at":"2"}', "b": '{"slug":"b","confidence":"?"}', "c": "nope", "d": "{}"}.items():
        (tmp_path / slug).mkdir()
        (tmp_path / slug / "sources.json").write_text(body)
    records = artifacts.read_records(spark, f"{tmp_path}/*/sources.json")
    a, b = artifacts.parse_library(records).collect()
    assert (a.slug, a.members, a.confidence, [tuple(p) for p in a.preferences], a.coverage) == ("a", ["m"], "high", [("t", "")], 1.0)
    assert (b.slug, b.title, b.members, b.confidence) == ("b", "b", [], "low")
    expected = spark.createDataFrame([(x,) for x in "abcde"], "slug string")
    assert [tuple(r) for r in artifacts.library_issues(expected, records).collect()] == [("c", "not JSON"), ("d", "fails schema"), ("e", "missing")]


def test_keyed_files_and_tasks(spark):
    one = lambda value: spark.createDataFrame([(value,)], "value string")
    keyed = one(json.dumps({"_note": "x", "good": [{"index": 1}, {"index": 2}], "bad": [{"index": 1}, {"z": 1}], "worse": 5}))
    assert [r.key for r in artifacts.parse_keyed(keyed, ["index"]).collect()] == ["good", "good"]
    task = {"slug": "a-b", "title": "T", "members": ["m"]}
    assert [(r.slug, r.members) for r in artifacts.parse_tasks(one(json.dumps({"tasks": [task]}))).collect()] == [("a-b", ["m"])]
    assert artifacts.parse_tasks(one(json.dumps({"tasks": [task, {"slug": "x"}]}))).count() == 0
    digests = spark.createDataFrame([("e1", '{"goal":"g","deliverable":"d","domain":"x","keywords":["k"],"outcome":"partial"}'), ("e2", '{"goal":"g"}'), ("e3", "no")], "export string, value string")
    assert [r.export for r in artifacts.parse_digests(digests, ["partial"]).collect()] == ["e1"]
    assert [r.p for r in spark.createDataFrame([("x" * 120,), (" y ",), (None,)], "c string").select(artifacts.body_problem(F.col("c")).alias("p")).collect()] == [None, "too short", "missing"]


def test_a_file_that_breaks_off_is_counted_with_what_was_lost(spark, tmp_path):
    """A log whose later blocks fail their checksums gives its first lines, and the bytes of the others are told."""
    folder = tmp_path / "a" / "projects" / "-w-src"
    folder.mkdir(parents=True)
    whole = "\n".join(line(f"turn {i} " + "x" * 50, f"2024-01-01T00:00:{i % 60:02d}") for i in range(3_000))
    (folder / "whole.jsonl").write_text(whole)
    (folder / "ends.jsonl").write_text(whole + "\n")
    local = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(folder / "broken.jsonl"))
    store = local.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(local)  # writes checksums beside the file
    out.write(bytearray(whole.encode()))
    out.close()
    body = bytearray((folder / "broken.jsonl").read_bytes())
    body[300_000] ^= 1
    (folder / "broken.jsonl").write_bytes(bytes(body))
    got = export.run_export(spark, {"a": str(tmp_path / "a")}, str(tmp_path / "out"))
    (row,) = got["partly_read"].collect()
    assert row.source_path.endswith("broken.jsonl") and row.bytes == len(whole) and 0 < row.read < 300_100 and row.read + row.lost == row.bytes


@pytest.mark.parametrize("size, hot_rows", [(7, None), (64, 0), (10_000, 3)])
def test_chunks_put_together_are_the_documents(spark, size, hot_rows):
    from turnmill.operators import corpus

    rows = [("a", "p", f"s{s}", f"/s{s}", i, i * 2, f"t{i}", "é𝔘x " * (i * s % 30)) for s in range(4) for i in range(s * 3 + 1)]
    kept = spark.createDataFrame(rows, "origin string, project string, session_id string, source_path string, index long, pos long, timestamp string, text string").repartition(4)
    whole = {r.session_id: (r.messages, r.content) for r in corpus.render_documents(kept).collect()}
    parts = {}
    for r in corpus.render_chunks(kept, size, hot_rows).collect():
        parts.setdefault(r.session_id, []).append((r.chunk, r.offset, r.messages, r.content))
    for session, found in parts.items():
        found.sort()
        assert [(c, o) for c, o, *_ in found] == [(i, i * size) for i in range(len(found))] and all(len(x[3]) <= size for x in found)
        assert {x[2] for x in found} == {whole[session][0]} and "".join(x[3] for x in found) == whole[session][1]
    assert set(parts) == set(whole)


def test_an_unchanged_run_reads_its_tables_back(spark, tmp_path, monkeypatch):
    folder, homes, out = tmp_path / "a" / "projects" / "-w-src", {"a": str(tmp_path / "a")}, str(tmp_path / "out")
    folder.mkdir(parents=True)
    (folder / "s1.jsonl").write_text(line("hello", "1") + "\n")
    first = {name: sorted(map(str, df.collect())) for name, df in export.run_export(spark, homes, out).items()}
    with monkeypatch.context() as m:
        m.setattr(export, "parse_all", None)  # would fail if it were asked for
        again = export.run_export(spark, homes, out)
        assert {name: sorted(map(str, df.collect())) for name, df in again.items()} == first
        with pytest.raises(TypeError):
            export.run_export(spark, homes, out, min_messages=2)
        with pytest.raises(TypeError):  # a run that broke off left no fingerprint
            export.run_export(spark, homes, out)
    with (folder / "s1.jsonl").open("a") as f:
        f.write(line("more", "2") + "\n")
    assert {r.counter: r.n for r in export.run_export(spark, homes, out)["statistics"].collect()}["messages"] == 2


def test_same_sets(spark):
    from turnmill.functions.fingerprint import same_sets

    frame = lambda *rows: spark.createDataFrame([(r,) for r in rows], "id string").repartition(3)
    same = lambda a, b: same_sets(a, b).first().same
    assert same(frame("a", "b", None), frame(None, "b", "a", "a")) and same(frame().limit(0), frame().limit(0))
    assert not same(frame("a", "b"), frame("a")) and not same(frame("a", None), frame("a")) and not same(frame("a"), frame().limit(0))
