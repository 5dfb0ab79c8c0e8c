import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from turnmill.operators import context, corpus
from turnmill.sources import dialects, lines
from turnmill.streaming import ingest


def frame(spark, rows, session="s1"):
    values = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(values, "n long, value string")
    return df.select(*(F.lit(x).alias(k) for k, x in zip(lines.KEYS, ("a", "p", session, f"/{session}"), strict=True)), F.struct(F.lit(0).alias("block"), F.col("n").alias("row")).alias("line_key"), "value")


def run(spark, rows, dialect):
    parsed = dialects.parse_lines(frame(spark, rows), dialect)
    events = [(r.kind, r.timestamp, r.text) for r in dialects.timeline(parsed).orderBy("event_pos").collect()]
    drops = sorted((r.reason, r.snippet, r.timestamp) for r in dialects.drops(parsed, dialect).collect())
    return events, drops, dialects.bad_lines(parsed).first().bad_lines


def user(content, ts="t1", **more):
    return {"type": "user", "timestamp": ts, "message": {"role": "user", "content": content}, **more}


def test_dialect_a(spark):
    rows = [
        user(" hello there "), user("<ide>noise</ide>"), user("[Request interrupted by user]"), user(" "), "not json", "[1]", "", '{"type":"user"} trailing',
        user("x", isMeta=1), user("side", isSidechain=True), user("kept", promptSource="q", isMeta=0), user("bot", entrypoint="sdk-cli"),
        user("<command-message>m</command-message><command-name>tidy</command-name><command-args> notes.txt </command-args>"),
        user([{"type": "text", "text": "look"}, {"type": "image", "source": {}}, {"type": "tool_result", "content": [{"type": "text", "text": "no. the user said: use two"}]}, {"type": "tool_result", "content": "fine"}, {"type": "zzz"}, 5]),
        {"type": "user", "timestamp": "t2", "message": {"content": []}, "toolUseResult": {"questions": [{"question": " Which? ", "answer": ["A", 3, "B"]}, {"question": "", "answer": "z"}, {"question": "Q", "answer": "yes "}]}},
        {"type": "attachment", "attachment": {"type": "queued_command", "origin": {"kind": "human"}, "commandMode": "prompt", "prompt": "queued", "timestamp": "t3"}},
        {"type": "attachment", "attachment": {"type": "queued_command", "origin": {"kind": "human"}, "commandMode": "task", "prompt": "done"}},
        {"type": "assistant", "timestamp": "t4", "message": {"content": [
            {"type": "text", "text": "first"}, {"type": "text", "text": "second"}, {"type": "tool_use", "name": "ExitPlanMode", "input": {"plan": "P"}}, {"type": "tool_use", "name": "Other", "input": {}},
            {"type": "tool_use", "name": "AskUserQuestion", "input": {"questions": [{"question": "Go?", "options": ["yes", {"label": " no "}, {"x": 1}], "multiSelect": True}, {"question": "Or?"}]}}, {"type": "text", "text": "end"}]}},
        {"type": "assistant", "message": {"content": " plain "}}, {"type": "system", "message": {"content": "s"}},
    ]
    events, drops, bad = run(spark, rows, "a")
    assert events == [
        ("human", "t1", "hello there"), ("human", "t1", "kept"), ("human", "t1", "[command] /tidy notes.txt"), ("human", "t1", "look\n\n[image pasted]\n\nuse two"),
        ("human", "t2", '[decision] "Which?" → A, B\n\n[decision] "Q" → yes'), ("human", "t3", "queued"),
        ("assistant", "t4", "first\nsecond"), ("plan", "t4", "P"), ("question", "t4", "Go? [yes, no] (multi-select)\nOr?"), ("assistant", "t4", "end"), ("assistant", "", "plain"),
    ]
    assert bad == 3
    assert [d[0] for d in drops] == ["attachment", "empty", "interruption", "machine block", "meta", "sdk entrypoint", "side chain"]
    assert ("attachment", "done", None) in drops and ("side chain", "side", "t1") in drops


def test_dialect_k2(spark):
    def entry(kind, blocks, ts=1_700_000_000, **data):
        return {"version": "1", "kind": kind, "data": {"content": blocks, "meta": {"timestamp": ts}, **data}}

    text = lambda s: {"kind": "text", "data": s}
    steer = "[LIVE STEERING - New message from user]\nx <user_message id='1'>\n turn left \n</user_message> y"
    rows = [
        entry("Prompt", [text("one"), {"kind": "image", "data": {}}, {"kind": "audio", "data": "z"}]), entry("Prompt", [text(steer)], ts="2024"), entry("Prompt", [text("[LIVE STEERING - New message from user] <user_message></user_message>")]),
        entry("ToolResults", [text(steer), {"kind": "toolResult", "data": "m"}, text("plain")]), entry("AssistantMessage", [text("a"), {"kind": "toolUse"}, text("b")]), {"kind": "Clear", "data": None},
        entry("Compaction", [], messages_snapshot=[{"role": "user", "content": [text("one")], "meta": {"timestamp": 1_700_000_000}}, {"role": "user", "content": [text("lost")], "meta": {}}]),
        entry("Prompt", [text("You took too long to respond, go on")]), "nope",
    ]
    events, drops, bad = run(spark, rows, "k2")
    at = "2023-11-14T22:13:20.000Z"
    assert events == [("human", at, "one\n\n[image pasted]"), ("human", "", "turn left"), ("human", at, "turn left"), ("assistant", "", "a\nb"), ("boundary", "", "Clear"), ("boundary", "", "Compaction")]
    assert bad == 1
    assert sorted(d[0] for d in drops) == ["bracket marker", "harness nudge", "snapshot only", "snapshot only", "unknown block audio"]


def test_dialect_k3_and_format(spark):
    line = lambda kind, content, **more: {"timestamp": "t", "payload": {"type": kind, "content": content, **more}}
    rows = [line("user", " hi "), line("user", " "), line("assistant", "said", operationType="Say"), line("assistant", "thought", operationType="Reasoning"), "[]", "bad", line("tool_result", ["x"])]
    events, drops, bad = run(spark, rows, "k3")
    assert events == [("human", "t", "hi"), ("assistant", "t", "said")] and bad == 1 and [d[0] for d in drops] == ["empty"]
    assert lines.detect_format(frame(spark, rows)).first()["format"] == "k3"
    assert lines.detect_format(frame(spark, ["x", {"kind": "Prompt"}, rows[0]])).first()["format"] == "k2"
    assert lines.detect_format(frame(spark, ["x", ""])).first()["format"] == "k2"


@pytest.mark.parametrize("prompt, history, parent, want", [
    ("[own] go", True, None, (False, "own session")), ("[AGENT SYSTEM PROMPT]", True, "x", (True, "history")), ("hi", False, "x", (False, "spawned child")),
    ("[AGENT SYSTEM PROMPT] z", False, None, (False, "agent prompt")), ("You are a session naming agent.", False, None, (False, "automation")), ("hi", False, None, (True, "default")),
])
def test_classification(spark, prompt, history, parent, want):
    parsed = dialects.parse_lines(frame(spark, [{"kind": "Prompt", "data": {"content": [{"kind": "text", "data": " "}, {"kind": "text", "data": prompt}]}}]), "k2")
    meta = spark.createDataFrame([("s1", history, parent)], "session_id string, has_history boolean, parent_id string")
    assert tuple(dialects.classify_sessions(parsed, meta, "k2", "[own]").select("include", "reason").first()) == want


def test_files_are_read_in_order_when_split(spark, tmp_path):
    folder = tmp_path / "projects" / "-home-me-proj"
    (folder / "sub").mkdir(parents=True)
    rows = [json.dumps({"n": i, "pad": "x" * 50}) for i in range(3000)]
    (folder / "s1.jsonl").write_text("\r\n".join(rows) + "\n")
    (folder / "sub" / "s2.jsonl").write_text("nested")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        read = lines.read_sources(spark, {"a": str(tmp_path)})
        assert read.rdd.getNumPartitions() > 3
        assert [r.value for r in read.orderBy("line_key").collect()] == rows
        assert tuple(read.select("project", "session_id").distinct().first()) == ("proj", "s1")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError):
        lines.read_sources(spark, {"a": str(tmp_path)}, "zz")


def test_law_holds_and_breaks(spark):
    parsed = dialects.parse_lines(frame(spark, [user("a"), user("b")]), "a")
    events = dialects.timeline(parsed)
    said = dialects.messages(events)
    assert corpus.law_violations(said, events).count() == 0
    assert corpus.law_violations(said.filter("text = 'a'"), events).count() == 1


def _brute_context(events, words=15, chars=1600):
    out = []
    for i, (kind, ts, text) in enumerate(events):
        if kind != "human" or len(text.split()) > words:
            continue
        said = asked = None
        for k, _, x in reversed(events[:i]):
            if k == "boundary":
                break
            if k == "assistant" and said is None:
                said = x[-chars:]
        for k, _, x in reversed(events[:i]):
            if k in ("boundary", "human"):
                break
            if k in ("plan", "question") and asked is None:
                asked = (k, x)
        out.append((ts, text, said, *(asked or (None, None))))
    return out


@pytest.mark.parametrize("hot_rows", [None, 0, 12])
def test_context_equals_a_row_by_row_model(spark, hot_rows):
    import random

    rng = random.Random(3)
    rows, want = [], []
    for s in range(25):
        events = []
        for i in range(rng.randint(1, 25)):
            kind = rng.choice(["human", "human", "assistant", "plan", "question", "boundary"])
            events.append((kind, f"{s}-{i}", " ".join(["w"] * rng.choice([1, 14, 15, 16])) + (f" {'z' * 1700}" if kind == "assistant" and i % 3 == 0 else "")))
        rows += [("a", "p", f"s{s}", f"/s{s}", i, *e) for i, e in enumerate(events)]
        want += [(f"s{s}", *r) for r in _brute_context(events)]
    schema = "origin string, project string, session_id string, source_path string, event_pos long, kind string, timestamp string, text string"
    df = spark.createDataFrame(rows, schema).repartition(7)
    got = context.short_turn_context(df, corpus.first_owner_dedupe(dialects.messages(df)), hot_rows=hot_rows)
    assert sorted(map(tuple, got.select("session_id", "timestamp", "human_text", "antecedent", "decision_kind", "decision_text").collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ownership_does_not_depend_on_partitions(spark, parts):
    rows = [("a", "p", s, f"/{s}", i, ts, text) for s, said in {
        "old": [("1", "x"), ("2", "y"), ("2", "y"), ("", "blank")], "fork": [("1", "x"), ("2", "y"), ("3", "z"), ("1", "x")], "none": [("", "blank")], "twin": [("1", "x")]}.items() for i, (ts, text) in enumerate(said)]
    df = spark.createDataFrame(rows, "origin string, project string, session_id string, source_path string, pos long, timestamp string, text string").repartition(parts)
    got = sorted((r.session_id, r["index"], r.text) for r in corpus.first_owner_dedupe(df).collect())
    assert got == [("fork", 0, "x"), ("fork", 1, "y"), ("fork", 2, "z"), ("none", 0, "blank")]


def test_streaming_ownership_is_retroactive(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def add(name, *turns):
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(json.dumps(user(x, ts)) for ts, x in turns))
        keys = lambda df: df.select(F.lit("a").alias("origin"), F.lit("p").alias("project"), F.regexp_extract("source_path", r"([^/]+)\.jsonl$", 1).alias("session_id"), "source_path", "line_key", "value")
        ingest.stream_ingest(spark, f"{tmp_path}/in", "a", f"{tmp_path}/owners", f"{tmp_path}/check", keys).awaitTermination()
        return owned()

    def owned():
        names = {hashlib.sha256(x.encode()).hexdigest(): x for x in ("hello", "again", "first", "last")}
        return {(r.timestamp, names[r.text_hash]): r.session_id for r in ingest.owners(spark, f"{tmp_path}/owners").collect()}

    assert add("b", ("5", "hello"), ("6", "again")) == {("5", "hello"): "b", ("6", "again"): "b"}
    both = {("5", "hello"): "a", ("6", "again"): "b", ("1", "first"): "a"}
    assert add("a", ("1", "first"), ("5", "hello")) == both
    ingest.compact(spark, f"{tmp_path}/owners")
    assert owned() == both and not (tmp_path / "owners" / "new-0").exists()
    assert add("c", ("0", "last"), ("6", "again")) == both | {("6", "again"): "c", ("0", "last"): "c"}


@pytest.mark.parametrize("dialect", ["a", "k2", "k3"])
def test_very_long_lines_and_repeated_keys_are_messages(spark, monkeypatch, dialect):
    """A line beyond the parser's limit on strings, a text whose middle is cut out and put back, and a key that stands twice."""
    from turnmill.functions import variant

    long = "start " + 'a "b" \\ é \n' * 3000 + " end"
    image = "QUJD" * 20_000
    if dialect == "a":
        rows = [user([{"type": "text", "text": long}, {"type": "image", "source": {"data": image}}]), '{"type":"x","type":"user","timestamp":"t1","message":{"content":"no","content":"twice"}}']
    elif dialect == "k2":
        rows = [{"kind": "Prompt", "data": {"content": [{"kind": "text", "data": long}, {"kind": "image", "data": image}]}}, '{"kind":"Clear","kind":"Prompt","data":{"content":[{"kind":"text","data":"no","data":"twice"}]}}']
    else:
        rows = [{"timestamp": "t1", "payload": {"type": "user", "content": long, "image": image}}, '{"timestamp":"t1","payload":{"type":"user","content":"no","content":"twice"}}']
    monkeypatch.setattr(variant, "LONG_LINE", 20_000)
    monkeypatch.setattr(variant, "LONG_PIECE", 8_000)
    monkeypatch.setattr(variant, "EDGE", 1_000)
    events, drops, bad = run(spark, rows, dialect)
    assert [e[2].removesuffix("\n\n[image pasted]") for e in events] == [long, "twice"] and not drops and bad == 0


def test_a_line_of_forty_megabytes(spark):
    events, _, bad = run(spark, [user([{"type": "text", "text": "look at this"}, {"type": "image", "source": {"data": "QUJD" * 10_000_000}}]), user("x" * 22_000_000)], "a")
    assert bad == 0 and events[0][2] == "look at this\n\n[image pasted]" and len(events[1][2]) == 22_000_000


def _marked(dialect, filler, at, ascii_only=False, slashes=False):
    """A line whose one long text has the dialect's markers at the head, in the middle or at the end, with look-alikes before them."""
    gap = (filler, "") if at == "end" else ("", filler) if at == "head" else (filler, filler)
    steer = "[LIVE STEERING - New message from user]"
    if dialect == "a":
        rows = [
            user([{"type": "tool_result", "content": f"{gap[0]} \the user said: no, \\the user said: do\tit {gap[1]} the user said: twice"}]),
            user([{"type": "tool_result", "content": [{"type": "text", "text": filler}, {"type": "text", "text": gap[0] + "the user said:" + gap[1] + "end"}]}]),
            user(f"{gap[0]}<command-name>a<b</command-name> <command-args>{gap[1]}<command-name>/go</command-name><command-args> x {gap[0]} y</command-args>"),
            user(f"<system>{filler}</system>"),
        ]
    elif dialect == "k2":
        text = lambda s: {"kind": "text", "data": s}
        rows = [
            {"kind": "Prompt", "data": {"content": [text(f"{steer}{gap[0]}<user_messages><user_message a='{gap[1]}'> go {gap[0]} on </user_message> {filler}</user_message>")]}},
            {"kind": "Prompt", "data": {"content": [text(f"{steer}{gap[0]}</user_message><user_message>{gap[1]}"), text(filler + " plain")]}},
            {"kind": "ToolResults", "data": {"content": [text(f"{steer}{gap[0]}<user_message <command-name>{gap[1]} stop </user_message>")]}},
            {"kind": "Compaction", "data": {"messages_snapshot": [{"role": "user", "content": [text(f"{steer}{gap[0]}<user_message> once {gap[1]}</user_message>")]}]}},
        ]
    else:
        rows = [{"timestamp": "t1", "payload": {"type": "user", "content": f"{gap[0]} the user said: <command-name>x</command-name>{gap[1]} end"}}]
    lines = [r if isinstance(r, str) else json.dumps(r, ensure_ascii=ascii_only) for r in rows]
    lines = [line.replace("<", "\\u003c").replace("the user", "\\u0074he \\u0075ser") if ascii_only else line for line in lines]
    return [line.replace("/", "\\/") if slashes else line for line in lines]


@pytest.mark.parametrize("dialect", ["a", "k2", "k3"])
def test_markers_are_found_wherever_they_stand(spark, monkeypatch, dialect):
    """Texts that are cut between their markers, in four ways to write JSON, give what they give whole."""
    from turnmill.functions import variant

    filler = 'word "q" \\ é \n< ' * 100
    rows = [line for form in ((False, False), (True, False), (False, True), (True, True)) for at in ("head", "middle", "end") for line in _marked(dialect, filler, at, *form)]
    plain = run(spark, rows, dialect)
    each = len(plain[0]) // 4
    assert each and all(plain[0][i * each : (i + 1) * each] == plain[0][:each] for i in range(4))
    monkeypatch.setattr(variant, "LONG_LINE", 0)
    monkeypatch.setattr(variant, "LONG_PIECE", 600)
    monkeypatch.setattr(variant, "EDGE", 250)
    assert run(spark, rows, dialect) == plain


@pytest.mark.parametrize("dialect", ["a", "k2", "k3"])
def test_markers_in_strings_beyond_the_parser(spark, dialect):
    """A marker at the head, in the middle or at the end of a string of 21 million characters gives the same message as in a short one."""
    steer = "[LIVE STEERING - New message from user]"

    def lines_of(n):
        out = []
        for before, after in ((0, n), (n // 2, n // 2), (n, 0)):
            if dialect == "a":
                out.append(user([{"type": "tool_result", "content": "wide " * before + "the user said: go " + "wide " * after}]))
            elif dialect == "k2":
                out.append({"kind": "Prompt", "data": {"content": [{"kind": "text", "data": steer + "wide " * before + "<user_message> go </user_message>" + "wide " * after}]}})
            else:
                out.append({"payload": {"type": "user", "content": "wide " * before + "go " + "wide " * after}})
        return out

    squeezed = lambda events: [(k, t, re.sub(r"(wide ?)+", "wide ", text).strip()) for k, t, text in events]
    short, long = run(spark, lines_of(100), dialect), run(spark, lines_of(4_200_000), dialect)
    assert long[2] == 0 and len(short[0]) == 3 and squeezed(short[0]) == squeezed(long[0])
