"""From JSON lines to events and drops, for three line dialects.

Each dialect adds arrays of events and drops to the parsed lines with column
expressions; messages are the human events, so both views agree by construction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import text as t
from turnmill.functions import variant as v
from turnmill.sources.lines import KEYS

EVENT = "struct<kind:string,timestamp:string,text:string>"
DROP = "struct<reason:string,snippet:string,timestamp:string>"
SNAPSHOT = "struct<timestamp:string,text:string>"
PIECE = "struct<text:string,reason:string,raw:string>"

# What the logs' writers put into lines.
INTERRUPTIONS = ["[Request interrupted by user]", "[Request interrupted by user for tool use]"]
REJECTION = "the user said:"
IMAGE = "[image pasted]"
BRACKETS = ["[AGENT SYSTEM PROMPT]", "[Recent channel messages for context:]", "[Subagent completion event]", "[LIVE STEERING - New message from user]"]
STEERING = "[LIVE STEERING - New message from user]"
NUDGES = ["The generated tool was too large", "You took too long to respond", "You have not called the summary tool yet"]
MARK_CHARS = 1000  # of a prompt are kept to classify its session; marks are shorter
AUTOMATION = ["You are a session naming agent", "You are a memory consolidation agent", "You are generating contextual prompt suggestions"]


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _piece(text: Column, reason: Column, raw: Column) -> Column:
    return F.struct(text.cast("string").alias("text"), reason.cast("string").alias("reason"), raw.cast("string").alias("raw"))


def _starts(text: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


def _joined(pieces: Column) -> Column:
    """Surviving pieces, a blank line apart; null if none."""
    kept = F.filter(pieces, lambda p: p.reason.isNull())
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda p: p.text), "\n\n"))


def _dropped(pieces: Column, ts: Column) -> Column:
    gone = F.filter(pieces, lambda p: p.reason.isNotNull())
    return F.transform(gone, lambda p: F.struct(p.reason.alias("reason"), t.snippet(p.raw).alias("snippet"), F.when(ts != "", ts).alias("timestamp")))


def _event(kind: str | Column, ts: Column, text: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), ts.alias("timestamp"), text.alias("text"))


# dialect A ---------------------------------------------------------------


def recover_command(raw: Column) -> Column:
    """``[command] /name args`` of a slash command's tags, else null."""
    found = lambda tag: t.trim_all(F.regexp_extract(raw, rf"<command-{tag}>([^<]*)</command-{tag}>", 1))

    def shown(c: Column) -> Column:
        slashed = F.when(c["name"].startswith("/"), c["name"]).otherwise(F.concat(F.lit("/"), c["name"]))
        return F.when(c["name"] != "", F.concat(F.lit("[command] "), slashed, F.when(c["args"] == "", "").otherwise(F.concat(F.lit(" "), c["args"]))))

    return v.once(F.struct(found("name").alias("name"), found("args").alias("args")), shown)


def clean_piece_a(raw: Column) -> Column:
    def judged(b: Column) -> Column:
        reason = F.when(b.command.isNotNull(), None).when(b.text == "", "empty").when(b.text.startswith("<"), "machine block").when(b.text.isin(INTERRUPTIONS), "interruption")
        return _piece(F.coalesce(b.command, b.text), reason, b.raw)

    return v.once(v.once(raw, lambda r: F.struct(r.alias("raw"), t.trim_all(r).alias("text"), recover_command(r).alias("command"))), judged)


def _texts(blocks: Column) -> Column:
    """Texts of the text blocks of an array, newline-joined."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: v.text(b, "$.type") == "text"), lambda b: F.coalesce(v.text(b, "$.text"), F.lit(""))), "\n")


def _block_pieces_a(block: Column) -> Column:
    result = F.coalesce(v.text(block, "$.content"), _texts(v.array(block, "$.content")), F.lit(""))
    after = lambda r: F.when(F.locate(REJECTION, r) > 0, F.substring(r, F.locate(REJECTION, r) + len(REJECTION), F.length(r)))

    def pieces(b: Column) -> Column:
        return F.when(b.kind.isin("image", "document"), F.array(_piece(F.lit(IMAGE), F.lit(None), F.lit("")))).when(b.said.isNotNull(), F.array(clean_piece_a(b.said))).otherwise(_none(PIECE))

    def said(kind: Column) -> Column:
        return F.struct(kind.alias("kind"), F.when(kind == "text", F.coalesce(v.text(block, "$.text"), F.lit(""))).when(kind == "tool_result", v.once(result, after)).alias("said"))

    return v.once(v.once(v.text(block, "$.type"), said), pieces)


def _decisions(entry: Column) -> Column:
    def line(q: Column) -> Column:
        question = t.trim_all(v.text(q, "$.question"))
        chosen = F.array_join(F.filter(F.transform(v.array(q, "$.answer"), v.string), lambda a: a.isNotNull()), ", ")
        answer = F.coalesce(t.trim_all(v.text(q, "$.answer")), chosen, F.lit(""))
        return F.when((question != "") & (answer != ""), F.concat(F.lit('[decision] "'), question, F.lit('" → '), answer))

    lines = F.filter(F.transform(v.array(entry, "$.toolUseResult.questions"), line), lambda s: s.isNotNull())
    return F.coalesce(F.transform(lines, lambda s: _piece(s, F.lit(None), F.lit(""))), _none(PIECE))


def _rejection_a(e: Column) -> Column:
    return (
        F.when(v.truthy(e, "$.isMeta"), "meta").when(v.truthy(e, "$.isSidechain"), "side chain").when(v.truthy(e, "$.isCompactSummary"), "compact summary")
        .when(v.truthy(e, "$.isVisibleInTranscriptOnly"), "transcript only").when(v.text(e, "$.entrypoint").startswith("sdk"), "sdk entrypoint")
    )


def render_question(block: Column) -> Column:
    def line(q: Column) -> Column:
        question = t.trim_all(v.text(q, "$.question"))
        labels = F.filter(F.transform(v.array(q, "$.options"), lambda o: t.trim_all(F.coalesce(v.string(o), v.text(o, "$.label")))), lambda s: s.isNotNull() & (s != ""))
        multi = F.when(F.coalesce(F.try_variant_get(q, "$.multiSelect", "boolean"), F.lit(False)) & (v.kind(v.at(q, "$.multiSelect")) == "BOOLEAN"), " (multi-select)").otherwise("")
        options = F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, F.concat(F.lit(" ["), F.array_join(labels, ", "), F.lit("]"))).otherwise("")
        return F.when(question != "", F.concat(question, options, multi))

    lines = F.filter(F.transform(v.array(block, "$.input.questions"), line), lambda s: s.isNotNull())
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def _assistant_a(entry: Column, ts: Column) -> Column:
    """Text is buffered and flushed before each plan or question, in block order."""

    def flushed(acc: Column) -> Column:
        added = lambda said: F.when(said == "", acc["events"]).otherwise(F.concat(acc["events"], F.array(_event("assistant", ts, said))))
        return v.once(t.trim_all(F.array_join(acc["buffer"], "\n")), added)

    start = F.struct(F.array().cast("array<string>").alias("buffer"), _none(EVENT).alias("events"))

    def step(acc: Column, b: Column) -> Column:
        kind, name, text = v.text(b, "$.type"), v.text(b, "$.name"), v.text(b, "$.text")
        surface = (kind == "tool_use") & name.isin("ExitPlanMode", "AskUserQuestion")
        shown = F.when(name == "ExitPlanMode", F.coalesce(v.text(b, "$.input.plan"), F.lit(""))).otherwise(render_question(b))
        event = _event(F.when(name == "ExitPlanMode", "plan").otherwise("question"), ts, shown)
        return F.struct(
            F.when(F.coalesce(surface, F.lit(False)), F.array().cast("array<string>")).when((kind == "text") & text.isNotNull(), F.concat(acc["buffer"], F.array(text))).otherwise(acc["buffer"]).alias("buffer"),
            F.when(F.coalesce(surface, F.lit(False)), F.concat(flushed(acc), F.array(event))).otherwise(acc["events"]).alias("events"),
        )

    walked = F.aggregate(v.array(entry, "$.message.content"), start, step, flushed)
    whole = t.trim_all(v.text(entry, "$.message.content"))
    return F.coalesce(F.when(whole != "", F.array(_event("assistant", ts, whole))), walked, _none(EVENT))


def dialect_a(lines: DataFrame) -> DataFrame:
    e, kind, reject, ts, content = (F.col(c) for c in ("v", "_kind", "_reject", "_ts", "_content"))
    att = v.at(e, "$.attachment")
    lines = lines.withColumns({
        "_kind": v.text(e, "$.type"), "_reject": _rejection_a(e), "_ts": F.coalesce(v.text(e, "$.timestamp"), v.text(att, "$.timestamp"), F.lit("")),
        "_content": v.text(e, "$.message.content"),
        "_queued": F.coalesce((v.text(att, "$.type") == "queued_command") & (v.text(att, "$.origin.kind") == "human") & (v.text(att, "$.commandMode") == "prompt"), F.lit(False)),
    })
    excerpt = F.coalesce(content, F.nullif(_texts(v.array(e, "$.message.content")), F.lit("")), v.text(att, "$.prompt"), v.text(att, "$.text"),
                         F.concat(F.lit("<"), v.text(att, "$.type"), F.lit(">")), F.to_json(e))
    user = F.concat(
        F.when(content.isNotNull(), F.array(clean_piece_a(content))).otherwise(F.coalesce(F.flatten(F.transform(F.filter(v.array(e, "$.message.content"), v.is_object), _block_pieces_a)), _none(PIECE))),
        _decisions(e),
    )
    queued_piece = clean_piece_a(F.coalesce(v.text(att, "$.prompt"), v.text(att, "$.text"), F.lit("")))
    pieces = (
        F.when(reject.isNotNull() & kind.isin("user", "attachment"), F.array(_piece(F.lit(None), reject, excerpt)))
        .when(reject.isNotNull(), _none(PIECE))
        .when(kind == "user", user)
        .when((kind == "attachment") & F.col("_queued"), F.array(queued_piece))
        .when(kind == "attachment", F.array(_piece(F.lit(None), F.lit("attachment"), excerpt)))
        .otherwise(_none(PIECE))
    )
    lines = lines.withColumn("_pieces", pieces).withColumn("_said", _joined(F.col("_pieces")))
    said = F.col("_said")
    events = F.when(said.isNotNull(), F.array(_event("human", ts, said))).when((kind == "assistant") & reject.isNull(), _assistant_a(e, ts)).otherwise(_none(EVENT))
    return lines.withColumn("events", events).withColumn("drops", _dropped(F.col("_pieces"), ts))


# dialects K2 and K3 --------------------------------------------------------


def recover_steering(text: Column) -> Column:
    """The words inside a steering envelope, else null."""
    body = t.trim_all(F.regexp_extract(text, r"(?s)<user_message\b[^>]*>(.*?)</user_message>", 1))
    return F.when(text.startswith(STEERING) & (body != ""), body)


def _prompt_pieces(data: Column) -> Column:
    def piece(b: Column) -> Column:
        raw = F.coalesce(v.text(b, "$.data"), F.lit(""))
        seen = v.once(t.trim_all(raw), lambda x: F.struct(F.coalesce(v.text(b, "$.kind"), F.lit("undefined")).alias("kind"), raw.alias("raw"), x.alias("text"), recover_steering(x).alias("steered")))
        return v.once(seen, lambda x: judged(b, x["kind"], x["raw"], x["text"], x["steered"]))

    def judged(b: Column, kind: Column, raw: Column, text: Column, steered: Column) -> Column:
        reason = (
            F.when(kind == "image", None).when(kind != "text", F.concat(F.lit("unknown block "), kind)).when(text == "", "empty").when(steered.isNotNull(), None)
            .when(text.startswith("<"), "machine block").when(_starts(text, BRACKETS), "bracket marker").when(_starts(text, NUDGES), "harness nudge")
        )
        shown = F.when(kind == "text", raw).otherwise(F.coalesce(v.text(b, "$.data"), F.to_json(v.at(b, "$.data")), F.lit('""')))
        return _piece(F.when(kind == "image", IMAGE).otherwise(F.coalesce(steered, text)), reason, shown)

    return F.coalesce(F.transform(F.filter(v.array(data, "$.content"), v.is_object), piece), _none(PIECE))


def _k2_time(data: Column) -> Column:
    return t.epoch_to_iso(v.number(data, "$.meta.timestamp"))


def dialect_k2(lines: DataFrame) -> DataFrame:
    e, kind, ts, said = F.col("v"), F.col("_kind"), F.col("_ts"), F.col("_said")
    data = v.at(e, "$.data")
    lines = lines.withColumns({"_kind": v.text(e, "$.kind"), "_ts": _k2_time(data), "_pieces": _prompt_pieces(data)}).withColumn("_said", _joined(F.col("_pieces")))
    blocks = F.filter(v.array(data, "$.content"), lambda b: v.is_object(b) & (v.text(b, "$.kind") == "text") & v.text(b, "$.data").isNotNull())
    spoken = t.trim_all(F.array_join(F.transform(blocks, lambda b: v.text(b, "$.data")), "\n"))
    steered = F.filter(F.transform(blocks, lambda b: v.once(t.trim_all(v.text(b, "$.data")), recover_steering)), lambda s: s.isNotNull())
    lines = lines.withColumn("_spoken", F.when(kind == "AssistantMessage", F.coalesce(spoken, F.lit(""))))
    events = (
        F.when((kind == "Prompt") & said.isNotNull(), F.array(_event("human", ts, said)))
        .when((kind == "AssistantMessage") & (F.col("_spoken") != ""), F.array(_event("assistant", F.lit(""), F.col("_spoken"))))
        .when(kind == "ToolResults", F.coalesce(F.transform(steered, lambda s: _event("human", ts, s)), _none(EVENT)))
        .when(kind.isin("Clear", "Compaction"), F.array(_event("boundary", F.lit(""), kind)))
        .otherwise(_none(EVENT))
    )
    return lines.withColumn("events", events).withColumn("drops", F.when(kind == "Prompt", _dropped(F.col("_pieces"), ts)).otherwise(_none(DROP)))


def dialect_k3(lines: DataFrame) -> DataFrame:
    e, kind, content, ts, text = (F.col(c) for c in ("v", "_kind", "_content", "_ts", "_text"))
    lines = lines.withColumns({"_kind": v.text(e, "$.payload.type"), "_content": v.text(e, "$.payload.content"), "_ts": F.coalesce(v.text(e, "$.timestamp"), F.lit(""))})
    lines = lines.withColumn("_text", F.coalesce(t.trim_all(content), F.lit("")))
    events = (
        F.when((kind == "user") & (text != ""), F.array(_event("human", ts, text)))
        .when((kind == "assistant") & (v.text(e, "$.payload.operationType") == "Say") & (text != ""), F.array(_event("assistant", ts, text)))
        .otherwise(_none(EVENT))
    )
    drop = F.struct(F.lit("empty").alias("reason"), t.snippet(F.coalesce(content, F.lit(""))).alias("snippet"), F.when(ts != "", ts).alias("timestamp"))
    return lines.withColumn("events", events).withColumn("drops", F.when((kind == "user") & (text == ""), F.array(drop)).otherwise(_none(DROP)))


DIALECTS: dict[str, Callable[[DataFrame], DataFrame]] = {"a": dialect_a, "k2": dialect_k2, "k3": dialect_k3}


def _first_block(data: Column) -> Column:
    """The first text block with something in it."""
    blocks = F.transform(F.filter(v.array(data, "$.content"), lambda b: v.text(b, "$.kind") == "text"), lambda b: t.trim_all(v.text(b, "$.data")))
    return F.get(F.filter(blocks, lambda s: s != ""), 0)


def _prompt(e: Column, dialect: str) -> Column:
    """The beginning of a prompt, by which sessions are classified; null for other lines."""
    if dialect == "k2":
        said = F.when(v.text(e, "$.kind") == "Prompt", _first_block(v.at(e, "$.data")))
    elif dialect == "k3":
        said = F.when(v.text(e, "$.payload.type") == "user", F.nullif(t.trim_all(v.text(e, "$.payload.content")), F.lit("")))
    else:
        return F.lit(None).cast("string")
    return F.left(said, F.lit(MARK_CHARS))


def _snapshot(e: Column, dialect: str, cuts: Column) -> Column:
    """(timestamp, text) of the human messages that a compaction line repeats."""
    if dialect != "k2":
        return _none(SNAPSHOT)
    said = F.filter(v.array(e, "$.data.messages_snapshot"), lambda i: v.text(i, "$.role") == "user")
    found = F.transform(said, lambda i: F.struct(_k2_time(i).alias("timestamp"), v.restore(_joined(_prompt_pieces(i)), cuts).alias("text")))
    return F.when(v.text(e, "$.kind") == "Compaction", F.coalesce(found, _none(SNAPSHOT))).otherwise(_none(SNAPSHOT))


def parse_lines(lines: DataFrame, dialect: str) -> DataFrame:
    """One row a line: keys, ``bytes`` if the lines have it, ``line_key``, ``v``, ``is_bad``, ``events``, ``drops``, ``prompt``, ``snapshot``.

    A line that isn't JSON is bad; so is JSON that isn't an object, but in K3.  A
    blank line has no value and isn't bad.  Of a repeated key the last value
    counts (a setting of the session, which stays).  Strings beyond the parser's
    limit are cut before and restored in events and snapshots.
    """
    v.allow_repeated_keys(lines.sparkSession)
    more = [c for c in ("bytes",) if c in lines.columns]
    short = lines.select(*KEYS, *more, "line_key", (t.trim_all(F.col("value")) == "").alias("_blank"), v.shorten(F.col("value")).alias("_short"))
    parsed = short.select(*KEYS, *more, "line_key", "_blank", F.when(~F.col("_blank"), v.parse(F.col("_short.text"))).alias("v"), F.col("_short.cuts").alias("cuts"))
    parsed = parsed.withColumn("_object", v.is_object(F.col("v")))
    bad = F.col("v").isNull() if dialect == "k3" else ~F.col("_object")
    out = DIALECTS[dialect](parsed)
    only = lambda c, kind: F.when(F.col("_object"), c).otherwise(_none(kind))
    whole = F.transform("events", lambda e: _event(e.kind, e.timestamp, v.restore(e.text, F.col("cuts"))))
    events = F.when(F.size("cuts") > 0, whole).otherwise(F.col("events"))
    return out.select(*KEYS, *more, "line_key", "v", (bad & ~F.col("_blank")).alias("is_bad"), only(events, EVENT).alias("events"), only(F.col("drops"), DROP).alias("drops"),
                      _prompt(F.col("v"), dialect).alias("prompt"), _snapshot(F.col("v"), dialect, F.col("cuts")).alias("snapshot"))


def _exploded(df: DataFrame, column: str) -> DataFrame:
    """Rows of an outer explode without the empty ones.  An inner explode would make the optimizer
    infer a filter on the array, and push that array's whole expression down again and again."""
    return df.filter(F.col(column).isNotNull())


def timeline(parsed: DataFrame) -> DataFrame:
    """Events of every session in file order, with ``event_pos`` from 0."""
    flat = _exploded(parsed.select(*KEYS, "line_key", F.posexplode_outer("events").alias("at", "e")), "e")
    order = Window.partitionBy(*KEYS).orderBy("line_key", "at")
    return flat.select(*KEYS, (F.row_number().over(order) - 1).cast("long").alias("event_pos"), "e.kind", "e.timestamp", "e.text")


def messages(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'human'").select(*KEYS, F.col("event_pos").alias("pos"), "timestamp", "text")


def drops(parsed: DataFrame, dialect: str) -> DataFrame:
    """What was taken for machine text or left out, with its reason."""
    out = _exploded(parsed.select(*KEYS, F.explode_outer("drops").alias("d")), "d").select(*KEYS, "d.*")
    return out.unionByName(snapshot_only(parsed)) if dialect == "k2" else out


def snapshot_only(parsed: DataFrame) -> DataFrame:
    """Prompts of a compaction snapshot that never appear live in the same file.

    Texts are told apart by their digests and shown by their snippets, which are
    taken before anything is shuffled.
    """
    stamp, digest = F.col("timestamp"), F.sha2("text", 256).alias("digest")
    said = _exploded(parsed.select(*KEYS, F.explode_outer("snapshot").alias("s")), "s").select(*KEYS, "s.*").filter("text is not null")
    said = said.select(*KEYS, "timestamp", digest, t.snippet(F.col("text")).alias("snippet")).distinct()
    live = parsed.select(*KEYS, F.explode_outer("events").alias("e")).filter("e.kind = 'human'").select(*KEYS, "e.timestamp", "e.text")
    gone = said.join(live.select(*KEYS, "timestamp", digest).distinct(), [*KEYS, "timestamp", "digest"], "left_anti")
    return gone.select(*KEYS, F.lit("snapshot only").alias("reason"), "snippet", F.when(stamp != "", stamp).alias("timestamp"))


def bad_lines(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(*KEYS).agg(F.count_if("is_bad").alias("bad_lines"))


def first_prompts(parsed: DataFrame) -> DataFrame:
    """(keys, prompt) of every session with a line; the prompt is its first one, or null."""
    return parsed.groupBy(*KEYS).agg(F.min_by("prompt", F.when(F.col("prompt").isNotNull(), F.col("line_key"))).alias("prompt"))


def session_reason(prompt: Column, has_history: Column, parent_id: Column, origin: Column, own_mark: str | None = None) -> Column:
    """Why a session counts as a human's (``history``, ``default``) or doesn't; dialect A has no such rule."""
    if own_mark and len(own_mark) > MARK_CHARS:
        raise ValueError(f"a mark has at most {MARK_CHARS} characters")
    p = F.coalesce(prompt, F.lit(""))
    own = p.startswith(own_mark) if own_mark else F.lit(False)
    return (
        F.when(origin == "a", "default").when(own, "own session").when(F.coalesce(has_history, F.lit(False)), "history")
        .when((origin == "k2") & parent_id.isNotNull(), "spawned child").when(p.startswith(BRACKETS[0]), "agent prompt")
        .when(_starts(p, AUTOMATION), "automation").when(_starts(p, NUDGES), "nudge only").otherwise("default")
    )


def classify_sessions(parsed: DataFrame, meta: DataFrame, dialect: str, own_mark: str | None = None) -> DataFrame:
    """Keys, ``include`` and ``reason``: was a human at work in this session?

    ``meta`` has ``session_id``, ``has_history`` and ``parent_id``; ``own_mark``
    leads the prompts of sessions that this library's user started by machine.
    """
    found = first_prompts(parsed).join(meta.select("session_id", "has_history", "parent_id"), "session_id", "left")
    reason = session_reason(F.col("prompt"), F.col("has_history"), F.col("parent_id"), F.lit(dialect), own_mark)
    return found.select(*KEYS, reason.isin("history", "default").alias("include"), reason.alias("reason"))
