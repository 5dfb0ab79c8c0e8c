"""Registered queries of the extraction rules, the stores, the prompts and the resumption of runs.

Each turn of ``conversations`` is a log line whose shape follows from the
length of its text, so that every rule meets many lines; sessions, records and
answers are made of ids.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import text as t
from turnmill.functions import variant as v
from turnmill.operators import grouping, names, tasks
from turnmill.plans import prompts
from turnmill.plans.queries import _digests, _documents, _lines_k2, _lines_k3, _members, _stamp, _table, _tasks, _turns
from turnmill.sources import dialects, lines, sessions
from turnmill.sources.lines import KEYS


def _key(n: Column) -> Column:
    return F.struct(F.lit(0).alias("block"), n.alias("row")).alias("line_key")


def _json(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*((F.lit(x) if isinstance(x, str) else x).alias(k) for k, x in fields.items())))


def _shape(count: int) -> Column:
    return F.length("text") % count


def _by_shape(count: int, shapes: list[Column]) -> Column:
    out = F.when(_shape(count) == 0, shapes[0])
    for i, line in enumerate(shapes[1:], 1):
        out = out.when(_shape(count) == i, line)
    return out


def _block(kind: str, **fields: Column | str) -> Column:
    """A block; all blocks of a list have one type, and to_json leaves nulls out."""
    known = {"type": kind, "text": None, "content": None, "name": None, **fields}
    own = [(F.lit(x) if x is None or isinstance(x, str) else x).cast("string").alias(k) for k, x in known.items() if k != "input"]
    question = F.struct(F.lit("Go on?").alias("question"), F.array(F.lit("yes"), F.lit(" no ")).alias("options"), F.lit(True).alias("multiSelect"))
    shown = F.struct(fields.get("plan", F.lit(None).cast("string")).alias("plan"), F.when(F.lit(known["name"] == "AskUserQuestion"), F.array(question)).alias("questions"))
    return F.struct(*own[:4], shown.alias("input"))


def _rule_lines_a(spark: SparkSession, d: str) -> DataFrame:
    x, ts = F.col("text"), F.col("timestamp")
    message = lambda content: F.struct(content.alias("content"))
    user = lambda content: _json(type="user", timestamp=ts, message=message(content))
    origin = lambda kind: F.struct(F.lit(kind).alias("kind"))
    queued = lambda kind, field: _json(type="attachment", timestamp=ts, attachment=F.struct(F.lit("queued_command").alias("type"), origin(kind).alias("origin"), F.lit("prompt").alias("commandMode"), x.alias(field)))
    chosen = F.array(F.struct(x.alias("question"), F.array(F.lit("a"), F.lit("b")).alias("answer")), F.struct(F.lit("").alias("question"), F.array(F.lit("z")).alias("answer")))
    repeated = F.concat(F.lit('{"type":"system",'), F.substring(user(x), 2, 2**30))
    said = _by_shape(9, [
        user(F.array(_block("text", text=x), _block("tool_result", content=F.concat(F.lit("no. the user said: "), x)), _block("odd"))), queued("human", "prompt"), queued("human", "text"), queued("agent", "prompt"),
        user(F.concat(F.lit("<command-name>go</command-name><command-args> "), x, F.lit(" </command-args>"))), _json(type="user", timestamp=ts, message=message(F.array().cast("array<string>")), toolUseResult=F.struct(chosen.alias("questions"))),
        user(F.concat(F.lit("<ide>"), x)), user(F.lit("[Request interrupted by user]")), repeated,
    ])
    blocks = F.array(_block("text", text=x), _block("tool_use", name="ExitPlanMode", plan=F.concat(F.lit("plan "), F.length("text").cast("string"))), _block("tool_use", name="AskUserQuestion"), _block("tool_use", name="Other"), _block("text", text="end"))
    answered = F.when(_shape(2) == 0, _json(type="assistant", timestamp=ts, message=message(blocks))).otherwise(_json(type="assistant", timestamp=ts, message=message(x)))
    line = F.when(F.col("kind") == "human", said).when(F.col("kind") == "boundary", _json(type="system", timestamp=ts)).otherwise(answered)
    return _turns(spark, d, forks=False).select(*KEYS, _key(F.col("event_pos")), line.alias("value"))


def rules_dialect_a(spark: SparkSession, d: str) -> DataFrame:
    events = dialects.timeline(dialects.parse_lines(_rule_lines_a(spark, d), "a"))
    return events.select("session_id", "event_pos", "kind", "timestamp", "text")


def rule_drops_a(spark: SparkSession, d: str) -> DataFrame:
    return dialects.drops(dialects.parse_lines(_rule_lines_a(spark, d), "a"), "a").select("session_id", "reason", "snippet", "timestamp")


def rule_bad_lines(spark: SparkSession, d: str) -> DataFrame:
    """No line is bad: not one with a repeated key either."""
    return dialects.bad_lines(dialects.parse_lines(_rule_lines_a(spark, d), "a")).select("session_id", "bad_lines")


def _rule_lines_k2(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    block = lambda kind, data=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if data is None else F.lit(data) if isinstance(data, str) else data).alias("data"))
    meta = F.struct((F.lit(1_700_000_000) + F.col("event_pos")).alias("timestamp"))
    entry = lambda kind, *blocks: F.array(_json(kind=kind, data=F.struct(F.array(*blocks).alias("content"), meta.alias("meta"))))
    steer = F.concat(F.lit("[LIVE STEERING - New message from user]\n<user_message id=\"1\">\n"), x, F.lit("\n</user_message>"))
    item = lambda role, said: F.struct(F.lit(role).alias("role"), F.array(block("text", said)).alias("content"), meta.alias("meta"))
    snapshot = F.array(item("user", x), item("user", F.concat(F.lit("only here "), x)), item("assistant", F.lit("no prompt")))
    compacted = _json(kind="Compaction", data=F.struct(snapshot.alias("messages_snapshot")))
    said = _by_shape(6, [
        entry("Prompt", block("text", x), block("image"), block("audio", "zz")), entry("Prompt", block("text", F.concat(F.lit("[Subagent completion event] "), x))), entry("Prompt", block("text", F.concat(F.lit("You took too long to respond: "), x))),
        entry("ToolResults", block("text", steer), block("toolResult", "m"), block("text", "plain")), F.concat(entry("Prompt", block("text", x)), F.array(compacted)), entry("Prompt", block("text", x), block("text", "  ")),
    ])
    line = F.when(F.col("kind") == "human", said).when(F.col("kind") == "boundary", F.array(_json(kind="Clear"))).otherwise(entry("AssistantMessage", block("text", x), block("toolUse"), block("text", "b")))
    return _turns(spark, d, forks=False).select(*KEYS, "event_pos", F.posexplode(line).alias("at", "value")).select(*KEYS, _key(F.col("event_pos") * 2 + F.col("at")), "value")


def rules_dialect_k2(spark: SparkSession, d: str) -> DataFrame:
    events = dialects.timeline(dialects.parse_lines(_rule_lines_k2(spark, d), "k2"))
    return events.select("session_id", "event_pos", "kind", "timestamp", "text")


def rule_drops_k2(spark: SparkSession, d: str) -> DataFrame:
    return dialects.drops(dialects.parse_lines(_rule_lines_k2(spark, d), "k2"), "k2").select("session_id", "reason", "snippet", "timestamp")


def classify_tree_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of a conversation begin with a mark that follows from its id; a parent doesn't matter in this store."""
    n = F.col("session_id").cast("long")
    turns = _turns(spark, d, forks=False).filter("kind = 'human'")
    mark = F.when(n % 5 == 0, "[AGENT SYSTEM PROMPT] ").when(n % 5 == 1, "You are a session naming agent. ").when(n % 5 == 2, "[own run] ").when(n % 5 == 3, "You took too long to respond. ").otherwise("")
    payload = F.struct(F.lit("user").alias("type"), F.concat(mark, "text").alias("content"))
    logs = turns.select(*KEYS, _key(F.col("event_pos")), _json(timestamp=F.col("timestamp"), payload=payload).alias("value"))
    meta = logs.select("session_id").distinct().select("session_id", (n % 7 == 0).alias("has_history"), F.lit("x").alias("parent_id"))
    return dialects.classify_sessions(dialects.parse_lines(logs, "k3"), meta, "k3", "[own run]").select("session_id", "include", "reason")


def detect_formats(spark: SparkSession, d: str) -> DataFrame:
    """Odd conversations are logs of the tree store, even ones of the flat store."""
    n = F.col("session_id").cast("long")
    both = _lines_k3(spark, d).filter(n % 2 == 1).unionByName(_lines_k2(spark, d).filter(n % 2 == 0))
    return lines.detect_format(both).select("session_id", "format")


def _uuid(n: Column) -> Column:
    return F.regexp_replace(F.md5(n.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _stores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every conversation in the flat store; of three, the first two are in the tree store, too."""
    n = F.col("conv_id")
    old = _table(spark, d, "conversations").select(n).distinct().withColumn("session_id", _uuid(n))
    new = old.filter(n % 3 < 2).select("conv_id", F.when(n % 3 == 0, F.concat(F.lit("sess_"), "session_id")).otherwise(F.concat(F.lit("cli_"), "session_id", F.lit("_x"))).alias("session_id"))
    return old, new


def newer_store_wins(spark: SparkSession, d: str) -> DataFrame:
    old, new = _stores(spark, d)
    return lines.prefer_newer_store(old, new).select("conv_id", "session_id")


def orphan_histories(spark: SparkSession, d: str) -> DataFrame:
    old, new = _stores(spark, d)
    n = F.col("conv_id")
    stem = F.when(n % 4 == 0, F.col("session_id")).when(n % 4 == 1, F.concat(F.lit("sess_"), "session_id")).when(n % 4 == 2, F.concat(F.lit("gone-"), n.cast("string"))).otherwise(F.concat(F.lit("cli_"), "session_id", F.lit("_x")))
    return lines.orphan_histories(old.select(stem.alias("stem")), old, new).select("stem")


def _session_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of all stores: folders by id, changed when their last turn was said."""
    n = F.col("session_id").cast("long")
    last = _turns(spark, d).groupBy("session_id").agg(F.max("timestamp").alias("mtime"), F.first("source_path").alias("source_path"))
    origin = F.when(n % 3 == 0, "a").when(n % 3 == 1, "k2").otherwise("k3")
    cwd = F.when((n % 3 > 0) & (n % 5 > 0), F.concat(F.lit("/w"), (n % 5).cast("string"), F.lit("/src")))
    return last.select("session_id", "mtime", "source_path", origin.alias("origin"), cwd.alias("cwd"), F.concat(F.lit("-home-w"), (n % 4).cast("string"), F.lit("-app")).alias("folder"))


def session_projects(spark: SparkSession, d: str) -> DataFrame:
    return sessions.name_projects(_session_rows(spark, d)).select("session_id", "project")


def folder_groups(spark: SparkSession, d: str) -> DataFrame:
    return tasks.group_by_folder(_session_rows(spark, d).filter("origin <> 'a'"))


def newest_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each folder, the newest first, with their places."""
    return sessions.newest_first(_session_rows(spark, d), "folder").select("session_id", "folder", "place")


def session_metadata(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    flat = _json(cwd=F.col("url"), title=F.concat(F.lit("t"), n.cast("string")), parent_session_id=F.when(n % 4 == 0, F.col("url")))
    tree = _json(workspacePaths=F.array(F.col("url"), F.lit("/other")), rootPaths=F.array(F.lit("/root")), parentSessionId=F.lit("p"))
    body = F.when(n % 5 == 0, flat).when(n % 5 == 1, tree).when(n % 5 == 2, '{"rootPaths":["/r"],"title":7}').when(n % 5 == 3, '{"workspacePaths":[],"rootPaths":["/r"]}').otherwise("{bad")
    files = _table(spark, d, "pages").select(n.cast("string").alias("meta_path"), body.alias("value"))
    return lines.parse_session_meta(files)


def document_names(spark: SparkSession, d: str) -> DataFrame:
    """Ids that agree in their first eight characters, some in all."""
    n = F.col("conv_id")
    stem = F.concat(F.lit("abcdefgh"), F.substring(F.md5(n.cast("string")), 1, F.when(n % 10 == 0, 0).otherwise(3)))
    rows = _table(spark, d, "conversations").select(n).distinct().select("conv_id", F.concat(F.lit("p "), (n % 2).cast("string")).alias("project"), stem.alias("session_id"))
    return names.allocate_document_names(rows, ["conv_id"]).select("conv_id", "export")


def unreadable_members(spark: SparkSession, d: str) -> DataFrame:
    """Some members have no document, so their tasks fail before any work."""
    documents = _documents(spark, d).filter(~F.col("export").like("%77.md"))
    return tasks.task_budget(_members(spark, d), documents, 100_000, "never").select("slug", "members", "chars", "status")


def member_rows(spark: SparkSession, d: str) -> DataFrame:
    members = _members(spark, d)
    manifest = members.filter("pos % 4 <> 0").select("export", F.concat(F.lit("s"), F.col("pos").cast("string")).alias("session_id"), F.when(F.col("pos") % 3 > 0, "k2").alias("origin"))
    said = _table(spark, d, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("export"), F.explode(F.sequence(F.lit(0), F.col("doc_id") % 3)).alias("index"), F.when(F.col("quality") == 1, "plan").alias("decision_kind"))
    return tasks.member_rows(members, _digests(spark, d), manifest, said).drop("pos")


def truncated_members(spark: SparkSession, d: str) -> DataFrame:
    return tasks.truncations(_members(spark, d), _documents(spark, d), 100_000)


def parsed_documents(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    content = F.when(n % 3 == 0, F.concat(F.lit("<!-- note -->\n\n# Title "), n.cast("string"), F.lit("\n\n"), "text")).when(n % 3 == 1, F.concat(F.lit("\n# Only\n"), "text")).otherwise(F.col("text"))
    return _table(spark, d, "documents").select("doc_id", t.parse_document(content).alias("p")).select("doc_id", "p.*")


def library_listing(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    library = _table(spark, d, "documents").select(
        F.concat(F.lit("s"), n.cast("string")).alias("slug"), F.concat(F.lit("T"), n.cast("string")).alias("title"), F.array("source", "lang").alias("domains"), F.array_repeat("source", (n % 3 + 1).cast("int")).alias("members"), F.lit("high").alias("confidence"),
        F.concat(F.lit("2024-01-01T"), _stamp(n)).alias("authored_at"), F.when(n % 4 == 0, 0.125).otherwise(1.0).alias("coverage"), (n % 2 == 0).alias("is_edited"), F.when(n % 3 > 0, (n % 3).cast("int")).alias("rating"), F.concat(F.lit("# T\n\n"), "text").alias("content"))
    return tasks.library_view(library)


def misc_union(spark: SparkSession, d: str) -> DataFrame:
    """Three windows name overlapping sessions."""
    n = F.col("doc_id")
    windows = [_table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.floor(n / k).cast("string")).alias("member")) for k in (2, 3, 5)]
    return grouping.misc_union(functools.reduce(DataFrame.unionByName, windows))


def coverage_equality(spark: SparkSession, d: str) -> DataFrame:
    """The same inputs, one input more, and one input less than what was grouped."""
    made, own = _tasks(spark, d), _members(spark, d)
    misc = own.filter("slug = 'src1'").select(F.col("export").alias("member"))
    inputs = own.select(F.col("export").alias("id"))
    more, less = inputs.unionByName(spark.sql("select 'new.md' as id")), inputs.filter("id <> 'doc-3.md'")
    cases = [grouping.same_coverage(made, misc, i).select(F.lit(name).alias("inputs"), "same") for name, i in (("same", inputs), ("more", more), ("less", less))]
    return functools.reduce(DataFrame.unionByName, cases)


def resume_note(spark: SparkSession, d: str) -> DataFrame:
    """Documents of even ids are eligible; digests of odd ones don't count as done."""
    return tasks.resume_note(_members(spark, d).filter("pos % 2 = 0").select("export"), _digests(spark, d))


def cluster_prompts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    digests = _digests(spark, d).select("export", "goal", F.lit("x").alias("deliverable"), "domain", F.array(F.lit("k")).alias("keywords"), "outcome", F.concat(F.lit("g"), (n % 4).cast("string")).alias("win"), F.when(n % 4 == 0, "a").when(n % 4 == 1, "k2").when(n % 8 == 2, "k3").otherwise("a").alias("origin"))
    return prompts.cluster_prompts(digests, "win", "{noun}|{sessions}").select("win", F.sha2("prompt", 256).alias("prompt_hash"))


def merge_prompts(spark: SparkSession, d: str) -> DataFrame:
    made = _tasks(spark, d).withColumn("rationale", F.concat(F.lit("why "), "slug")).withColumn("win", F.lit("all"))
    return prompts.merge_prompts(made, "win", "{count}|{tasks}").select("prompt")


def author_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A task a source; every other document has a line of context."""
    members = _members(spark, d).withColumn("origin", F.when(F.col("slug") == "src2", "k2").otherwise("a"))
    number = F.col("pos").cast("string")
    said = members.select("export", F.lit(0).alias("index"), F.concat(F.lit("go "), number).alias("human_text"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("said "), number)).alias("antecedent"), F.lit(None).cast("string").alias("decision_kind"), F.lit(None).cast("string").alias("decision_text"))
    made = prompts.author_prompts(_tasks(spark, d), members, _documents(spark, d), said, budget=20_000, template="{slug}|{title}|{legend}|{members}", legend="L")
    return made.select("slug", F.sha2("prompt", 256).alias("prompt_hash"), F.length("prompt").alias("chars"))


def consolidate_prompt(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    ranked = _table(spark, d, "documents").select(F.concat(F.lit("do "), n.cast("string")).alias("text"), (n % 7 + 1).alias("count"), (n % 3).cast("string").alias("last_authored_at"))
    return prompts.consolidate_prompt(ranked, "{preferences}").select(F.sha2("prompt", 256).alias("prompt_hash"))


def answer_validation(spark: SparkSession, d: str) -> DataFrame:
    """Answers of each stage, whole or with one fault that follows from the id."""
    n, s = F.col("doc_id"), F.lit("x")
    odd = lambda k, good, bad=None: F.when(n % 6 != k, good if isinstance(good, Column) else F.lit(good)).otherwise(F.lit(bad))
    bare = lambda **fields: F.struct(*((F.lit(x) if isinstance(x, str) else x).alias(k) for k, x in fields.items()))
    cluster = _json(tasks=F.array(bare(slug="a-b", title=odd(1, s), rationale="r", members=F.array(s))), misc=F.when(n % 6 != 2, F.array(s)))
    merge = _json(merges=F.array(bare(slugs=F.when(n % 6 != 3, F.array(s, s)), slug="a-b", title="t", rationale=odd(4, s))))
    author = _json(slug=odd(1, s), title=odd(2, s), content=F.when(n % 6 != 3, F.repeat(s, 120)).otherwise("short"), confidence=odd(4, "high", "sure"), preferences=F.array(bare(text="p", evidence=odd(5, s))))
    united = F.when(n % 6 == 5, '["no object"]').otherwise(_json(preferences=F.array(bare(text="p", merged_from=F.when(n % 6 != 1, 2)))))
    parsed = [v.parse(x) for x in (cluster, merge, author, united)]
    checks = (tasks.cluster_problem, tasks.merge_problem, tasks.author_problem, tasks.consolidate_problem)
    return _table(spark, d, "labels").select("doc_id", *(check(p).alias(name) for check, p, name in zip(checks, parsed, ("cluster", "merge", "author", "united"), strict=True)))


def run_costs(spark: SparkSession, d: str) -> DataFrame:
    """Footers of answers, added up for each run."""
    n = F.col("doc_id")
    answers = _table(spark, d, "labels").select((n % 5).alias("run"), F.concat(F.lit("{}\n"), F.when(n % 2 == 0, F.concat(F.lit("Credits: "), (n % 8 / 4).cast("decimal(4,2)").cast("string"))).otherwise("")).alias("response"))
    return tasks.response_cost(tasks.parse_responses(answers), "run")


def preference_occurrences(spark: SparkSession, d: str) -> DataFrame:
    from turnmill.operators import preferences
    from turnmill.plans.queries import _preferences

    return preferences.preference_occurrences(_preferences(spark, d)).select("key", "slug", "evidence")


def flat_preferences(spark: SparkSession, d: str) -> DataFrame:
    """United items that name no tasks are a flat list, whatever the number of tasks."""
    from turnmill.operators import preferences

    n = F.col("doc_id")
    none = F.array().cast("array<struct<slug:string,evidence:string>>")
    items = _table(spark, d, "labels").select(F.concat(F.lit("do "), n.cast("string")).alias("text"), F.lit(1).cast("long").alias("count"), _stamp(n).alias("last_authored_at"), none.alias("occurrences"))
    return preferences.render_block(items, 20, preferences.target_comment("agents", "2024-01-01"), grouped=preferences.has_occurrences(items))


QUERIES = {f.__name__: f for f in (
    rules_dialect_a, rule_drops_a, rule_bad_lines, rules_dialect_k2, rule_drops_k2, classify_tree_sessions, detect_formats, newer_store_wins, orphan_histories, session_projects, folder_groups,
    newest_sessions, session_metadata, document_names, unreadable_members, member_rows, truncated_members, parsed_documents, library_listing, misc_union, coverage_equality, resume_note,
    cluster_prompts, merge_prompts, author_prompts, consolidate_prompt, answer_validation, run_costs, preference_occurrences, flat_preferences,
)}
