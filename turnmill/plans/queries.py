"""Registered queries of the transcript jobs over the given tables.

``conversations`` stands for session logs: user turns are human, system turns
are boundaries, assistant turns whose length is 0 or 1 modulo 5 are plans and
questions.  Timestamps come from ids, and every fifth conversation has a fork
that copies it and adds one turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import text as t
from turnmill.functions.running import settled
from turnmill.operators import context, corpus, grouping, names, preferences, tasks
from turnmill.plans import export, prompts
from turnmill.sources import artifacts, dialects
from turnmill.sources.lines import KEYS


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _stamp(number: Column) -> Column:
    return F.lpad(number.cast("string"), 12, "0")


def _turns(spark: SparkSession, d: str, forks: bool = True) -> DataFrame:
    """Events of all conversations and their forks."""
    c = F.col
    size = F.length("text") % 5
    kind = F.when(c("role") == "user", "human").when(c("role") == "system", "boundary").when(size == 0, "plan").when(size == 1, "question").otherwise("assistant")
    own = _table(spark, d, "conversations").select("conv_id", c("conv_id").alias("session"), c("turn").alias("event_pos"), kind.alias("kind"), _stamp(c("conv_id") * 1000 + c("turn")).alias("timestamp"), "text")
    if forks:
        copies = own.filter("conv_id % 5 = 0").withColumn("session", c("conv_id") + 1_000_000)
        more = copies.groupBy("conv_id", "session").agg((F.max("event_pos") + 1).alias("event_pos")).select(
            "conv_id", "session", "event_pos", F.lit("human").alias("kind"), _stamp(c("conv_id") * 1000 + 999).alias("timestamp"), F.concat(F.lit("one more thing "), c("conv_id").cast("string")).alias("text"))
        own = own.unionByName(copies).unionByName(more)
    session = c("session").cast("string")
    return own.select(F.lit("a").alias("origin"), F.concat(F.lit("p"), (c("conv_id") % 7).cast("string")).alias("project"), session.alias("session_id"), F.concat(F.lit("log/"), session).alias("source_path"), "event_pos", "kind", "timestamp", "text")


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = _turns(spark, d)
    said = dialects.messages(events)
    return events, said, corpus.first_owner_dedupe(said)


def short_turn_context(spark: SparkSession, d: str) -> DataFrame:
    events, _, kept = _corpus(spark, d)
    return context.short_turn_context(events, kept).select("session_id", "index", "timestamp", "human_text", "antecedent", "decision_kind", "decision_text")


def context_in_stretches(spark: SparkSession, d: str) -> DataFrame:
    """The context of sessions that are cut into stretches from the fourth event on."""
    events, _, kept = _corpus(spark, d)
    found = context.short_turn_context(events, kept, hot_rows=3)
    return found.select("session_id", "index", "timestamp", "human_text", "antecedent", "decision_kind", "decision_text")


def context_lines(spark: SparkSession, d: str) -> DataFrame:
    events, _, kept = _corpus(spark, d)
    return prompts.context_lines(context.short_turn_context(events, kept)).select("session_id", "index", "line")


def outcome_evidence(spark: SparkSession, d: str) -> DataFrame:
    events, _, kept = _corpus(spark, d)
    return context.outcome_evidence(events, kept).select("session_id", F.array_join("final_human_turns", "|").alias("turns"), "final_assistant_tail")


def fork_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d)[2].select("session_id", "index", "timestamp", "text")


def corpus_sessions(spark: SparkSession, d: str) -> DataFrame:
    _, said, kept = _corpus(spark, d)
    return corpus.substance(corpus.corpus_sessions(said, kept), 2).select("session_id", "messages", "first_ts", "last_ts", "dropped", "bad_lines", "bucket")


def export_documents(spark: SparkSession, d: str) -> DataFrame:
    return corpus.render_documents(_corpus(spark, d)[2]).select("session_id", "messages", "content")


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = corpus.render_chunks(_corpus(spark, d)[2], chunk_chars=900)
    return found.select("session_id", "messages", "chunk", "offset", "content")


def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    _, said, kept = _corpus(spark, d)
    sessions = corpus.corpus_sessions(said, kept).filter("messages > 0")
    named = names.allocate_document_names(sessions.select(*KEYS), ["session_id"])
    return corpus.manifest(sessions, named).select("export", "project", "session_id", "messages", "first_ts", "last_ts")


def project_inventory(spark: SparkSession, d: str) -> DataFrame:
    lines = _turns(spark, d).select("project", "session_id", F.col("text").alias("value"), F.col("timestamp").alias("mtime"))
    return corpus.project_inventory(lines)


def origin_rollup(spark: SparkSession, d: str) -> DataFrame:
    sessions = _turns(spark, d).select("session_id", F.when(F.col("project") < "p3", "a").otherwise("k2").alias("origin")).distinct()
    return corpus.origin_rollup(sessions)


def law_check(spark: SparkSession, d: str) -> DataFrame:
    parsed = dialects.parse_lines(_lines_a(spark, d), "a")
    events = dialects.timeline(parsed)
    return corpus.law_violations(dialects.messages(events), events).select("side", "session_id", "timestamp", "text")


def law_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Every 17th message is lost, so it and all that follow it in its session no longer pair up."""
    events = dialects.timeline(dialects.parse_lines(_lines_a(spark, d), "a"))
    said = dialects.messages(events).filter(F.length("text") % 17 > 0)
    return corpus.law_violations(said, events).select("side", "session_id", "n", "timestamp", "text")


def _json_keys(df: DataFrame, value: Column) -> DataFrame:
    return df.select(*KEYS, F.struct(F.lit(0).alias("block"), F.col("event_pos").alias("row")).alias("line_key"), value.alias("value"))


def _lines_a(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as dialect A lines: every 11th is a side chain, every 13th is cut short, every 7th has a key twice; blocks by length."""
    kind = F.when(F.col("kind") == "human", "user").when(F.col("kind") == "boundary", "system").otherwise("assistant")
    blocks = F.struct(kind.alias("type"), "timestamp", F.struct(F.array(F.struct(F.lit("text").alias("type"), "text"), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))).alias("content")).alias("message"))
    plain = F.struct(kind.alias("type"), "timestamp", (F.length("text") % 11 == 0).alias("isSidechain"), F.struct(F.col("text").alias("content")).alias("message"))
    line = F.when(F.length("text") % 3 == 0, F.to_json(blocks)).otherwise(F.to_json(plain))
    line = F.when(F.length("text") % 7 == 0, F.concat(F.lit('{"type":"odd",'), F.substring(line, 2, 2**30))).otherwise(line)
    return _json_keys(_turns(spark, d, forks=False), F.when(F.length("text") % 13 == 0, F.left(line, F.lit(20))).otherwise(line))


def _lines_k2(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == "human", "Prompt").when(F.col("kind") == "boundary", "Clear").otherwise("AssistantMessage")
    steer = F.when((F.col("kind") == "human") & (F.length("text") % 4 == 0), F.concat(F.lit("[LIVE STEERING - New message from user]\nx\n<user_message id=\"1\">\n"), "text", F.lit("\n</user_message>\nend"))).otherwise(F.col("text"))
    data = F.struct(F.array(F.struct(F.lit("text").alias("kind"), steer.alias("data"))).alias("content"), F.struct((F.lit(1_700_000_000) + F.col("event_pos")).alias("timestamp")).alias("meta"))
    return _json_keys(_turns(spark, d, forks=False), F.to_json(F.struct(F.lit("v1").alias("version"), kind.alias("kind"), data.alias("data"))))


def _lines_k3(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == "human", "user").when(F.col("kind") == "boundary", "session_start").otherwise("assistant")
    payload = F.struct(kind.alias("type"), "text", F.when(F.length("text") % 2 == 0, "Say").otherwise("Reasoning").alias("operationType"), F.col("text").alias("content"))
    return _json_keys(_turns(spark, d, forks=False), F.to_json(F.struct("timestamp", payload.alias("payload"))))


def _extracted(lines: DataFrame, dialect: str) -> DataFrame:
    return dialects.timeline(dialects.parse_lines(lines, dialect)).select("session_id", "event_pos", "kind", "timestamp", "text")


def extract_dialect_a(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(_lines_a(spark, d), "a")


def extract_dialect_k2(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(_lines_k2(spark, d), "k2")


def extract_dialect_k3(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(_lines_k3(spark, d), "k3")


def bad_lines(spark: SparkSession, d: str) -> DataFrame:
    return dialects.bad_lines(dialects.parse_lines(_lines_a(spark, d), "a")).select("session_id", "bad_lines")


def drops_a(spark: SparkSession, d: str) -> DataFrame:
    parsed = dialects.parse_lines(_lines_a(spark, d), "a")
    return dialects.drops(parsed, "a").select("session_id", "reason", "snippet", "timestamp")


def classify_sessions(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines_k2(spark, d)
    meta = lines.select("session_id").distinct().select("session_id", (F.col("session_id").cast("long") % 3 == 0).alias("has_history"), F.when(F.col("session_id").cast("long") % 2 == 0, "x").alias("parent_id"))
    return dialects.classify_sessions(dialects.parse_lines(lines, "k2"), meta, "k2", "[own run]").select("session_id", "include", "reason")


def middle_cut(spark: SparkSession, d: str) -> DataFrame:
    cut = t.middle_cut(F.col("text"), 1000)
    return _table(spark, d, "documents").select("doc_id", cut["text"].alias("cut"), cut["dropped"].alias("dropped"))


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    return _table(spark, d, "documents").select("doc_id", t.word_count(x).alias("words"), t.is_short_turn(x).alias("short"), t.snippet(x).alias("snippet"), t.capped(x, 60).alias("capped"), t.normalize_key(t.tail(x, 200)).alias("key"), t.content_hash(x).alias("hash"))


def oversized_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").filter((F.octet_length("text") > 8000) & (F.length("text") > 8000)).select("doc_id", F.length("text").cast("long").alias("chars"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Documents as exports; their source is the task."""
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return _table(spark, d, "documents").select(F.col("source").alias("slug"), name.alias("export"), F.col("doc_id").alias("pos"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("export"), F.col("text").alias("content"))


def _digests(spark: SparkSession, d: str) -> DataFrame:
    """Labels as digests: quality and toxicity give the outcome."""
    outcome = F.when(F.col("toxic") == 1, "abandoned").when(F.col("quality") == 1, "completed").when(F.col("doc_id") % 2 == 0, "partial").otherwise("unclear")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return _table(spark, d, "labels").select(name.alias("export"), F.concat(F.lit("goal "), (F.col("doc_id") % 10).cast("string")).alias("goal"), F.concat(F.lit(" Area"), (F.col("doc_id") % 3).cast("string")).alias("domain"), outcome.alias("outcome"), F.col("doc_id"))


def task_budget(spark: SparkSession, d: str) -> DataFrame:
    found = tasks.task_budget(_members(spark, d), _documents(spark, d), 100_000, "extreme")
    return found.withColumn("coverage", F.round("coverage", 6))


def outcome_summary(spark: SparkSession, d: str) -> DataFrame:
    return tasks.outcome_summary(_members(spark, d), _digests(spark, d))


def viable_tasks(spark: SparkSession, d: str) -> DataFrame:
    return tasks.viable_tasks(_members(spark, d), _digests(spark, d))


def distinct_domains(spark: SparkSession, d: str) -> DataFrame:
    return tasks.distinct_domains(_members(spark, d), _digests(spark, d)).select("slug", F.array_join("domains", ",").alias("domains"))


def _library(spark: SparkSession, d: str) -> DataFrame:
    """A stored record for each task: every third of an old generation, some edited."""
    n = F.regexp_replace("slug", "[^0-9]", "").cast("int")
    own = _members(spark, d).groupBy("slug").agg(F.array_sort(F.collect_list("export")).alias("members"), F.count(F.lit(1)).alias("size"))
    return own.select("slug", F.when(n % 3 == 0, "g0").otherwise("g1").alias("generation"), F.when(n % 4 == 0, F.slice("members", 1, 1)).otherwise(F.col("members")).alias("members"), (n % 2 == 0).alias("is_edited"), "size")


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    own = _members(spark, d).groupBy("slug").agg(F.array_sort(F.collect_list("export")).alias("members"))
    return own.filter("slug <> 'src1'").select("slug", F.upper("slug").alias("title"), "members")


def author_work(spark: SparkSession, d: str) -> DataFrame:
    members = _members(spark, d).filter("slug <> 'src1'")
    found = tasks.author_work(_tasks(spark, d), members, _digests(spark, d), _documents(spark, d), _library(spark, d), "g1", 150_000, "never")
    return found.select("slug", "status", "chars")


def provenance(spark: SparkSession, d: str) -> DataFrame:
    members, digests = _members(spark, d), _digests(spark, d)
    work = _tasks(spark, d).select("slug", F.lit("ready").alias("status"), F.lit(1.0).alias("coverage"), F.lit(0).alias("dropped"))
    sessions = members.filter("pos % 4 <> 0").select("export", F.concat(F.lit("s"), F.col("pos").cast("string")).alias("session_id"))
    answers = _tasks(spark, d).select("slug", F.concat(F.lit("# "), "slug").alias("content"), F.array(F.lit("p")).alias("preferences"), F.lit(None).cast("string").alias("confidence"))
    found = tasks.provenance(work, _tasks(spark, d), members, digests, sessions, answers)
    return found.select("slug", "title", F.size("members").alias("members"), F.array_join("session_ids", ",").alias("session_ids"), "outcome_summary", F.array_join("domains", ",").alias("domains"), "confidence", "content_hash")


def orphans(spark: SparkSession, d: str) -> DataFrame:
    return tasks.orphans(_library(spark, d), _tasks(spark, d), "g1")


def funnel(spark: SparkSession, d: str) -> DataFrame:
    manifest = _members(spark, d).select("export")
    misc = _members(spark, d).filter("slug = 'src1'").select("export")
    return tasks.funnel(manifest, _digests(spark, d), _tasks(spark, d), misc, _library(spark, d), "g1", sessions=_members(spark, d).select("export").unionByName(_digests(spark, d).select("export")))


def resume_work(spark: SparkSession, d: str) -> DataFrame:
    return tasks.resume_work(_members(spark, d).select("export"), _digests(spark, d))


def stale_keys(spark: SparkSession, d: str) -> DataFrame:
    return tasks.stale_keys(_digests(spark, d), _members(spark, d).filter("pos % 3 <> 0").select("export"))


def apply_ratings(spark: SparkSession, d: str) -> DataFrame:
    ratings = _table(spark, d, "documents").select(F.col("source").alias("slug"), (F.col("n_chars") % 5).cast("int").alias("rating"), _stamp(F.col("doc_id")).alias("rated_at"))
    return tasks.apply_ratings(_library(spark, d).select("slug", "generation"), ratings.filter("slug <> 'src2'"))


def _preferences(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each document as a preference of its source."""
    line = F.substring_index(F.col("text"), "\n", 1)
    number = F.regexp_replace("source", "[^0-9]", "").cast("long")
    return _table(spark, d, "documents").select(F.col("source").alias("slug"), _stamp(number).alias("authored_at"), number.alias("task_pos"), F.col("doc_id").alias("pos"), line.alias("text"), F.col("doc_id").cast("string").alias("evidence"))


def preferences_ranked(spark: SparkSession, d: str) -> DataFrame:
    ranked = preferences.aggregate_preferences(_preferences(spark, d))
    return ranked.select("key", "text", "count", "last_authored_at", F.array_join(F.transform("occurrences", lambda o: F.concat_ws("=", o.slug, o.evidence)), ",").alias("occurrences"))


def preferences_ranked_whole(spark: SparkSession, d: str) -> DataFrame:
    return preferences_ranked(spark, d)


def preference_block(spark: SparkSession, d: str) -> DataFrame:
    ranked = preferences.aggregate_preferences(_preferences(spark, d))
    return preferences.render_block(ranked, 20, "<!-- preferences -->")


def preference_block_whole(spark: SparkSession, d: str) -> DataFrame:
    return preference_block(spark, d)


def recurring_preferences(spark: SparkSession, d: str) -> DataFrame:
    return preferences.recurring_count(preferences.aggregate_preferences(_preferences(spark, d)))


def recurring_preferences_whole(spark: SparkSession, d: str) -> DataFrame:
    return recurring_preferences(spark, d)


def normalized_duplicates(spark: SparkSession, d: str) -> DataFrame:
    keyed = _table(spark, d, "documents").select(t.content_hash(t.normalize_key(F.col("text"))).alias("key"), "doc_id")
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


def cluster_validation(spark: SparkSession, d: str) -> DataFrame:
    own = _members(spark, d)
    slug = F.when(F.col("pos") % 50 == 0, F.lit("Bad Slug")).otherwise(F.concat(F.lit("task-"), (F.col("pos") % 20).cast("string")))
    found = own.filter("pos % 7 <> 0").select(slug.alias("slug"), F.when(F.col("pos") % 9 == 0, F.concat("export", F.lit("x"))).otherwise(F.col("export")).alias("m"))
    made = found.groupBy("slug").agg(F.collect_list("m").alias("members"))
    made = made.union(made.filter("slug = 'task-3'").select("slug", F.array().cast("array<string>")))
    misc = own.filter("pos % 14 = 0").select(F.col("export").alias("member")).union(own.filter("pos = 5").select(F.lit("nowhere").alias("member")))
    return grouping.validate_grouping(made, misc, own.select(F.col("export").alias("id")))


def id_canonicalise(spark: SparkSession, d: str) -> DataFrame:
    own = _members(spark, d)
    members = own.select("slug", "pos", F.when(F.col("pos") % 2 == 0, F.regexp_replace("export", r"\.md$", "")).when(F.col("pos") % 5 == 0, F.concat("export", F.lit(".md"))).otherwise(F.col("export")).alias("member"))
    inputs = own.filter("pos % 3 <> 1").select(F.col("export").alias("id"))
    return grouping.canonical_ids(members, inputs)


def window_packing(spark: SparkSession, d: str) -> DataFrame:
    costs = _table(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("id"), F.col("n_chars").alias("cost"))
    return grouping.pack_windows(costs, "source", 20_000, 500).withColumnRenamed("window", "bin")


def windows_of_large_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each language's documents as one group, the larger ones packed by pointer doubling."""
    costs = _table(spark, d, "documents").select("lang", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("id"), F.col("n_chars").alias("cost"))
    return grouping.pack_windows(costs, "lang", 20_000, 500, hot_rows=100).withColumnRenamed("window", "bin")


def apply_merges(spark: SparkSession, d: str) -> DataFrame:
    """All merges want one slug, and a kept task has the first numbered one."""
    made = _tasks(spark, d).withColumn("slug", F.concat(F.lit("task-"), "slug"))
    n = F.regexp_replace("slug", "[^0-9]", "").cast("int")
    pairs = made.select(n.alias("n"), "slug").filter("n % 2 = 0")
    merges = pairs.select(F.col("n").alias("pos"), F.array(F.col("slug"), F.concat(F.lit("task-src"), (F.col("n") + 3).cast("string"))).alias("slugs"), F.lit("task-both").alias("slug"), F.lit("both").alias("title"), F.concat(F.lit("why "), F.col("n").cast("string")).alias("rationale"))
    made = made.withColumn("slug", F.when(F.col("slug") == "task-src18", "task-both-2").otherwise(F.col("slug"))).withColumn("rationale", F.lit("own"))
    return grouping.apply_merges(made, merges).select("slug", "title", F.size("members").alias("members"), "rationale", "kind", "note")


def single_session_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Names of equal words, and some whose words are what a number would make of the others."""
    n = F.col("doc_id")
    words = F.when(n % 20 == 3, F.concat(F.lit("A b c d "), (n % 9).cast("string"), F.lit(" x"))).when(n % 20 == 7, "A b").when(n % 20 == 8, "A b 2").otherwise("A b--c d e f ")
    name = F.concat(words, F.when(n % 20 == 7, "").when(n % 20 == 8, "").otherwise((n % 40).cast("string")), F.lit("("), F.when((n % 20 == 7) | (n % 20 == 8), "").otherwise(n.cast("string")), F.repeat(F.lit("("), (n / 20).cast("int")), F.lit(".md"))
    spread = _digests(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # labels are few bytes, their names are long
    return names.single_session_tasks(spread.withColumn("export", name)).select("slug", "title", F.array_join("members", ",").alias("members"))


def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    log = _table(spark, d, "events").select("user_id", "event_id", F.when(kind.isin("error", "view", "click"), F.lit("failed")).alias("message"), F.when(kind == "signup", "skipped").alias("kind"))
    return tasks.failure_streaks(log, "user_id", ["event_id"], trip=3)


def edited_flag(spark: SparkSession, d: str) -> DataFrame:
    recorded = F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 1, F.sha2(F.concat("text", F.lit(" ")), 256))
    return _table(spark, d, "documents").select("doc_id", t.edited(F.col("text"), recorded).alias("edited"))


def project_names(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("-"), F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[^A-Za-z0-9]+", "-"))
    base = t.base_name(t.decode_project_dir(path), "unknown")
    rows = _table(spark, d, "pages").select("page_id", path.alias("dir"), t.decode_project_dir(path).alias("path"), base.alias("base"))
    return corpus.disambiguate(rows, "base", ["dir", "page_id"], "name")


def core_ids(spark: SparkSession, d: str) -> DataFrame:
    uuid = F.regexp_replace(F.md5(F.col("url")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("sess_"), uuid)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("cli_"), uuid, F.lit("_x"))).otherwise(F.concat(F.lit("other_"), uuid))
    return _table(spark, d, "pages").select("page_id", t.core_uuid(name).alias("core"), t.sanitize_name(F.col("url")).alias("safe"))


def fence_strip(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Here:\n```JSON\n"), "text", F.lit("\n```\nbye"))).otherwise(F.concat(F.lit("  "), "text"))
    return _table(spark, d, "documents").select("doc_id", t.strip_fence(wrapped).alias("body"))


def fence_strip_whole(spark: SparkSession, d: str) -> DataFrame:
    return fence_strip(spark, d)


def response_parse(spark: SparkSession, d: str) -> DataFrame:
    """Digests wrapped as response envelopes of each shape, parsed and validated."""
    from turnmill.functions import variant as v

    made = _digests(spark, d)
    digest = F.to_json(F.struct("goal", F.lit("x").alias("deliverable"), "domain", F.array(F.lit("k")).alias("keywords"), F.when(F.col("doc_id") % 7 == 0, "nope").otherwise(F.col("outcome")).alias("outcome")))
    fenced = F.concat(F.lit("```json\n"), digest, F.lit("\n```"))
    event = F.struct(F.lit("result").alias("type"), fenced.alias("result"), (F.col("doc_id") % 5 == 0).alias("is_error"))
    shape = F.when(F.col("doc_id") % 3 == 0, F.to_json(event)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('[{"type":"start"},'), F.to_json(event), F.lit("]"))).otherwise(F.concat(digest, F.lit("\nCredits: 0.25")))
    parsed = tasks.parse_responses(made.select("doc_id", shape.alias("response")))
    return parsed.select("doc_id", "is_error", v.text(F.col("payload"), "$.outcome").alias("outcome"), tasks.digest_problem(F.col("payload")).alias("problem"), "cost")


def plan_counts(spark: SparkSession, d: str) -> DataFrame:
    sessions = export_manifest(spark, d).withColumn("origin", F.when(F.col("session_id").cast("long") % 3 == 0, None).otherwise("k2"))
    eligible = prompts.eligible_exports(sessions, ["a", "k2"], project="P", min_messages=2)
    return prompts.plan_counts(eligible, grouped=True)


def digest_prompts(spark: SparkSession, d: str) -> DataFrame:
    events, _, kept = _corpus(spark, d)
    documents = corpus.render_documents(kept).select(F.col("session_id").alias("export"), "content")
    outcomes = context.outcome_evidence(events, kept).withColumnRenamed("session_id", "export").select("export", "final_human_turns", "final_assistant_tail")
    return prompts.digest_prompts(documents, outcomes, template="{document}|{turns}|{reply}").select("export", F.sha2("prompt", 256).alias("prompt_hash"), "dropped")


def prompts_with_place_holders(spark: SparkSession, d: str) -> DataFrame:
    """Documents, turns and replies that hold place-holders of the template themselves."""
    rows = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("export"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    documents = rows.select("export", F.concat("text", F.lit(" {reply} {turns}")).alias("content"))
    outcomes = rows.select("export", F.array(F.concat("lang", F.lit(" {document}")), F.lit("{reply}")).alias("final_human_turns"), F.concat(F.lit("{turns} "), "source").alias("final_assistant_tail"))
    found = prompts.digest_prompts(documents, outcomes, template="{document}|{turns}|{reply}|{other}")
    return found.select("export", F.sha2("prompt", 256).alias("prompt_hash"), "dropped")


def digest_prompts_whole(spark: SparkSession, d: str) -> DataFrame:
    return digest_prompts(spark, d)


def export_statistics(spark: SparkSession, d: str) -> DataFrame:
    """All counters of a run over two stores that leaves out a project, machines' sessions and unreadable ones."""
    n = F.col("session_id").cast("long")
    events = _turns(spark, d).withColumn("origin", F.when(F.col("project") < "p3", "a").otherwise("k2")).withColumn("project", F.regexp_replace("project", "^p6$", "other"))
    keep = lambda df, name: settled(df)  # noqa: E731  what several counters read is written once, and nothing stays in memory
    events = keep(events, "timeline")
    found = events.select(*KEYS).distinct().select(*KEYS, F.lit(1).alias("bytes"), (n % 3 == 0).alias("has_history"), F.when(n % 4 == 1, "x").alias("parent_id"))
    prompts_of = found.select("source_path", F.when(n % 10 == 2, "[AGENT SYSTEM PROMPT] do").alias("prompt"))
    lost = found.filter(n % 11 == 5)
    judged = export.judge_sessions(found, prompts_of, lost, project="P")
    judged = keep(judged, "judged")
    read = judged.filter("status = 'read'").select(*KEYS)
    bad = read.withColumn("bad_lines", (n % 2).cast("long"))
    tables = export.export_tables(events.join(read, KEYS, "left_semi"), bad, 2, read, keep)
    existing = tables["manifest"].select("export").unionByName(found.select(F.concat(F.lit("old-"), "session_id").alias("export")))
    return export.statistics(tables, judged, export.stale_outputs(existing, tables["manifest"]))


def task_marks(spark: SparkSession, d: str) -> DataFrame:
    return tasks.task_marks(_tasks(spark, d), _members(spark, d), _digests(spark, d), _library(spark, d), "g1")


def cross_window_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Windows name tasks alike, and some tasks as a numbered one of another would be."""
    n = F.col("doc_id")
    slug = F.when(n % 9 == 4, F.concat(F.lit("task-x-"), (n % 5 + 2).cast("string"))).when(n % 9 == 5, F.concat(F.lit("a-b-c-d-"), (n % 4).cast("string"))).when(n % 9 == 6, "a-b-c-d").otherwise(F.concat(F.lit("task-"), F.when(n % 9 == 0, "x").otherwise((n % 60).cast("string"))))
    made = _table(spark, d, "documents").select(slug.alias("slug"), (n % 7).alias("win"), n.alias("pos"))
    return grouping.unique_slugs(made, ["win", "pos"])


def _records(spark: SparkSession, d: str) -> DataFrame:
    """A library record as JSON for each document: some cut short, some without a slug or with odd fields."""
    n = F.col("doc_id")
    whole = F.to_json(F.struct(F.concat(F.lit("s"), n.cast("string")).alias("slug"), F.array("source").alias("members"), F.when(n % 3 == 0, "high").otherwise("odd").alias("confidence"), _stamp(n).alias("authored_at")))
    body = F.when(n % 5 == 0, F.left(whole, F.lit(10))).when(n % 5 == 1, F.lit('{"title":"x"}')).otherwise(whole)
    return _table(spark, d, "documents").select(F.concat(F.lit("s"), n.cast("string")).alias("slug_dir"), body.alias("value"))


def library_read(spark: SparkSession, d: str) -> DataFrame:
    return artifacts.parse_library(_records(spark, d)).select("slug", "title", F.array_join("members", ",").alias("members"), "confidence", "authored_at", "coverage")


def library_issues(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    return artifacts.library_issues(records.select(F.col("slug_dir").alias("slug")), records.filter("slug_dir not like '%7'"))


QUERIES = {f.__name__: f for f in (
    short_turn_context, context_lines, outcome_evidence, fork_dedupe, corpus_sessions, export_documents, export_manifest, project_inventory, origin_rollup, law_check, law_breaks,
    extract_dialect_a, extract_dialect_k2, extract_dialect_k3, bad_lines, drops_a, classify_sessions, middle_cut, text_functions, oversized_sessions, task_budget,
    outcome_summary, viable_tasks, distinct_domains, author_work, provenance, orphans, funnel, resume_work, stale_keys, apply_ratings, preferences_ranked, preference_block,
    recurring_preferences, normalized_duplicates, cluster_validation, id_canonicalise, window_packing, apply_merges, single_session_tasks, failure_streaks, edited_flag,
    project_names, core_ids, fence_strip, response_parse, plan_counts, digest_prompts, export_statistics, task_marks, cross_window_slugs, library_read, library_issues,
    prompts_with_place_holders, context_in_stretches, document_chunks, windows_of_large_groups, fence_strip_whole, preferences_ranked_whole, preference_block_whole, recurring_preferences_whole, digest_prompts_whole,
)}
