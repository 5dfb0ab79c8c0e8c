"""From session files to documents and side tables, end to end."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions.fingerprint import fingerprint
from turnmill.operators import context, corpus, names
from turnmill.sources import dialects
from turnmill.sources import sessions as stores
from turnmill.sources.lines import KEYS, LAYOUTS, active_origins, file_exists, read_session_lines

OUTCOME_NOTE = "Machine-written text: evidence of how a session ended, never a part of documents."
COUNTERS = ["exported", "messages", "duplicates", "filtered", "zero_message", "automation", "below_minimum", "read_errors", "bad_lines", "short_turns", "with_decision", "outcome_sessions", "stale_outputs"]
_PARSED = [*KEYS, "bytes", "line_key", "is_bad", "events", "drops", "prompt", "snapshot"]


def parse_all(spark: SparkSession, homes: dict[str, str], source: str = "auto") -> DataFrame:
    """Parsed lines of all active stores in one frame, without their JSON values."""
    parts = (dialects.parse_lines(read_session_lines(spark, homes[o], o), o).select(*_PARSED) for o in active_origins(spark, homes, source))
    return functools.reduce(DataFrame.unionByName, parts)


def judge_sessions(sessions: DataFrame, prompts: DataFrame, unreadable: DataFrame, project: str | None = None, own_mark: str | None = None) -> DataFrame:
    """Adds ``status`` to discovered sessions: filtered, automation, unreadable or read, the first that holds."""
    first = prompts.groupBy("source_path").agg(F.max("prompt").alias("prompt"))
    lost = unreadable.select("source_path", F.lit(True).alias("_lost"))
    known = sessions.join(first, "source_path", "left").join(lost, "source_path", "left")
    reason = dialects.session_reason(F.col("prompt"), F.col("has_history"), F.col("parent_id"), F.col("origin"), own_mark)
    status = F.when(~corpus.project_filter(sessions, project), "filtered").when(~reason.isin("history", "default"), "automation").when(F.col("_lost"), "unreadable").otherwise("read")
    return known.select(*sessions.columns, status.alias("status"))


def export_tables(
    events: DataFrame, bad: DataFrame, min_messages: int = 1, sessions: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, hot_rows: int | None = None, chunk_chars: int | None = None,
) -> dict[str, DataFrame]:
    """sessions, documents, manifest, context and outcomes of the exported sessions.

    ``sessions`` (keys) are those that were read, with or without a message; by
    default those with an event.  ``keep`` writes or persists what several tables
    are made of (messages, sessions, names), so that it is computed once.
    ``hot_rows`` (see ``short_turn_context``) is for events that are a table;
    with ``chunk_chars`` documents are rows of chunks (see ``render_chunks``).
    """
    said = dialects.messages(events)
    kept = keep(corpus.first_owner_dedupe(said), "messages")
    sessions = keep(corpus.substance(corpus.corpus_sessions(said, kept, bad, sessions), min_messages), "sessions")
    named = keep(names.allocate_document_names(sessions.filter("bucket = 'eligible'").select(*KEYS), ["session_id", "origin", "source_path"]), "names")
    keyed = lambda df: df.join(named, KEYS)
    if chunk_chars is None:
        documents = keyed(corpus.render_documents(kept)).select("export", "project", "content")
    else:
        documents = keyed(corpus.render_chunks(kept, chunk_chars, hot_rows)).select("export", "project", "chunk", "offset", "content")
    tail = F.col("final_assistant_tail").alias("final_assistant_tail", metadata={"comment": OUTCOME_NOTE})
    return {
        "sessions": sessions, "documents": documents, "manifest": corpus.manifest(sessions, named),
        "context": keyed(context.short_turn_context(events, kept, hot_rows=hot_rows)).select("export", "index", "timestamp", "human_text", "antecedent", "decision_kind", "decision_text"),
        "outcomes": keyed(context.outcome_evidence(events, kept)).select("export", "final_human_turns", tail),
    }


def statistics(tables: dict[str, DataFrame], judged: DataFrame | None = None, stale: DataFrame | None = None) -> DataFrame:
    """(counter, n): what a run exported and left out, and ``exported:<origin>`` of each store.

    ``judged`` are the discovered sessions with their status, ``stale`` the outputs no longer written.
    """
    n = F.count(F.lit(1))
    found = [tables["sessions"].agg(
        F.count_if(F.col("bucket") == "eligible").alias("exported"), F.sum(F.when(F.col("bucket") == "eligible", F.col("messages"))).alias("messages"), F.sum("dropped").alias("duplicates"),
        F.count_if(F.col("bucket") == "zero").alias("zero_message"), F.count_if(F.col("bucket") == "below").alias("below_minimum"), F.sum("bad_lines").alias("bad_lines")),
        tables["context"].agg(n.alias("short_turns"), F.count_if(F.col("decision_kind").isNotNull()).alias("with_decision")),
        tables["outcomes"].agg(F.count_if(F.col("final_assistant_tail") != "").alias("outcome_sessions")),
    ]
    if judged is not None:
        pairs = [("filtered", "filtered"), ("automation", "automation"), ("unreadable", "read_errors")]
        found.append(judged.agg(*(F.count_if(F.col("status") == status).alias(name) for status, name in pairs)))
    if stale is not None:
        found.append(stale.agg(n.alias("stale_outputs")))
    rows = [df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*(F.coalesce(F.col(x), F.lit(0)).cast("long") for x in df.columns)))).alias("counter", "n")) for df in found]
    counted = {name for df in found for name in df.columns}
    spark = tables["sessions"].sparkSession
    rows.append(spark.createDataFrame([(c, 0) for c in COUNTERS if c not in counted], "counter string, n long"))
    rows.append(tables["manifest"].groupBy(F.concat(F.lit("exported:"), "origin").alias("counter")).agg(n.alias("n")))
    return functools.reduce(DataFrame.union, rows)


def stale_outputs(existing: DataFrame, manifest: DataFrame, project: str | None = None, min_messages: int = 1, source: str = "auto") -> DataFrame:
    """Names among ``existing`` that this run no longer writes; deleting is the caller's act.

    Only a run over all projects and stores with the least minimum tells: under
    any other, what it doesn't write may still be valid, so nothing is stale.
    """
    gone = existing.select("export").distinct().join(manifest.select("export"), "export", "left_anti")
    return gone if project is None and min_messages == 1 and source == "auto" else gone.limit(0)


TABLES = ["sessions", "documents", "manifest", "context", "outcomes", "statistics", "discovered", "partly_read"]


def inputs_fingerprint(spark: SparkSession, homes: dict[str, str], source: str, settings: list) -> tuple:
    """(n, sum, xor, settings) of the names, sizes and times of all files that an export reads."""
    kinds = (LAYOUTS, stores.META, dict.fromkeys(stores.META, stores.HISTORY))
    patterns = [p[o].format(home=homes[o]) for o in active_origins(spark, homes, source) for p in kinds if o in p]
    files = functools.reduce(DataFrame.union, (stores.list_files(spark, p) for p in patterns))
    found = files.agg(fingerprint("source_path", "bytes", "mtime").alias("f")).first()["f"]
    return (*found, json.dumps(settings))


def _known(spark: SparkSession, path: str) -> tuple | None:
    rows = spark.read.parquet(path).collect() if file_exists(spark, f"{path}/_SUCCESS") else []
    return tuple(rows[0]) if rows else None


def _remember(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, "n long, sum string, xor long, settings string").coalesce(1).write.mode("overwrite").parquet(path)


def run_export(
    spark: SparkSession, homes: dict[str, str], out: str, source: str = "auto", project: str | None = None, min_messages: int = 1,
    own_mark: str | None = None, existing: DataFrame | None = None, chunk_chars: int | None = None,
) -> dict[str, DataFrame]:
    """Discover, classify, extract, dedupe and write all tables under ``out``; returns the written tables.

    Lines are parsed once: all later tables come from the written ones.  Sessions
    of machines, of other projects and of the older store of two stay out.
    ``existing`` (export) are the outputs of earlier runs.  ``statistics`` counts all of it;
    ``partly_read`` has the files that break off, with the bytes that are lost.

    The fingerprint of all files read and of the settings is kept beside the
    tables.  A run without ``existing`` that finds it unchanged reads the tables
    back and joins nothing.
    """
    now = inputs_fingerprint(spark, homes, source, [source, project, min_messages, own_mark, chunk_chars, existing is None])
    if existing is None and _known(spark, f"{out}/fingerprint") == now:
        return {name: spark.read.parquet(f"{out}/{name}") for name in TABLES}
    _remember(spark, f"{out}/fingerprint", [])  # none counts while tables are being replaced

    def write(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    parsed = write(parse_all(spark, homes, source), "parsed")
    sessions = stores.discover(spark, homes, source)
    judged = judge_sessions(sessions, dialects.first_prompts(parsed), stores.unreadable(sessions, parsed), project, own_mark)
    judged = write(judged, "discovered")
    partly = write(stores.partly_read(sessions, parsed), "partly_read")
    read = judged.filter("status = 'read'").select(*KEYS)
    placed = parsed.drop("project", "session_id").join(read, ["origin", "source_path"])
    events = write(dialects.timeline(placed), "timeline")
    bad = write(dialects.bad_lines(placed), "bad_lines")
    write(dialects.drops(placed, "a").unionByName(dialects.snapshot_only(placed)), "drops")
    tables = export_tables(events, bad, min_messages, read, write, context.HOT_EVENTS, chunk_chars)
    done = {name: df if name == "sessions" else write(df, name, "project" if name == "documents" else None) for name, df in tables.items()}
    stale = None if existing is None else write(stale_outputs(existing, done["manifest"], project, min_messages, source), "stale_outputs")
    done["statistics"] = write(statistics(done, judged, stale), "statistics")
    _remember(spark, f"{out}/fingerprint", [now])
    return done | {"discovered": judged, "partly_read": partly} | ({} if stale is None else {"stale_outputs": stale})
