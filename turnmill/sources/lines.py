"""Reading session logs as lines in file order."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import text as t
from turnmill.functions import variant as v

KEYS = ["origin", "project", "session_id", "source_path"]
LAYOUTS = {
    "a": "{home}/projects/*/*.jsonl",  # one folder level, so files of sub-threads stay out
    "k2": "{home}/sessions/cli/*.jsonl",
    "k3": "{home}/sessions/*/*/messages.jsonl",
}


def read_session_lines(spark: SparkSession, home: str, origin: str) -> DataFrame:
    """Lines of every session file of a store: keys, ``line_key`` (orders a file's lines), ``value``, and the ``bytes`` it took.

    Large files are split among tasks; (block start, id within the task's run)
    keeps their order.  What can't be read of a file is skipped; ``sessions.unreadable``
    and ``sessions.partly_read`` tell which files that befell.
    """
    if origin not in LAYOUTS:
        raise ValueError(f"unknown origin {origin!r}; known: {', '.join(LAYOUTS)}")
    raw = (
        spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", "true").text(LAYOUTS[origin].format(home=home))
        .select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_modification_time").alias("mtime"),
                F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_key"))
    )
    parts = F.split("source_path", "/")
    folder, file = F.element_at(parts, -2), F.element_at(parts, -1)
    if origin == "a":
        project, session = t.base_name(t.decode_project_dir(folder), folder), F.regexp_replace(file, r"\.jsonl$", "")
    elif origin == "k2":
        project, session = F.lit("unknown"), F.regexp_replace(file, r"\.jsonl$", "")
    else:
        raw = raw.filter(F.element_at(F.split("source_path", "/"), -3) != "cli")
        project, session = F.lit("unknown"), folder
    return raw.select(
        F.lit(origin).alias("origin"), project.alias("project"), session.alias("session_id"), "source_path", "mtime", "line_key",
        F.regexp_replace("value", "\r$", "").alias("value"), (F.octet_length("value") + 1).cast("long").alias("bytes"),
    )


def file_exists(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def active_origins(spark: SparkSession, homes: dict[str, str], source: str = "auto") -> list[str]:
    """The chosen store, or with ``auto`` every store that has files, in a fixed order."""
    if source != "auto" and source not in LAYOUTS:
        raise ValueError(f"unknown source {source!r}; known: auto, {', '.join(LAYOUTS)}")
    wanted = LAYOUTS if source == "auto" else [source]
    return [origin for origin in wanted if origin in homes and file_exists(spark, LAYOUTS[origin].format(home=homes[origin]))]


def read_sources(spark: SparkSession, homes: dict[str, str], source: str = "auto") -> DataFrame:
    """Lines of the chosen store, or with ``auto`` of every store that has files, in one frame."""
    found = active_origins(spark, homes, source)
    if not found:
        raise ValueError("no session files found")
    return functools.reduce(DataFrame.unionByName, (read_session_lines(spark, homes[origin], origin) for origin in found))


def detect_format(lines: DataFrame) -> DataFrame:
    """Per session, ``k3`` if its first parseable object line has a payload object, else ``k2``."""
    v.allow_repeated_keys(lines.sparkSession)
    parsed = lines.select(*KEYS, "line_key", v.parse(v.shorten(F.col("value"))["text"]).alias("v")).filter(v.is_object(F.col("v")))
    first = parsed.groupBy(*KEYS).agg(F.min_by(v.is_object(v.at(F.col("v"), "$.payload")), "line_key").alias("p"))
    return lines.select(*KEYS).distinct().join(first, KEYS, "left").select(*KEYS, F.when(F.col("p"), "k3").otherwise("k2").alias("format"))


def parse_session_meta(files: DataFrame) -> DataFrame:
    """(meta_path, cwd, title, parent_id, created_reason) of (meta_path, value) rows; what is missing or malformed is null.

    Both stores' spellings are read.  The tree store's folder is the first of the
    first list among its workspace and root paths.
    """
    v.allow_repeated_keys(files.sparkSession)
    e = F.col("v")
    first = v.string(F.get(F.coalesce(v.array(e, "$.workspacePaths"), v.array(e, "$.rootPaths")), 0))
    either = lambda *names: F.coalesce(*(v.text(e, f"$.{name}") for name in names))
    return files.select("meta_path", v.parse(F.col("value")).alias("v")).select(
        "meta_path", F.coalesce(v.text(e, "$.cwd"), first).alias("cwd"), v.text(e, "$.title").alias("title"),
        either("parent_session_id", "parentSessionId").alias("parent_id"), either("session_created_reason", "createdReason").alias("created_reason"))


def read_session_meta(spark: SparkSession, pattern: str) -> DataFrame:
    """``parse_session_meta`` of every metadata file."""
    raw = spark.read.option("wholetext", "true").option("ignoreCorruptFiles", "true").text(pattern)
    return parse_session_meta(raw.select(F.col("_metadata.file_path").alias("meta_path"), "value"))


def prefer_newer_store(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions of the flat store whose id isn't in the newer one as well."""
    known = new.select(t.core_uuid(F.col("session_id")).alias("_id")).distinct()
    return old.join(known, t.core_uuid(F.col("session_id")) == F.col("_id"), "left_anti")


def orphan_histories(stems: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """History stems with no transcript in either store."""
    known = old.select(F.col("session_id").alias("_id")).union(new.select("session_id")).union(new.select(t.core_uuid(F.col("session_id")))).distinct()
    return stems.join(known, F.col("stem") == F.col("_id"), "left_anti")
