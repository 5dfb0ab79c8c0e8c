"""Which sessions the stores hold, and what is known of each besides its lines."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.functions import text as t
from turnmill.operators.corpus import disambiguate
from turnmill.sources.lines import LAYOUTS, active_origins, file_exists, prefer_newer_store, read_session_meta

META = {"k2": "{home}/sessions/cli/*.json", "k3": "{home}/sessions/*/*/session.json"}
HISTORY = "{home}/sessions/cli/*.history"


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(source_path, bytes, mtime) of the files, whose contents aren't read; Spark lists no file without a byte."""
    if not file_exists(spark, pattern):
        return spark.createDataFrame([], "source_path string, bytes long, mtime timestamp")
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("mtime"))


def _part(path: Column, n: int) -> Column:
    return F.element_at(F.split(path, "/"), n)


def history_stems(spark: SparkSession, home: str) -> DataFrame:
    """(stem) of the history files of a flat store."""
    return list_files(spark, HISTORY.format(home=home)).select(F.regexp_replace(_part(F.col("source_path"), -1), r"\.history$", "").alias("stem"))


def list_sessions(spark: SparkSession, homes: dict[str, str], origin: str) -> DataFrame:
    """One row a session file: origin, session_id, source_path, bytes, mtime, folder, cwd, title, parent_id, has_history."""
    files, path = list_files(spark, LAYOUTS[origin].format(home=homes[origin])), F.col("source_path")
    if origin == "k3":
        files = files.filter(_part(path, -3) != "cli")
    session = _part(path, -2) if origin == "k3" else F.regexp_replace(_part(path, -1), r"\.jsonl$", "")
    files = files.select(F.lit(origin).alias("origin"), session.alias("session_id"), "source_path", "bytes", "mtime", _part(path, -2).alias("folder"))
    none = F.lit(None).cast("string")
    if origin == "a":
        return files.select("*", none.alias("cwd"), none.alias("title"), none.alias("parent_id"), F.lit(False).alias("has_history"))
    pattern = META[origin].format(home=homes[origin])
    if file_exists(spark, pattern):
        owner = _part(F.col("meta_path"), -2) if origin == "k3" else F.regexp_replace(_part(F.col("meta_path"), -1), r"\.json$", "")
        meta = read_session_meta(spark, pattern).select(owner.alias("session_id"), "cwd", "title", "parent_id").dropDuplicates(["session_id"])
        files = files.join(meta, "session_id", "left")
    else:
        files = files.select("*", none.alias("cwd"), none.alias("title"), none.alias("parent_id"))
    return with_history(files, history_stems(spark, homes[origin]))


def with_history(sessions: DataFrame, stems: DataFrame) -> DataFrame:
    """Adds ``has_history``: a history file is named after the session or the id inside its name."""
    known = stems.select(F.col("stem").alias("_stem")).distinct()
    own = F.array(F.col("session_id"), t.core_uuid(F.col("session_id")))
    hits = sessions.select("session_id", F.explode(own).alias("_stem")).join(known, "_stem").select("session_id").distinct().withColumn("has_history", F.lit(True))
    return sessions.drop("has_history").join(hits, "session_id", "left").withColumn("has_history", F.coalesce("has_history", F.lit(False)))


def name_projects(sessions: DataFrame) -> DataFrame:
    """Adds ``project``: the folder's last segment; of equal ones the n-th folder has ``-n``.

    Dialect A's folder is decoded from a directory name; the other two share the
    folders in their metadata, so one folder of both is one project, and
    sessions without a folder are in ``unknown``.
    """
    own = F.col("origin") == "a"
    keyed = sessions.withColumn("_a", own).withColumn("_dir", F.when(own, F.col("folder")).otherwise(F.coalesce("cwd", F.lit(""))))
    path = F.when(F.col("_a"), t.decode_project_dir(F.col("_dir"))).otherwise(F.col("_dir"))
    base = t.base_name(path, F.when(F.col("_dir") == "", "unknown").otherwise(F.col("_dir")))
    folders = keyed.select("_a", "_dir", F.struct("_a", base.alias("base")).alias("_base")).distinct()
    n = disambiguate(folders.withColumn("_name", F.concat(F.when(F.col("_a"), "a").otherwise("k"), F.lit("/"), F.col("_base.base"))), "_name", ["_dir"], "_unique")
    names = n.select("_a", "_dir", F.expr("substring(_unique, 3)").alias("project"))
    return keyed.join(names, ["_a", "_dir"]).drop("_a", "_dir")


def discover(spark: SparkSession, homes: dict[str, str], source: str = "auto") -> DataFrame:
    """Sessions of the active stores with their projects; one that both newer stores hold counts in the tree store."""
    found = {origin: list_sessions(spark, homes, origin) for origin in active_origins(spark, homes, source)}
    if "k2" in found and "k3" in found:
        found["k2"] = prefer_newer_store(found["k2"], found["k3"]).select(found["k2"].columns)
    if not found:
        raise ValueError("no session files found")
    columns = ["origin", "session_id", "source_path", "bytes", "mtime", "folder", "cwd", "title", "parent_id", "has_history"]
    return name_projects(functools.reduce(DataFrame.unionByName, (df.select(*columns) for df in found.values())))


def newest_first(sessions: DataFrame, group: str = "project") -> DataFrame:
    """Adds ``place`` from 1 in each group: by latest change, equal ones by file."""
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last("mtime"), "source_path")
    return sessions.withColumn("place", F.row_number().over(order))


def unreadable(sessions: DataFrame, parsed: DataFrame) -> DataFrame:
    """Sessions whose file has bytes of which not one line came through."""
    read = parsed.select("source_path").distinct()
    return sessions.filter("bytes > 0").join(read, "source_path", "left_anti")


def partly_read(sessions: DataFrame, parsed: DataFrame) -> DataFrame:
    """(source_path, bytes, read, lost) of files of which some lines came through and some bytes didn't.

    A line counts with its line feed, so a file that was read whole has as many
    bytes as its lines, or one less if its last line has none.
    """
    read = parsed.groupBy("source_path").agg(F.sum("bytes").alias("read"))
    return sessions.select("source_path", "bytes").join(read, "source_path").filter("read < bytes").withColumn("lost", F.col("bytes") - F.col("read"))
