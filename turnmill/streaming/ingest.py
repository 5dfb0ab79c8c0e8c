"""Incremental ingest of session files that appear and grow, with retroactive ownership.

A message belongs to the least of its holders, and a minimum may be taken in any
order: a batch only appends what it holds of each session (the first place of
each message, the least time and the number of events), and reading puts the
batches of a session together and takes the least of all holders.  Thus an older
session that arrives late takes its messages over, a session that grows keeps
its places and its earliest time, no watermark forgets a key, a batch that runs
again changes nothing, and a batch costs what it holds, not what the table
holds.  Now and then the table is compacted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnmill.operators.corpus import earliest_timestamps
from turnmill.sources import dialects
from turnmill.sources.lines import KEYS
from turnmill.streaming.growing import GrowingLines

COMPACT_AFTER = 50  # batches
_KEY = ["timestamp", "text_hash"]
_OWNER = ["earliest", "session_id", "origin", "source_path", "pos", "project"]


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath().toString() for s in found or []]


def _version(spark: SparkSession, table: str) -> int:
    """The latest complete compaction; 0 before the first."""
    done = [p.rsplit("/", 3)[-3] for p in _paths(spark, f"{table}/base-*/sessions/_SUCCESS")]
    return max((int(name.removeprefix("base-")) for name in done), default=0)


def append_batch(lines: DataFrame, events: DataFrame, table: str) -> None:
    """Add what a batch of a session's whole lines holds to the owner table at path ``table``.

    ``line_key.row`` is a line's first byte in its file, which tells batches of one session apart.
    """
    starts = lines.groupBy(*KEYS).agg(F.min("line_key.row").alias("start"))
    messages = dialects.messages(events)
    counts = events.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    sessions = starts.join(counts, KEYS).join(earliest_timestamps(messages), KEYS, "left").withColumn("earliest", F.coalesce("earliest", F.lit("")))
    holders = messages.withColumn("text_hash", F.sha2("text", 256)).groupBy(*_KEY, *KEYS).agg(F.min("pos").alias("pos")).join(starts, KEYS)
    path = f"{table}/new-{_version(lines.sparkSession, table)}"
    holders.select(*_KEY, *KEYS, "start", "pos").write.mode("append").parquet(f"{path}/holders")
    sessions.select(*KEYS, "start", "n", "earliest").write.mode("append").parquet(f"{path}/sessions")


def _stands(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if _paths(spark, path) else None


def _together(spark: SparkSession, table: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, holders) of all batches: what each session holds, with places counted from its beginning.

    A batch that ran twice left equal rows; one that ran again after it was
    compacted begins before the place up to which its session is compacted.
    """
    version = _version(spark, table)
    old, new = (_stands(spark, f"{table}/{name}-{version}/sessions") for name in ("base", "new"))
    if old is None and new is None:
        raise ValueError(f"no owner table at {table}")
    parts = []
    if old is not None:
        parts.append(old.select(*KEYS, F.lit(-1).cast("long").alias("start"), "upto", "n", "earliest"))
    if new is not None:
        fresh = new.distinct()
        if old is not None:
            fresh = fresh.join(old.select(*KEYS, F.col("upto").alias("_upto")), KEYS, "left").filter("_upto IS NULL OR start > _upto").drop("_upto")
        parts.append(fresh.select(*KEYS, "start", F.col("start").alias("upto"), "n", "earliest"))
    batches = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    earlier = Window.partitionBy(*KEYS).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    batches = batches.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))  # a row a session and batch
    least = F.coalesce(F.min(F.nullif("earliest", F.lit(""))), F.lit(""))
    sessions = batches.groupBy(*KEYS).agg(F.max("upto").alias("upto"), F.sum("n").alias("n"), least.alias("earliest"))
    held = []
    if old is not None:
        held.append(spark.read.parquet(f"{table}/base-{version}/holders").select(*_KEY, *KEYS, "pos"))
    if new is not None:
        holders = spark.read.parquet(f"{table}/new-{version}/holders").join(batches.select(*KEYS, "start", "before"), [*KEYS, "start"])
        held.append(holders.select(*_KEY, *KEYS, (F.col("pos") + F.col("before")).alias("pos")))
    return sessions, held[0] if len(held) == 1 else held[0].union(held[1])


def owners(spark: SparkSession, table: str) -> DataFrame:
    """(timestamp, text_hash, earliest, session_id, origin, source_path, pos, project): the owner of each message so far."""
    sessions, holders = _together(spark, table)
    known = holders.join(sessions.select(*KEYS, "earliest"), KEYS)
    return known.groupBy(*_KEY).agg(F.min(F.struct(*_OWNER)).alias("o")).select(*_KEY, "o.*")


def compact(spark: SparkSession, table: str) -> None:
    """Write the holders anew as one table and drop what it was made of; a compaction that fails leaves the old tables in use.

    Every holder stays, as an earlier time that a session grows by can still make it the owner.
    """
    version = _version(spark, table)
    sessions, holders = _together(spark, table)
    holders.groupBy(*_KEY, *KEYS).agg(F.min("pos").alias("pos")).write.mode("overwrite").parquet(f"{table}/base-{version + 1}/holders")
    sessions.write.mode("overwrite").parquet(f"{table}/base-{version + 1}/sessions")  # last: its mark makes the version count
    for name in (f"base-{version}", f"new-{version}"):
        for p in _paths(spark, f"{table}/{name}"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stream_ingest(
    spark: SparkSession, pattern: str, dialect: str, table: str, checkpoint: str, keys: Callable[[DataFrame], DataFrame],
    compact_after: int = COMPACT_AFTER, split: int | None = None,
) -> StreamingQuery:
    """Read session files as they appear and grow, and keep the owner table current.

    ``keys`` adds the key columns to (value, source_path, line_key) rows.  A batch
    holds the whole lines appended since the last one; large files are split among tasks.
    """
    spark.dataSource.register(GrowingLines)
    source = spark.readStream.format("growing_lines")
    raw = (source.option("split", split) if split else source).load(pattern)
    raw = raw.select("value", "source_path", F.struct(F.lit(0).cast("long").alias("block"), F.col("byte").alias("row")).alias("line_key"))

    def fold(batch: DataFrame, number: int) -> None:
        lines = keys(batch).persist()
        events = dialects.timeline(dialects.parse_lines(lines, dialect)).persist()
        append_batch(lines, events, table)
        events.unpersist()
        lines.unpersist()
        if number % compact_after == compact_after - 1:
            compact(spark, table)

    return raw.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
