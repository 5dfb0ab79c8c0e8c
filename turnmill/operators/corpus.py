"""Cross-session ownership of messages, session summaries and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions.running import split_hot, with_running_sums
from turnmill.sources.lines import KEYS

CHUNK_CHARS = 64 << 20  # of a document in one row


def earliest_timestamps(messages: DataFrame) -> DataFrame:
    """The least non-empty timestamp of each session, or ''."""
    return messages.groupBy(*KEYS).agg(F.coalesce(F.min(F.when(F.col("timestamp") != "", F.col("timestamp"))), F.lit("")).alias("earliest"))


def first_owner_dedupe(messages: DataFrame) -> DataFrame:
    """Messages that their first holder keeps, re-indexed from 0 in each session.

    Sessions are ordered by earliest timestamp ('' first), then id, origin and
    path; a (timestamp, text) belongs to the first that holds it, and to its first
    place there.  The owner is the minimum of a struct, so a text that a third of
    all messages share is aggregated before the shuffle and never joined back.
    """
    known = messages.join(earliest_timestamps(messages), KEYS)
    owner = known.groupBy("timestamp", "text").agg(F.min(F.struct("earliest", "session_id", "origin", "source_path", "pos", "project")).alias("o"))
    kept = owner.select(*(F.col(f"o.{k}").alias(k) for k in KEYS), F.col("o.pos").alias("pos"), "timestamp", "text")
    order = Window.partitionBy(*KEYS).orderBy("pos")
    return kept.select(*KEYS, (F.row_number().over(order) - 1).cast("long").alias("index"), "pos", "timestamp", "text")


def corpus_sessions(messages: DataFrame, corpus: DataFrame, bad: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """One row a session: messages kept, first and last timestamp by index, copies dropped, bad lines.

    ``sessions`` (keys) names them all; by default those with a message.
    """
    all_ = messages.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("extracted"))
    kept = corpus.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("messages"), F.min_by("timestamp", "index").alias("first_ts"), F.max_by("timestamp", "index").alias("last_ts"))
    out = (all_ if sessions is None else sessions.select(*KEYS).join(all_, KEYS, "left")).join(kept, KEYS, "left")
    out = out.join(bad, KEYS, "left") if bad is not None else out.withColumn("bad_lines", F.lit(0).cast("long"))
    n = F.coalesce("messages", F.lit(0))
    return out.select(*KEYS, n.alias("messages"), F.coalesce("first_ts", F.lit("")).alias("first_ts"), F.coalesce("last_ts", F.lit("")).alias("last_ts"),
                      (F.coalesce("extracted", F.lit(0)) - n).alias("dropped"), F.coalesce("bad_lines", F.lit(0)).alias("bad_lines"))


def substance(sessions: DataFrame, minimum: int) -> DataFrame:
    """Adds ``bucket``: zero, below minimum or eligible."""
    n = F.col("messages")
    return sessions.withColumn("bucket", F.when(n == 0, "zero").when(n < minimum, "below").otherwise("eligible"))


def _block() -> Column:
    return F.concat(F.lit("\n### "), F.col("timestamp"), F.lit("\n\n"), F.col("text"), F.lit("\n"))


def _header() -> Column:
    return F.concat(F.lit("<!-- source: "), F.col("source_path"), F.lit("\n     messages: "), F.col("messages").cast("string"), F.lit(" -->\n"))


def render_documents(corpus: DataFrame) -> DataFrame:
    """(keys, messages, content): the header, then a block a message, one blank line apart.  See ``render_chunks`` for sessions beyond a row."""
    blocks = F.array_sort(F.collect_list(F.struct("index", _block().alias("block"))))
    grouped = corpus.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("messages"), blocks.alias("blocks"))
    return grouped.select(*KEYS, "messages", F.concat(_header(), F.array_join(F.transform("blocks", lambda b: b.block), "")).alias("content"))


def render_chunks(corpus: DataFrame, chunk_chars: int = CHUNK_CHARS, hot_rows: int | None = None) -> DataFrame:
    """(keys, messages, chunk, offset, content): the documents of ``render_documents``, cut every ``chunk_chars`` characters.

    Running sums of the blocks' lengths tell which chunks a block reaches into; it
    is cut at their bounds and each chunk is put together by itself, so a session
    of any length is written without a row above the limit.  With ``hot_rows``,
    sessions of more messages are summed in stretches (see ``split_hot``).
    """
    counts = corpus.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("messages"))
    heads = counts.select(*KEYS, F.lit(-1).cast("long").alias("index"), _header().alias("block"))
    rows = heads.unionByName(corpus.select(*KEYS, F.col("index").cast("long").alias("index"), _block().alias("block")))
    rows = rows.withColumn("size", F.length("block").cast("long"))
    small, hot = (rows, None) if hot_rows is None else split_hot(rows, KEYS, hot_rows)
    earlier = Window.partitionBy(*KEYS).orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    placed = small.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    if hot is not None:
        placed = placed.unionByName(with_running_sums(hot, KEYS, [F.col("index")], {"before": F.col("size")}))
    reach = F.expr(f"sequence(before div {chunk_chars}L, (before + size - 1) div {chunk_chars}L)")
    cut = placed.withColumn("chunk", F.explode(reach)).withColumn("offset", F.col("chunk") * chunk_chars)
    first = F.greatest(F.col("offset"), F.col("before"))
    piece = F.substring("block", (first - F.col("before") + 1).cast("int"), (F.least(F.col("offset") + chunk_chars, F.col("before") + F.col("size")) - first).cast("int"))
    parts = cut.groupBy(*KEYS, "chunk", "offset").agg(F.array_sort(F.collect_list(F.struct("index", piece.alias("piece")))).alias("parts"))
    content = F.array_join(F.transform("parts", lambda p: p.piece), "").alias("content")
    return parts.join(counts, KEYS).select(*KEYS, "messages", "chunk", "offset", content)


def manifest(sessions: DataFrame, names: DataFrame) -> DataFrame:
    """One row an exported session, sorted by document name."""
    return sessions.join(names, KEYS).select("export", "origin", "project", "session_id", "messages", "first_ts", "last_ts").orderBy("export")


def law_violations(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Messages and human events that don't pair up by rank, timestamp and text; none is right."""
    rank = lambda order: F.row_number().over(Window.partitionBy(*KEYS).orderBy(order))
    a = messages.select(*KEYS, rank("pos").alias("n"), "timestamp", "text")
    b = events.filter("kind = 'human'").select(*KEYS, rank("event_pos").alias("n"), "timestamp", "text")
    both = a.withColumn("balance", F.lit(1)).unionByName(b.withColumn("balance", F.lit(-1)))
    odd = both.groupBy(*KEYS, "n", "timestamp", "text").agg(F.sum("balance").alias("balance")).filter("balance <> 0")
    return odd.select(*KEYS, "n", "timestamp", "text", F.when(F.col("balance") > 0, "message").otherwise("event").alias("side"))


def project_inventory(lines: DataFrame) -> DataFrame:
    """Sessions, non-blank lines and latest change of each project, latest first."""
    wordy = F.count_if(F.trim("value") != "")
    return lines.groupBy("project").agg(F.countDistinct("session_id").alias("sessions"), wordy.alias("entries"), F.max("mtime").alias("latest")).orderBy(F.desc_nulls_last("latest"), "project")


def disambiguate(df: DataFrame, base: str, order: list[str], out: str) -> DataFrame:
    """The n-th row of an equal ``base`` gets ``-n`` from the second on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), n.cast("string"))))


def project_filter(df: DataFrame, wanted: str | None) -> Column:
    return F.lit(True) if wanted is None else F.lower("project").contains(wanted.lower())


def origin_rollup(sessions: DataFrame) -> DataFrame:
    return sessions.rollup("origin").agg(F.count(F.lit(1)).alias("sessions")).select(F.coalesce("origin", F.lit("total")).alias("origin"), "sessions")
