"""Contiguous, byte-balanced shards from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.ranking import with_global_rank

OVERHEAD = 16  # bytes counted for each document besides its text


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, in id order, into ``shards`` contiguous runs of nearly equal bytes.

    Size: UTF-8 bytes of the text plus ``OVERHEAD``.  Per-partition totals give
    every document its global byte position; the middle of a document decides
    its shard, so a shard misses its equal target by less than one document at
    either end.  Texts are never shuffled, only (id, size, checksum) rows are.

    Returns id, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0
    in each shard).  A null text counts as empty, a null id sorts first, equal
    ids are ordered by checksum and size (rows equal in all three take slots in
    any order), an empty table gives no rows, other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    ranked, sums = with_global_rank(narrow, None, ["id", "text_crc32", "size"], "size")
    total = (sums.agg(F.sum("weight")).first()[0]) or 1
    middle = f"((2 * before + size) * {shards}L) div {2 * total}L"
    placed = ranked.withColumn("shard", F.expr(f"cast(least({shards - 1}L, {middle}) as int)"))
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("rank") - F.col("first_rank")).alias("slot")
    )
