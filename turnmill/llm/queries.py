"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm import decontamination, jaccard, language, neighbours, packing, pii, quality, runs, secrets, sharding, substrings, turns, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents")).drop("text_hash")


def op2_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), size=2048)


def op3_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_table(spark, sf_dir, "documents"), with_links=True)


def op4_winnowed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"), revisit_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(_table(spark, sf_dir, "documents"))


def op10_substring_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op11_flat_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("_seed", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    return runs.periodic_runs(docs, rewrite=runs.repeated_tail, seed_col="_seed")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_conversations(turns.damage(_table(spark, sf_dir, "conversations")), copies_col="copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_ownership": op1_secret_ownership,
    "op2_shard_by_bytes": op2_shard_by_bytes,
    "op3_parity_sketch_join": op3_parity_sketch_join,
    "op4_winnowed_decontamination": op4_winnowed_decontamination,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_pii_weak_supervision": op6_pii_weak_supervision,
    "op7_quality_cascade": op7_quality_cascade,
    "op8_warc_round_trip": op8_warc_round_trip,
    "op9_language_id": op9_language_id,
    "op10_substring_recompression": op10_substring_recompression,
    "op11_flat_graph_neighbours": op11_flat_graph_neighbours,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}
