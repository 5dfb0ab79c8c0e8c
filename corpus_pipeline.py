"""From documents to packed token sequences: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir); ``docs`` has the columns of documents and
may have others of any name, and all stages but the last return them.  Rows with
nulls, repeated rows and empty tables pass through as the operators' docstrings say.

Stages that carry whole texts through Python set ``BATCH_ROWS`` on the session,
where it must stand until their result is written; ``run`` brings the session's
own setting back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm import decontamination, jaccard, language, packing, secrets
from turnmill.llm.scratch import free_all, materialise, noting_paths

BATCH_ROWS = 1_000  # of Arrow batches that carry whole texts; Spark's default of 10,000 takes a worker ten times the memory
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set(_BATCH, BATCH_ROWS)


def _folded(docs: DataFrame) -> DataFrame:
    """doc_id, text and lang, and all other columns in one struct, so that none clashes with an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "lang")]
    return docs.select("doc_id", "text", "lang", F.struct(F.lit(True), *others).alias("rest"))


def _unfolded(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.col(c) if c in ("doc_id", "text", "lang") else F.col(f"rest.`{c}`") for c in columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; a missing label is filled with the predicted one."""
    _small_batches(spark)
    found = language.identify(_folded(docs), language.train(docs), keep=("text", "lang", "rest")).filter(F.col("lang_pred") != language.UNDETERMINED)
    return _unfolded(found.withColumn("lang", F.coalesce("lang", "lang_pred")), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays, once."""
    _small_batches(spark)
    return jaccard.first_rows(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    _small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(_folded(docs), benchmark, keep=("text", "lang", "rest"))
    return _unfolded(found.filter("not contaminated"), docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the secrets in their texts are replaced and the length follows."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*(f"`{c}`" for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    _small_batches(spark)
    return packing.pack_documents(docs, size=2048)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer decide


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; a stage's own tables and its input are deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    batch, stale = spark.conf.get(_BATCH), []
    try:
        for name, stage in STAGES[:-1]:
            with noting_paths() as made:  # by this stage alone, whatever else runs in the session
                docs = materialise(stage(spark, docs, sf_dir), name)
            free_all(spark, [p for p in (*stale, *made) if p != docs._scratch_path])
            stale = [docs._scratch_path]
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(_BATCH, batch)
