"""Reading back what earlier runs wrote, tolerant of malformed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import text as t
from turnmill.functions import variant as v

CONFIDENCE = ["high", "medium", "low"]


def read_records(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, slug_dir, value) of whole files; the folder name is the record's key."""
    raw = spark.read.option("wholetext", "true").option("ignoreCorruptFiles", "true").text(pattern)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.element_at(F.split("_metadata.file_path", "/"), -2).alias("slug_dir"), "value")


def _strings(e: Column, path: str) -> Column:
    found = F.filter(F.transform(v.array(e, path), v.string), lambda s: s.isNotNull())
    return F.coalesce(found, F.array().cast("array<string>"))


def parse_library(records: DataFrame) -> DataFrame:
    """Library records with a default for each field that is missing or of a wrong type; a record needs its slug."""
    e = F.col("_v")
    pairs = F.transform(F.filter(v.array(e, "$.preferences"), lambda p: v.text(p, "$.text").isNotNull()), lambda p: F.struct(v.text(p, "$.text").alias("text"), F.coalesce(v.text(p, "$.evidence"), F.lit("")).alias("evidence")))
    confidence = v.text(e, "$.confidence")
    out = records.withColumn("_v", v.parse(F.col("value"))).filter(v.text(e, "$.slug").isNotNull())
    return out.select(
        v.text(e, "$.slug").alias("slug"), F.coalesce(v.text(e, "$.title"), v.text(e, "$.slug")).alias("title"), _strings(e, "$.members").alias("members"), _strings(e, "$.sessionIds").alias("session_ids"), _strings(e, "$.domains").alias("domains"),
        F.coalesce(pairs, F.array().cast("array<struct<text:string,evidence:string>>")).alias("preferences"), F.when(confidence.isin(CONFIDENCE), confidence).otherwise("low").alias("confidence"),
        F.coalesce(v.text(e, "$.authored_at"), F.lit("")).alias("authored_at"), v.text(e, "$.generation").alias("generation"), v.text(e, "$.oneshot_hash").alias("content_hash"), F.coalesce(v.number(e, "$.input_coverage"), F.lit(1.0)).alias("coverage"),
    ).orderBy(F.desc("authored_at"), "slug")


def library_issues(expected: DataFrame, records: DataFrame) -> DataFrame:
    """(slug, issue) of expected records that are missing, not JSON or without a slug, in slug order."""
    parsed = records.select(F.col("slug_dir").alias("slug"), v.parse(F.col("value")).alias("_v"), F.lit(True).alias("_there"))
    issue = F.when(F.col("_there").isNull(), "missing").when(~v.is_object(F.col("_v")), "not JSON").when(v.text(F.col("_v"), "$.slug").isNull(), "fails schema")
    return expected.select("slug").distinct().join(parsed, "slug", "left").select("slug", issue.alias("issue")).filter("issue is not null").orderBy("slug")


def parse_digests(rows: DataFrame, outcomes: list[str]) -> DataFrame:
    """Valid digests of (export, value) rows; an invalid one is dropped alone."""
    e = F.col("_v")
    good = v.text(e, "$.goal").isNotNull() & v.text(e, "$.deliverable").isNotNull() & v.text(e, "$.domain").isNotNull() & v.array(e, "$.keywords").isNotNull() & v.text(e, "$.outcome").isin(outcomes)
    parsed = rows.withColumn("_v", v.parse(F.col("value"))).filter(good)
    return parsed.select("export", *(v.text(e, f"$.{c}").alias(c) for c in ("goal", "deliverable", "domain")), _strings(e, "$.keywords").alias("keywords"), v.text(e, "$.outcome").alias("outcome"))


def parse_keyed(rows: DataFrame, required: list[str]) -> DataFrame:
    """(key, element) of files that hold ``{key: [records]}``; a key with a bad record goes whole, ``_note`` is no key."""
    pairs = rows.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "list")).filter("key <> '_note'")
    items = pairs.select("key", v.array(v.parse(F.col("list")), "$").alias("items"))
    fine = lambda i: F.aggregate(F.array(*(v.at(i, f"$.{c}").isNotNull() for c in required)), F.lit(True), lambda a, b: a & b) & v.is_object(i)
    return items.filter("items is not null").filter(F.forall("items", fine)).select("key", F.explode("items").alias("element"))


def parse_tasks(rows: DataFrame) -> DataFrame:
    """(slug, title, members) of a tasks file; a file with a bad task is rejected whole."""
    e = F.col("_v")
    parsed = rows.withColumn("_v", v.parse(F.col("value")))
    fine = lambda k: v.text(k, "$.slug").isNotNull() & v.text(k, "$.title").isNotNull() & v.array(k, "$.members").isNotNull()
    whole = parsed.filter(F.coalesce(F.forall(v.array(e, "$.tasks"), fine), F.lit(False)))
    return whole.select(F.explode(v.array(e, "$.tasks")).alias("k")).select(v.text(F.col("k"), "$.slug").alias("slug"), v.text(F.col("k"), "$.title").alias("title"), _strings(F.col("k"), "$.members").alias("members"))


def body_problem(content: Column, minimum: int = 120) -> Column:
    """Why an authored body is invalid, or null."""
    return F.when(content.isNull(), "missing").when(F.length(t.trim_all(content)) < minimum, "too short")
