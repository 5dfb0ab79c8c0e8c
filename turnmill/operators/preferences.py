"""Recurring preferences over a library of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import text as t


def aggregate_preferences(preferences: DataFrame) -> DataFrame:
    """Ranked preferences from (slug, authored_at, task_pos, pos, text, evidence) rows.

    Equal normalised texts are one, counted once a task; the newest phrasing
    stands (of equal times the first seen); occurrences are in task order.
    ``task_pos`` orders tasks, ``pos`` the preferences of one.
    """
    keyed = preferences.withColumn("key", t.normalize_key(F.col("text"))).filter("key <> ''").withColumn("authored_at", F.coalesce("authored_at", F.lit("")))
    once = F.row_number().over(Window.partitionBy("slug", "key").orderBy("pos"))
    first = keyed.withColumn("_n", once).filter("_n = 1")
    grouped = first.groupBy("key").agg(
        F.count(F.lit(1)).alias("count"), F.max("authored_at").alias("last_authored_at"),
        F.max_by(t.trim_all(F.col("text")), F.struct(F.col("authored_at"), (-F.col("task_pos")).alias("p"))).alias("text"),
        F.array_sort(F.collect_list(F.struct("task_pos", "slug", "evidence"))).alias("_seen"),
    )
    return grouped.select("key", "text", "count", "last_authored_at", F.transform("_seen", lambda s: F.struct(s.slug.alias("slug"), s.evidence.alias("evidence"))).alias("occurrences")).orderBy(F.desc("count"), F.desc("last_authored_at"), "text")


def preference_occurrences(preferences: DataFrame) -> DataFrame:
    """(key, slug, task_pos, evidence) of each task that states a preference: a flat table, however popular a key is."""
    keyed = preferences.withColumn("key", t.normalize_key(F.col("text"))).filter("key <> ''")
    once = F.row_number().over(Window.partitionBy("slug", "key").orderBy("pos"))
    return keyed.withColumn("_n", once).filter("_n = 1").select("key", "slug", "task_pos", "evidence")


def has_occurrences(ranked: DataFrame) -> bool:
    """Whether each preference names a task that states it."""
    return ranked.filter(F.coalesce(F.size("occurrences"), F.lit(0)) <= 0).isEmpty()


def recurring_count(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.count_if(F.col("count") > 1).alias("recurring"))


#: Comments that lead a block in the place where it is to stand; ``{date}`` is the day of the run.
TARGETS = {
    "notes": "<!-- preferences of {date} -->", "steering": "<!-- preferences of {date}, for the steering folder -->", "agents": "<!-- preferences of {date}, for the agents file -->",
}


def target_comment(target: str, date: str) -> str:
    if target not in TARGETS:
        raise ValueError(f"unknown target {target!r}; known: {', '.join(TARGETS)}")
    return TARGETS[target].format(date=date)


def render_block(ranked: DataFrame, task_count: int, comment: str, heading: str = "## Working preferences", grouped: bool = True) -> DataFrame:
    """The preferences as one text, under a line for each count when there are several tasks.

    ``grouped`` is False for items that no longer name their tasks (see
    ``has_occurrences``): they are a flat list, in the order of ranking.
    """
    if not grouped:
        task_count = 1
    line = F.concat(F.lit("- "), F.col("text"))
    by_count = ranked.groupBy("count").agg(F.array_sort(F.collect_list(F.struct("last_authored_at", "text", line.alias("line")))).alias("lines"))
    if task_count > 1:
        head = F.concat(F.lit("\n<!-- stated in "), F.col("count").cast("string"), F.lit(f" of {task_count} tasks -->\n"))
    else:
        head = F.lit("")
    newest = lambda a, b: F.when(a.last_authored_at > b.last_authored_at, -1).when(a.last_authored_at < b.last_authored_at, 1).when(a.text < b.text, -1).when(a.text > b.text, 1).otherwise(0)
    parts = by_count.select("count", F.concat(head, F.array_join(F.transform(F.array_sort("lines", newest), lambda x: x.line), "\n")).alias("part"))
    body = parts.agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("count", "part")))), lambda p: p.part), "\n").alias("body"))
    start = F.lit(f"{comment}\n{heading}" + ("" if task_count > 1 else "\n"))
    return body.select(F.when(F.coalesce("body", F.lit("")) == "", F.lit(f"{comment}\n{heading}")).otherwise(F.concat(start, F.lit("\n"), F.col("body"))).alias("block"))
