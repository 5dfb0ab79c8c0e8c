"""Deterministic names: document names and slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from turnmill.functions import text as t
from turnmill.functions.running import settled

_NAME, _AT, _TRY = "__name", "__at", "__try"
RANGE_CHARS = 64  # of a text, these tell the ranges: the driver samples no longer ones


def in_order(rows: DataFrame, order: list[str], kept: dict[str, Column]) -> DataFrame:
    """``kept`` of each row with the row's place in ``order`` (nulls last, ties in any order) under ``__at``, settled.

    Rows are dealt to ranges and sorted there, which Spark spills: a place is the
    range (from bit 33 on) and the row's number in it.  What ``order`` needs and
    ``kept`` doesn't have goes no further.
    """
    held = rows.withColumn("__id", F.monotonically_increasing_id())
    ranges = []
    for c in [*order, "__id"]:
        text = isinstance(held.select(c).schema[0].dataType, StringType)
        ranges.append((F.left(F.col(c), F.lit(RANGE_CHARS)) if text else F.col(c)).asc_nulls_last())
        if text:
            break
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.repartitionByRange(count, *ranges).sortWithinPartitions(*(F.col(c).asc_nulls_last() for c in [*order, "__id"]))
    return settled(dealt.select(*(v.alias(k) for k, v in kept.items()), F.monotonically_increasing_id().alias(_AT)))


def first_free(rows: DataFrame, name: Column, alike: list[Column], shared_from: int) -> DataFrame:
    """``__at`` and ``__name``: in the order of ``__at``, each row takes the first name on its list that no earlier row took.

    ``rows`` come from ``in_order`` with no more than ``name`` and ``alike`` need.
    ``name`` is the name at place ``__try`` (from 0) of a row's list.  All rows ask
    at once; a name goes to the earliest that asks, and who is refused asks for the
    next one, until no name is asked for twice.  As all names prefer earlier rows,
    this settles as one row after the other would.  Rows that agree in ``alike``
    have the same list from place ``shared_from`` on, where each of them ends up
    behind those before it: so they ask at least that far down, and a name that
    many rows want takes no more rounds than one that few want.
    """
    state = rows.withColumn(_TRY, F.lit(0))
    while True:
        asked = state.withColumn(_NAME, name)
        firsts = asked.groupBy(F.col(_NAME).alias("__asked")).agg(F.min(_AT).alias("__first"))
        judged = asked.join(firsts, F.col(_NAME) == F.col("__asked")).withColumn("__lost", F.col(_AT) > F.col("__first")).drop("__asked", "__first")
        judged = settled(judged)
        if judged.filter("__lost").isEmpty():
            return judged.select(_AT, _NAME)
        moved = judged.withColumn(_TRY, F.col(_TRY) + F.col("__lost").cast("int")).drop(_NAME, "__lost")
        behind = _queued(moved.filter(F.col(_TRY) >= shared_from), alike)
        state = moved.filter(F.col(_TRY) < shared_from).unionByName(behind)


def _queued(rows: DataFrame, alike: list[Column]) -> DataFrame:
    """The rows with ``__try`` raised to what leaves each row of one list behind those before it.

    Each range of ``in_order`` counts by itself, only its totals meet, so a list
    that most rows share isn't one task's work.
    """
    keys = {f"__like{i}": c for i, c in enumerate(alike)}
    stretch = [*keys, "__range"]
    so_far = Window.partitionBy(*stretch).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({**keys, "__range": F.shiftright(_AT, 33)}).withColumn("__n", F.row_number().over(so_far).cast("long")).withColumn("__ahead", F.col(_TRY) - F.col("__n"))
    sums = local.groupBy(*(F.col(c).alias(f"{c}_") for c in stretch)).agg(F.count(F.lit(1)).alias("__rows"), F.max("__ahead").alias("__most"))
    earlier = Window.partitionBy(*(f"{c}_" for c in keys)).orderBy("__range_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = sums.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0))).withColumn("__base", F.max(F.col("__most") - F.col("__before")).over(earlier))
    same = F.lit(True)
    for c in stretch:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    placed = local.withColumn("__own", F.max("__ahead").over(so_far)).join(sums, same)
    raised = F.col("__before") + F.col("__n") + F.greatest(F.col("__own") - F.col("__before"), F.col("__base"))
    return placed.withColumn(_TRY, raised.cast("int")).select(*rows.columns)


def allocate_document_names(sessions: DataFrame, order: list[str], id_chars: int = 8) -> DataFrame:
    """Adds ``export``: ``<project>-<first characters of id>.md``.

    Rows are served in ``order``.  A taken name gets one more character of the
    id at a time, then ``-2``, ``-3`` (see ``first_free``).
    """
    project, stem = F.coalesce(F.nullif(t.sanitize_name(F.col("project")), F.lit("")), F.lit("project")), F.coalesce(F.nullif(t.sanitize_name(F.col("session_id")), F.lit("")), F.lit("session"))
    placed = in_order(sessions, order, {**{c: F.col(f"`{c}`") for c in sessions.columns}, "__project": project, "__stem": stem})
    more = F.greatest(F.length("__stem") - id_chars, F.lit(0))  # characters by which the name can grow
    tail = F.when(F.col(_TRY) <= more, F.left("__stem", F.col(_TRY) + id_chars)).otherwise(F.concat("__stem", F.lit("-"), (F.col(_TRY) - more + 1).cast("string")))
    name = F.concat("__project", F.lit("-"), tail, F.lit(".md"))
    named = first_free(placed.select(_AT, "__project", "__stem"), name, [F.col("__project"), F.col("__stem")], 0).select(F.col(_AT).alias("__for"), _NAME)
    return placed.join(named, F.col(_AT) == F.col("__for")).select(*(F.col(f"`{c}`") for c in sessions.columns), F.col(_NAME).alias("export"))


def allocate_slugs(tasks: DataFrame, order: list[str], slug: str = "slug") -> DataFrame:
    """Tasks with unique slugs: in ``order``, a taken slug is numbered from 2 until it is free (see ``suffix_slug``)."""
    columns = {c: F.col(f"`{c}`") for c in tasks.columns}
    return _with_unique_slugs(in_order(tasks, order, columns), slug).select(*columns.values())


def _with_unique_slugs(placed: DataFrame, slug: str) -> DataFrame:
    """Rows of ``in_order``, each slug numbered where an earlier row has it.

    A numbered slug keeps its first words, so only slugs that agree in their first
    four words without trailing numbers can meet; families in which no slug stands
    twice stay as they are.  The others are settled by ``first_free``: slugs with one
    stem share the numbered names.
    """
    own = F.col("__slug")
    words = F.array_join(F.slice(F.split(own, "-"), 1, 4), "-")
    family = placed.select(_AT, F.col(slug).alias("__slug")).withColumn("__family", F.regexp_replace(words, "(?:-[0-9]+)+$", ""))
    twice = family.groupBy("__family", "__slug").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("__family").alias("__twice")).distinct()
    meeting = family.join(twice, F.col("__family") == F.col("__twice"), "left_semi").select(_AT, "__slug")
    stem = F.when(F.size(F.split(own, "-")) < 5, own).otherwise(words)
    name = F.when(F.col(_TRY) == 0, own).otherwise(F.concat(stem, F.lit("-"), (F.col(_TRY) + 1).cast("string")))
    served = first_free(meeting, name, [stem], 1).select(F.col(_AT).alias("__for"), _NAME)
    return placed.join(served, F.col(_AT) == F.col("__for"), "left").withColumn(slug, F.coalesce(_NAME, slug)).drop("__for", _NAME)


def name_clashes(named: DataFrame, column: str = "export") -> DataFrame:
    """Names that more than one row has; none is right."""
    return named.groupBy(column).count().filter("count > 1")


def single_session_tasks(digests: DataFrame) -> DataFrame:
    """One task a digest (columns ``export``, ``goal``): slug from the name, title from the goal.

    In name order, a taken slug is numbered until it is free; the number takes the
    fifth word's place at the latest.  Names may be of any length: they are sorted
    once, and what is settled has a digest of the row in their place.  ``digests``
    is read again to join the slugs, so it has to give the same rows each time.
    """
    rows = digests.select("export", "goal")
    goal = F.coalesce("goal", F.lit(""))
    key = F.sha2(F.concat(F.length(goal).cast("string"), F.lit(":"), goal, F.col("export").isNull().cast("string"), F.coalesce("export", F.lit(""))), 256)
    made = rows.withColumns({"__key": key, "slug": F.array_join(t.slug_words(F.col("export")), "-")})
    placed = in_order(made, ["export"], {"__key": F.col("__key"), "slug": F.col("slug")})
    slugs = settled(_with_unique_slugs(placed, "slug").groupBy(F.col("__key").alias("__of")).agg(F.collect_list("slug").alias("__slugs")))
    once = slugs.filter(F.size("__slugs") > 1).isEmpty()
    copy = F.lit(1) if once else F.row_number().over(Window.partitionBy("__key").orderBy("__key"))  # rows of one key are equal
    found = rows.withColumn("__key", key).join(slugs.hint("shuffle_hash"), F.col("__key") == F.col("__of"), "left").withColumn("__copy", copy)
    return found.select(F.get("__slugs", F.col("__copy") - 1).alias("slug"), F.coalesce(F.nullif("goal", F.lit("")), F.col("export")).alias("title"), F.array("export").alias("members"))
