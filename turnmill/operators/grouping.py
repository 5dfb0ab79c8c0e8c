"""Grouping of sessions into tasks: windows, id repair, validation, merges."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.functions import text as t
from turnmill.functions.fingerprint import same_sets
from turnmill.functions.running import settled, split_hot, with_running_sums
from turnmill.operators.names import allocate_slugs

HOT_ROWS = 200_000  # of a group from which it is packed by many tasks


def pack_windows(costs: DataFrame, group: str, budget: int, overhead: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``window``: next-fit of (id, cost) rows in id order (nulls last), each window within ``budget``.

    A group that fits as a whole is one window; an item beyond the budget has a
    window of its own; costs aren't negative.  Groups up to ``hot_rows`` are
    packed a task each; larger ones by ``_pack_hot``, over as many tasks as they need.
    """
    schema = T.StructType([*costs.schema.fields, T.StructField("window", T.LongType())])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        window, used, out = 0, overhead, []
        for i, cost in enumerate(rows["cost"].tolist()):
            if i and used + cost > budget:
                window, used = window + 1, overhead
            out.append(window)
            used += cost
        return rows.assign(window=out)

    small, hot = split_hot(costs, [group], hot_rows)
    packed = small.groupBy(group).applyInPandas(pack, schema)
    return packed if hot is None else packed.unionByName(_pack_hot(hot, group, budget - overhead))


def _pack_hot(costs: DataFrame, group: str, room: int) -> DataFrame:
    """Next-fit by pointer doubling.

    From prefix sums each row knows the row at which the window that it might
    begin would end: the first whose sum goes beyond the room, found by one more
    running count over rows and thresholds in order of value.  Windows begin at
    the rows that jumps from the first row reach; in each round the rows reached
    jump, and every jump is doubled, so rounds follow the logarithm of a group's windows.
    """
    order = [F.col("id").asc_nulls_last()]
    narrow = costs.select(F.col(group).alias("_g"), "id", "cost", F.struct(*(F.col(f"`{c}`") for c in costs.columns)).alias("_row"))
    rows = settled(with_running_sums(narrow, "_g", order, {"_rank": F.lit(1), "_before": F.col("cost")}))
    place = rows.select("_g", "_rank", "_before", (F.col("_before") + F.col("cost")).alias("_after"))
    ends = place.select("_g", F.col("_after").alias("_value"), F.lit(0).alias("_asks"), F.lit(None).cast("long").alias("_rank"))
    asks = place.select("_g", (F.col("_before") + room).alias("_value"), F.lit(1).alias("_asks"), "_rank")
    within = with_running_sums(ends.union(asks), "_g", [F.col("_value"), F.col("_asks")], {"_within": 1 - F.col("_asks")}).filter("_asks = 1")
    n = place.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    jumps = within.select("_g", "_rank", F.greatest(F.col("_rank") + 1, F.col("_within")).alias("_to"))
    jumps = settled(jumps.alias("j").join(n.alias("n"), F.expr("j._g <=> n._g AND j._to < n._n")).select("j._g", "j._rank", "j._to"))
    starts = settled(n.select("_g", F.lit(0).cast("long").alias("_rank")))
    while not jumps.isEmpty():
        reached = starts.alias("s").join(jumps.alias("j"), F.expr("s._g <=> j._g AND s._rank = j._rank")).select("s._g", F.col("j._to").alias("_rank"))
        starts = settled(starts.union(reached).distinct())
        jumps = settled(jumps.alias("a").join(jumps.alias("b"), F.expr("a._g <=> b._g AND a._to = b._rank")).select("a._g", "a._rank", "b._to"))
    begins = rows.alias("r").join(starts.alias("s"), F.expr("r._g <=> s._g AND r._rank = s._rank"), "left").select("r._g", "r._rank", "r._row", F.col("s._rank").isNotNull().cast("long").alias("_begins"))
    counted = with_running_sums(begins, "_g", [F.col("_rank")], {"_earlier": F.col("_begins")})
    return counted.select("_row.*", (F.col("_earlier") + F.col("_begins") - 1).alias("window"))


def canonical_ids(members: DataFrame, inputs: DataFrame) -> DataFrame:
    """Members (slug, pos, member) with an unknown id replaced if exactly one input has its stem."""
    stem = lambda c: F.regexp_replace(c, r"\.md$", "")
    known = inputs.select(F.col("id").alias("_known")).distinct()
    single = known.groupBy(stem(F.col("_known")).alias("_stem")).agg(F.count(F.lit(1)).alias("_n"), F.min("_known").alias("_one")).filter("_n = 1").select("_stem", "_one")
    out = members.join(known, F.col("member") == F.col("_known"), "left").join(single, stem(F.col("member")) == F.col("_stem"), "left")
    return out.select("slug", "pos", F.coalesce("_known", "_one", "member").alias("member"))


def validate_grouping(tasks: DataFrame, misc: DataFrame, inputs: DataFrame) -> DataFrame:
    """Problem rows (problem, slug, member) of tasks (slug, members), misc (member) and inputs (id)."""
    none = F.lit(None).cast("string")
    members = tasks.select("slug", F.explode("members").alias("member"))
    ids = inputs.select("id").distinct()
    unknown = lambda df: df.join(ids, F.col("member") == F.col("id"), "left_anti")
    covered = members.select("member").union(misc.select("member")).distinct()
    parts = [
        tasks.filter(~t.valid_slug(F.col("slug"))).select(F.lit("malformed slug").alias("problem"), "slug", none.alias("member")),
        tasks.groupBy("slug").count().filter("count > 1").select(F.lit("duplicate slug"), "slug", none),
        tasks.filter(F.size("members") == 0).select(F.lit("no members"), "slug", none),
        unknown(members).select(F.lit("unknown session"), "slug", "member"),
        unknown(misc).select(F.lit("unknown session"), none, "member"),
        ids.join(covered, F.col("id") == F.col("member"), "left_anti").select(F.lit("dropped session"), none, F.col("id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def unique_slugs(tasks: DataFrame, order: list[str]) -> DataFrame:
    """Tasks of several windows with a taken slug numbered, in ``order``, until it is free."""
    return allocate_slugs(tasks, order)


def misc_union(misc: DataFrame) -> DataFrame:
    """Members routed to misc in any window, once each."""
    return misc.select("member").distinct()


def same_coverage(tasks: DataFrame, misc: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row (same): whether tasks and misc together hold exactly the inputs (id), so that a grouping can be used again."""
    covered = tasks.select(F.explode("members").alias("id")).union(misc.select("member"))
    return same_sets(covered, inputs.select("id"))


def _first_come(entries: DataFrame) -> DataFrame:
    """Entries (pos, slugs, note and others) with the note of those whose slugs an earlier entry that counts has taken.

    One after the other an entry would count if no earlier one took its slugs.  In
    each round all undecided entries that come first on all their slugs count at
    once, and the others on these slugs are too late; so rounds follow how far
    entries hang on each other, not how many there are.
    """
    rows = settled(entries.withColumn("__at", F.struct("pos", F.monotonically_increasing_id().alias("id"))))
    wanted = rows.filter("note is null").select("__at", F.explode(F.array_distinct("slugs")).alias("__s"))
    left, taken = settled(wanted), []
    while not left.isEmpty():
        firsts = left.groupBy(F.col("__s").alias("__f")).agg(F.min("__at").alias("__first"))
        asked = left.join(firsts, F.col("__s").eqNullSafe(F.col("__f")))
        winners = asked.groupBy("__at").agg(F.bool_and(F.col("__at") == F.col("__first")).alias("all")).filter("all").select(F.col("__at").alias("__won"))
        won = settled(left.join(winners, F.col("__at") == F.col("__won")).select(F.col("__s").alias("__t"), F.col("__won")))
        taken.append(won)
        late = left.join(won, F.col("__s").eqNullSafe(F.col("__t"))).select(F.col("__at").alias("__gone")).distinct()
        left = settled(left.join(late, F.col("__at") == F.col("__gone"), "left_anti"))
    if not taken:
        return rows.drop("__at")
    all_taken = functools.reduce(DataFrame.union, taken)
    open_ = rows.filter("note is null or note = 'malformed slug'").select("__at", F.explode(F.array_distinct("slugs")).alias("__s"))
    meets = F.col("__s").eqNullSafe(F.col("__t")) & (F.col("__won") < F.col("__at"))
    late = open_.join(all_taken, meets).select(F.col("__at").alias("__late")).distinct()
    noted = rows.join(late, F.col("__at") == F.col("__late"), "left")
    return noted.withColumn("note", F.when(F.col("__late").isNotNull(), "already merged").otherwise(F.col("note"))).drop("__at", "__late")


def apply_merges(tasks: DataFrame, merges: DataFrame) -> DataFrame:
    """Tasks after merging: (slug, title, members, kind, note).

    ``tasks`` has slug, title and members, ``merges`` has pos, slugs, slug and
    title; both may have a ``rationale``, which is kept.  An entry counts if its slugs all exist, are at least two, aren't
    taken by an earlier entry that counts, and its own slug is well-formed; else
    it is a row of kind ``skipped`` with a note.  A merged slug that a kept or an
    earlier merged task has is numbered until it is free.  Existence is a join, and
    who came first is settled in rounds (``_first_come``).
    """
    known = tasks.select(F.col("slug").alias("_s")).distinct()
    wanted = merges.select("pos", F.explode_outer("slugs").alias("_s")).join(known.withColumn("_has", F.lit(True)), "_s", "left")
    status = wanted.groupBy("pos").agg(F.count_if(F.col("_s").isNotNull() & F.col("_has").isNull()).alias("missing"))
    judged = merges.join(status, "pos").withColumn("note", F.when(F.col("missing") > 0, "unknown slug").when(F.size("slugs") < 2, "fewer than two slugs").when(~t.valid_slug(F.col("slug")), "malformed slug"))

    none = F.lit(None).cast("string")
    said = lambda df: F.col("rationale") if "rationale" in df.columns else none
    columns = judged.select("pos", "slugs", "slug", "title", said(merges).alias("rationale"), "note")
    noted = _first_come(columns)
    counted = noted.filter("note is null")
    gone = counted.select(F.explode("slugs").alias("_s")).distinct()
    kept = tasks.join(gone, F.col("slug") == F.col("_s"), "left_anti")
    own = ["pos", "slug", "title", "rationale"]
    parts = counted.select(*own, F.posexplode("slugs").alias("at", "_s")).join(tasks.select(F.col("slug").alias("_s"), F.col("members")), "_s")
    union = parts.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("at", "members"))).alias("m"))
    merged = union.select(*own, F.array_distinct(F.flatten(F.transform("m", lambda x: x.members))).alias("members"))
    columns = ["slug", "title", "members", "rationale", "kind", "note"]
    both = kept.select("slug", "title", "members", said(tasks).alias("rationale"), F.lit("kept").alias("kind"), none.alias("note"), F.lit(-1).cast("long").alias("_pos")).unionByName(
        merged.select("slug", "title", "members", "rationale", F.lit("merged").alias("kind"), none.alias("note"), F.col("pos").cast("long").alias("_pos")))
    skipped = noted.filter("note is not null").select("slug", "title", F.col("slugs").alias("members"), "rationale", F.lit("skipped").alias("kind"), "note")
    return allocate_slugs(both, ["_pos"]).select(*columns).unionByName(skipped)
