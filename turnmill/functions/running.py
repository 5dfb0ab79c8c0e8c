"""Running sums and last values of groups of any size, without a window that is one task's work."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder that ``spark.checkpoint.dir`` names; a local session without one takes a folder of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="turnmill-")
        sc.setCheckpointDir(base)
    return df.checkpoint()


def _dealt(df: DataFrame, groups: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """The rows with their values, range-partitioned by group and order; the partition's number stays with each row,
    so nothing depends on a later run of the sampling."""
    held = df.withColumns({f"__v{i}": v for i, v in enumerate(values.values())})
    return settled(held.repartitionByRange(*(F.col(g) for g in groups), *order).withColumn("__part", F.spark_partition_id()))


def _before(
    placed: DataFrame, groups: list[str], order: list[Column], totals: list[Column], over: Callable[[Column, WindowSpec], Column],
    both: Callable[[Column, Column], Column], names: list[str], columns: list[str],
) -> DataFrame:
    """What ``over`` gives over the rows of a group before each row, from its own stretch and the totals of earlier ones."""
    count = range(len(names))
    sums = placed.groupBy(*groups, "__part").agg(*(t.alias(f"__t{i}") for i, t in enumerate(totals)))
    earlier = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    bases = sums.select(*(F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)), F.col("__part").alias("__p"), *(over(F.col(f"__t{i}"), earlier).alias(f"__b{i}") for i in count))
    own = Window.partitionBy(*groups, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"__l{i}": over(F.col(f"__v{i}"), own) for i in count})
    same = F.col("__part") == F.col("__p")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    return local.join(bases, same).select(*(F.col(f"`{c}`") for c in columns), *(both(F.col(f"__l{i}"), F.col(f"__b{i}")).alias(name) for i, name in enumerate(names)))


def with_running_sums(df: DataFrame, group: str | list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, under each name, the sum of a LONG column over the rows of the group that come before in ``order``.

    Rows are range-partitioned by group and order, each stretch is summed by
    itself, and only its totals are summed over the group; so a group of a third
    of all rows is as many stretches as its rows need.  Rows that are equal in
    ``order`` come in any order.  An empty table gives no rows.
    """
    groups = [group] if isinstance(group, str) else group
    placed = _dealt(df, groups, order, {name: w.cast("long") for name, w in sums.items()})
    total = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))
    return _before(placed, groups, order, [F.sum(f"__v{i}") for i in range(len(sums))], total, lambda a, b: a + b, list(sums), df.columns)


def with_running_last(df: DataFrame, groups: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Adds, under each name, the last value that isn't null among the rows of the group that come before in ``order``.

    As ``with_running_sums``: a stretch passes on only its last values.  ``order`` tells the rows of a group apart.
    """
    placed = _dealt(df, groups, order, values)
    place = F.struct(*(F.struct(o.isNotNull(), o) for o in order))
    totals = [F.max_by(f"__v{i}", F.when(F.col(f"__v{i}").isNotNull(), place)) for i in range(len(values))]
    latest = lambda c, window: F.last(c, ignorenulls=True).over(window)
    return _before(placed, groups, order, totals, latest, lambda a, b: F.coalesce(a, b), list(values), df.columns)


def split_hot(df: DataFrame, groups: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups up to ``hot_rows`` rows, and those of larger ones (None if there are none)."""
    named = [F.col(g).alias(f"__h{k}") for k, g in enumerate(groups)]
    hot = settled(df.groupBy(*named).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows))
    if hot.isEmpty():
        return df, None
    same = F.lit(True)
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__h{k}"))
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")
