"""Global ranks and prefix sums without a single-task window.

Rows are range-partitioned by (group, order), each task numbers its own sorted
rows, and only the totals per (group, task) are summed across tasks.  A group of
any size is therefore spread over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.llm.scratch import materialise

PART, ROW, BEFORE = "_part", "rank", "before"


def with_global_rank(df: DataFrame, group: str | None, order: Sequence[str], weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Add ``rank`` (0-based row number in the group) and ``before`` (sum of ``weight`` over earlier rows).

    Returns the ranked rows and the totals per group (``rows``, ``weight``).
    ``group`` is a LONG column without nulls of few distinct values (the totals,
    one row per task and group, are broadcast); None makes one group.  Nulls in
    ``order`` come first; rows equal in all of ``order`` take ranks in any order.
    An empty input gives empty outputs.
    """
    group_key = F.col(group) if group else F.lit(0).cast("long")
    weighed = F.col(weight).cast("long") if weight else F.lit(0).cast("long")
    # written first, as range partitioning reads its input twice (once for a sample)
    rows = materialise(df.select("*", group_key.alias("_group"), weighed.alias("_weight")), "rows")
    keys = [F.col("_group"), *[F.col(c).asc_nulls_first() for c in order]]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([*placed.schema.fields, *(T.StructField(c, T.LongType()) for c in (PART, "_rank", "_before"))])
    table = materialise(placed.mapInArrow(_number_rows, schema), "ranked")

    totals = table.groupBy("_group", PART).agg(F.count(F.lit(1)).alias("rows"), F.sum("_weight").alias("weight"))
    earlier = Window.partitionBy("_group").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "_group", PART,
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_row_base"),
        F.coalesce(F.sum("weight").over(earlier), F.lit(0)).alias("_weight_base"),
    )
    ranked = table.join(F.broadcast(bases), ["_group", PART]).select(
        *df.columns,
        (F.col("_rank") + F.col("_row_base")).alias(ROW),
        (F.col("_before") + F.col("_weight_base")).alias(BEFORE),
    )
    sums = totals.groupBy("_group").agg(F.sum("rows").alias("rows"), F.sum("weight").alias("weight"))
    return ranked, sums


def _number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    last, rank, before = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        names = batch.schema.names
        group = batch.column(names.index("_group")).to_numpy(zero_copy_only=False)
        weight = batch.column(names.index("_weight")).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sums = np.cumsum(weight) - weight
        sizes = np.diff(np.r_[starts, n])
        ranks = np.arange(n) - np.repeat(starts, sizes)
        befores = sums - np.repeat(sums[starts], sizes)
        if group[0] == last:
            ranks[: sizes[0]] += rank
            befores[: sizes[0]] += before
        last, rank, before = group[-1], int(ranks[-1]) + 1, int(befores[-1] + weight[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(x.astype(np.int64)) for x in (np.full(n, part), ranks, befores))],
            names=[*names, PART, "_rank", "_before"],
        )
