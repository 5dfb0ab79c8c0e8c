"""Order-free fingerprints of sets of rows, by which they are compared without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(*columns: Column | str) -> Column:
    """An aggregate: struct(n, sum, xor) of hashes of the rows, whatever their order and however they are partitioned.

    Rows that stand twice count twice in ``n`` and ``sum`` and not at all in ``xor``.
    """
    told = [x for c in columns for x in ((F.col(c) if isinstance(c, str) else c), (F.col(c) if isinstance(c, str) else c).isNull())]  # a hash skips nulls
    return F.struct(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*told).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"),
        F.coalesce(F.bit_xor(F.xxhash64(F.lit("xor"), *told)), F.lit(0)).alias("xor"))


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (same): whether two frames of equal columns hold the same distinct rows; aggregates only, no join."""
    found = [df.distinct().agg(fingerprint(*df.columns).alias("f")) for df in (a, b)]  # a row each
    return found[0].union(found[1]).agg((F.count_distinct("f") == 1).alias("same"))
