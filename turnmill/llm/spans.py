"""Character spans of pattern matches as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 512  # matches
SPAN = "struct<start:int,end:int,value:string>"


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value), leftmost non-overlapping, in code points, end exclusive.

    ``split`` gives what lies between the matches that ``regexp_extract_all``
    gives, so running lengths of both are the positions.  An array that grows by
    one element is copied each time, so matches are walked in chunks of ``CHUNK``:
    a text of many matches takes time in proportion to them (but for one copy a
    chunk).  ``pattern`` must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("g")))
    pairs = F.filter(pairs, lambda p: p.m.isNotNull())

    def walk(at: Column, some: Column) -> Column:
        return F.aggregate(some, F.struct(at.alias("at"), none.alias("spans")), lambda acc, p: F.struct(
            (acc["at"] + p.g + F.length(p.m)).alias("at"),
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + p.g).alias("start"), (acc["at"] + p.g + F.length(p.m)).alias("end"), p.m.alias("value")))).alias("spans"),
        ))

    def extend(acc: Column, some: Column) -> Column:
        more = F.transform(F.array(walk(acc["at"], some)), lambda w: F.struct(w["at"].alias("at"), F.concat(acc["spans"], w["spans"]).alias("spans")))
        return F.get(more, 0)

    def walked(all_: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.size(all_) - 1, F.lit(CHUNK)), lambda i: F.slice(all_, i + 1, F.lit(CHUNK)))
        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none.alias("spans")), extend, lambda acc: acc["spans"])

    once = F.get(F.transform(F.array(pairs), walked), 0)  # a lambda's argument is computed once, an expression at each use
    return F.when(F.size(found) > 0, once).otherwise(none)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs that has these fields, comma-joined in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o.start < span.end) & (span.start < o.end))
