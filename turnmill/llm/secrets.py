"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.scratch import materialise
from turnmill.llm.spans import listed, match_spans, overlaps


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


# The base patterns.
_NAMES = "|".join(map(_either_case, ["password", "passwd", "secret", "token", "api_?key"]))
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex")
ASSIGN_CHARS = 8

#: Further candidates: long runs of mixed characters, whatever stands before them.
OWNED = r"[A-Za-z0-9_-]{20,}"
OWNED_DISTINCT = 10
WIDE_OWNERS = 3  # values seen at so many owners are copied examples
WIDE_REPOS = 10  # and so are values seen in so many repositories, of however few owners
HOT_SHARE = 10_000  # a value in more than one of so many candidates is joined by broadcast; there are fewer of them than this


def _span(kind: Column | str, order: int, s: Column, value: Column) -> Column:
    return F.struct(s.start.alias("start"), F.lit(order).alias("order"), s.end.alias("end"), F.lit(kind).alias("kind"), F.sha2(value, 256).alias("hash"))


def candidate_spans(text: Column) -> tuple[Column, Column]:
    """(base spans sorted by start then kind, further candidates that meet none of them)."""
    assign = F.filter(match_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s.value, ASSIGN, 2)) >= ASSIGN_CHARS)
    base = F.array_sort(F.concat(
        F.transform(assign, lambda s: _span("assign", 0, s, F.regexp_extract(s.value, ASSIGN, 2))),
        F.transform(match_spans(text, ACCESS), lambda s: _span("access", 1, s, s.value)),
        F.transform(match_spans(text, HEX), lambda s: _span("hex", 2, s, s.value)),
    ))
    mixed = F.filter(match_spans(text, OWNED), lambda s: s.value.rlike("[A-Z]") & s.value.rlike("[a-z]") & s.value.rlike("[0-9]")
                     & (F.size(F.array_distinct(F.split(s.value, ""))) >= OWNED_DISTINCT))
    return base, F.transform(mixed, lambda s: _span("owned", 3, s, s.value))


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct owners, distinct (owner, repository) pairs and rows of each candidate hash.

    Each step aggregates before its shuffle, so a value that a third of all
    documents hold is one row a task, not one row a document.
    """
    per_repo = candidates.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    per_owner = per_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))


def _with_spread(rows: DataFrame, spread: DataFrame) -> DataFrame:
    """Rows joined with what ``ownership`` found of their hash.

    Hashes that hold more than one in ``HOT_SHARE`` of all candidates are fewer
    than ``HOT_SHARE`` by count, so they are broadcast; a hash of the others is a
    small part of their join.
    """
    spread = materialise(spread, "spread")
    cut = (spread.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    hot = F.broadcast(spread.filter(F.col("n") > cut))
    return rows.join(hot, "hash").unionByName(rows.join(hot.select("hash"), "hash", "left_anti").join(spread.filter(F.col("n") <= cut), "hash"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """Secrets of every whole text, and how their values are spread over the corpus.

    Base spans are pattern matches and always stay.  Further candidates (long
    mixed runs) become spans of kind ``owned`` if their value is owner-specific (one
    owner and less than ``WIDE_REPOS`` repositories) and looks live; values at
    ``WIDE_OWNERS`` owners or more, or in ``WIDE_REPOS`` repositories or more,
    are widely copied examples.  Hashes, not values, are aggregated by distinct
    repository (``repo_col`` within owner) and owner.

    Returns id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``,
    ``spans``, ``n_owner_specific`` and ``n_widely_copied`` (spans, base ones
    included, of either verdict) and ``repos``, each span's number of
    repositories in the order of ``spans``.  A null
    text is empty, null owners are one owner, null repositories one repository;
    repeated rows are scanned each, an empty table gives no rows, other columns
    are ignored.  ``text_hash`` tells texts of equal ids apart.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col).cast("string").alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    base, more = candidate_spans(F.col("text"))
    found = rows.select("row", "id", "owner", "repo", F.xxhash64("text").alias("text_hash"), base.alias("base"), more.alias("more"))
    found = found.withColumn("more", F.filter("more", lambda s: ~overlaps(s, F.col("base"))))
    table = materialise(found, "secrets")

    spans = table.select("row", "owner", "repo", F.explode(F.concat("base", "more")).alias("s"))
    flat = spans.select("row", "owner", "repo", "s.*")
    spread = ownership(flat)
    judged = _with_spread(flat.select("row", "hash").distinct(), spread).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("hash", F.struct("owners", "repos")))).alias("spread"))
    spread_of = lambda s: F.element_at(F.col("spread"), s["hash"])
    specific = lambda s: (spread_of(s)["owners"] == 1) & (spread_of(s)["repos"] < WIDE_REPOS)
    wide = lambda s: (spread_of(s)["owners"] >= WIDE_OWNERS) | (spread_of(s)["repos"] >= WIDE_REPOS)
    kept = F.array_sort(F.concat("base", F.filter("more", specific)))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return table.join(judged, "row", "left").withColumn("kept", kept).select(
        F.col("id").alias(id_col), *(count(k) for k in KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("kept")).alias("spans"),
        F.size(F.filter("kept", specific)).cast("long").alias("n_owner_specific"), F.size(F.filter("kept", wide)).cast("long").alias("n_widely_copied"),
        F.array_join(F.transform("kept", lambda s: spread_of(s)["repos"].cast("string")), ",").alias("repos"), "text_hash",
    )


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", **columns: str) -> DataFrame:
    """The documents with every span of ``scan_secrets`` replaced by ``mark``; spans that meet are one.

    All rows and columns stay.  A null text stays null, a text without spans is
    untouched, rows of equal ids are told apart by their texts.
    """
    found = scan_secrets(docs, id_col, text_col, **columns).filter("spans <> ''").select(F.col(id_col).alias("id"), F.col("text_hash").alias("hash"), F.col("spans").alias("spans")).distinct()
    # the row is one struct beside the join's own columns, whatever its columns are named
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.col("row")[text_col]
    parts = F.transform(F.split("spans", ","), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end")))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    walked = F.aggregate(F.array_sort(parts), zero, lambda acc, s: F.struct(
        F.greatest(acc["at"], s.end).alias("at"),
        F.when(s.start < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s.start - acc["at"]), F.lit(mark))).alias("out"),
    ), lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    joined = rows.join(found, F.col("doc").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    redacted = F.when(F.col("spans").isNull(), text).otherwise(walked).alias(text_col)
    return joined.select(*(redacted if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
