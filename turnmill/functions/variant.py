"""Tolerant access to parsed JSON: a value of the wrong type counts as absent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LONG_LINE = 8_000_000  # characters of a line from which its long strings are kept beside the parsed value
LONG_PIECE, EDGE = 400_000, 100_000  # characters of a string that is cut, and about what stays of it at either end

_MARK = ("\uE0F1", "\uE0F2")
_QUOTE = r'"(?<=(?<!\\)(?:\\\\){0,64}")'  # a quote that no backslash escapes
#: Tokens that the rules look for inside a text, and what may stand between them.
KEPT = {
    ("the user said:",): (),
    ("<command-name>", "</command-name>"): ("[^<]*",),
    ("<command-args>", "</command-args>"): ("[^<]*",),
    ("<user_message", ">", "</user_message>"): (r"\b[^>]*", ".*?"),
}
_STRINGS = {"maxStringLen": str(2**31 - 1)}


def allow_repeated_keys(spark: SparkSession) -> None:
    """The last of a repeated JSON key counts.  The parser reads this setting of the session when a query runs, so it stays."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _bare(pattern: str) -> str:
    """``pattern`` where no backslash escapes its first character; it is looked for first, as most places don't hold it."""
    return rf"{pattern}(?<=(?<!\\)(?:\\\\){{0,64}}{pattern})"


def _plain(piece: Column) -> Column:
    """The same JSON string with escapes of the characters in ``KEPT`` written as themselves."""
    out = F.when(F.contains(piece, F.lit(r"\/")), F.regexp_replace(piece, _bare(r"\\/"), "/")).otherwise(piece)
    plain = out
    for c in sorted({c for tokens in KEPT for token in tokens for c in token}):
        plain = F.regexp_replace(plain, _bare(rf"\\u00(?i:{ord(c):02x})"), c)
    return F.when(F.contains(out, F.lit(r"\u00")), plain).otherwise(out)


def _tokens(piece: Column) -> Column:
    """(at, end) of what ``KEPT`` names, in order: of each, the first place where all its tokens follow each other."""

    def placed(tokens: tuple[str, ...]) -> Callable[[Column], Column]:
        def spans(f: Column) -> Column:
            inner = [f["at"] + F.locate(token, f["found"], len(tokens[0]) + 1) - 1 for token in tokens[1:-1]]
            places = [f["at"], *inner, *([f["at"] + F.length(f["found"]) - len(tokens[-1])] if len(tokens) > 1 else [])]
            return F.array(*(F.when(f["found"] != "", F.struct(at.alias("at"), (at + len(token)).alias("end"))) for at, token in zip(places, tokens, strict=True)))

        return spans

    groups = []
    for tokens, gaps in KEPT.items():
        first, *more = (rf"\Q{token}\E" for token in tokens)
        pattern = "(?s)" + _bare(first) + "".join(f"{gap}{token}" for gap, token in zip(gaps, more, strict=True))
        seen = F.struct(F.regexp_extract(piece, pattern, 0).alias("found"), F.regexp_instr(piece, F.lit(pattern)).alias("at"))
        groups.append(F.when(F.contains(piece, F.lit(tokens[0])), once(seen, placed(tokens))))
    return F.array_sort(F.filter(F.flatten(F.array_compact(F.array(*groups))), lambda s: s.isNotNull()))


def shorten(line: Column) -> Column:
    """struct(text, cuts): the line with the inside of each very long string replaced by marks, and what the marks stand for.

    The JSON parser takes strings of 20 million characters at most.  What the
    rules look for inside a text (``KEPT``) is found in the raw string first and
    stays, so that it is seen wherever it stands; what lies between is cut, with
    its edges left.  Nothing is cut where a backslash stands in the seven
    characters before, so never inside an escape.  Lines below ``LONG_LINE``
    characters are as they were.
    """
    part = "struct<text:string,mark:string,body:string>"

    def whole(piece: Column) -> Column:
        return F.struct(piece.alias("text"), F.lit(None).cast("string").alias("mark"), F.lit(None).cast("string").alias("body"))

    def cut(piece: Column) -> Column:
        head = F.regexp_extract(F.left(piece, F.lit(EDGE)), r"(?s)^(.*[^\\]{7})", 1)
        tail = F.regexp_extract(F.right(piece, F.lit(EDGE)), r"(?s)[^\\]{7}(.*)$", 1)
        body = F.substring(piece, F.length(head) + 1, F.length(piece) - F.length(head) - F.length(tail))
        mark = F.concat(F.lit(_MARK[0]), F.xxhash64(body).cast("string"), F.lit(_MARK[1]))
        parts = F.struct(F.concat(head, mark, tail).alias("text"), mark.alias("mark"), body.alias("body"))
        return F.when((F.length(piece) > LONG_PIECE) & (head != "") & (tail != ""), parts).otherwise(whole(piece))

    def between(piece: Column, spans: Column) -> Column:
        upto = lambda i: F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda s: s.end)), F.lit(1))

        def gap(span: Column, i: Column) -> Column:
            token = F.greatest(span.at, upto(i))
            return F.array(cut(F.substring(piece, upto(i), F.greatest(span.at - upto(i), F.lit(0)))), whole(F.substring(piece, token, F.greatest(span.end - token, F.lit(0)))))

        rest = cut(F.substring(piece, upto(F.size(spans)), F.length(piece)))
        return F.concat(F.flatten(F.transform(spans, gap)), F.array(rest))

    def parts(piece: Column) -> Column:
        return F.when(F.length(piece) > LONG_PIECE, once(_plain(piece), lambda p: once(_tokens(p), lambda spans: between(p, spans)))).otherwise(F.array(whole(piece)).cast(f"array<{part}>"))

    pieces = F.transform(F.split(line, _QUOTE, -1), parts)
    short = once(pieces, lambda pieces: F.struct(
        F.array_join(F.transform(pieces, lambda some: F.array_join(F.transform(some, lambda p: p.text), "")), '"').alias("text"),
        F.transform(F.filter(F.flatten(pieces), lambda p: p.mark.isNotNull()), lambda p: F.struct(p.mark.alias("mark"), p.body.alias("body"))).alias("cuts")))
    none = F.array().cast("array<struct<mark:string,body:string>>")
    return F.when(F.length(line) > LONG_LINE, short).otherwise(F.struct(line.alias("text"), none.alias("cuts")))


def restore(text: Column, cuts: Column) -> Column:
    """A text of a shortened line with its marks replaced by what they stand for."""
    said = lambda body: F.get(F.from_json(F.concat(F.lit('["'), body, F.lit('"]')), "array<string>", _STRINGS), 0)
    return F.aggregate(cuts, text, lambda t, c: F.when(F.contains(t, c["mark"]), F.replace(t, c["mark"], said(c["body"]))).otherwise(t))


def parse(value: Column) -> Column:
    """The one JSON value that the text holds; null for none, several or trailing text."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]")))  # the parser alone stops after the first value
    return F.when(F.try_variant_get(wrapped, "$[1]", "variant").isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def is_object(v: Column) -> Column:
    return kind(v).startswith("OBJECT")


def is_array(v: Column) -> Column:
    return kind(v).startswith("ARRAY")


def text(v: Column, path: str) -> Column:
    """The string at ``path``; null for anything that isn't a string."""
    return F.when(kind(at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def string(v: Column) -> Column:
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def array(v: Column, path: str) -> Column:
    return F.when(is_array(at(v, path)), F.try_variant_get(v, path, "array<variant>"))


def number(v: Column, path: str) -> Column:
    return F.when(kind(at(v, path)).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(v, path, "double"))


def truthy(v: Column, path: str) -> Column:
    """Whether the value at ``path`` counts as true: not absent, null, false, zero or ''."""
    found, sort = at(v, path), kind(at(v, path))
    return (
        F.when(found.isNull() | sort.isin("", "VOID"), False)
        .when(sort == "BOOLEAN", F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False)))
        .when(sort == "STRING", F.try_variant_get(v, path, "string") != "")
        .when(sort.startswith("OBJECT") | sort.startswith("ARRAY"), True)
        .otherwise(F.coalesce(F.try_variant_get(v, path, "double") != 0, F.lit(False)))
    )
