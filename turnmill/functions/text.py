"""Text functions as column expressions.  Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All Unicode white space, as one character class (Java's \s is ASCII).
SPACE = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
# That class and all that is not in it, written so that one or two comparisons settle most characters.
GAP = rf"[\t-\x20\u00A0\u1680-\uFEFF&&[{SPACE}]]"
INK = rf"[!-~[^{SPACE}]]"
SHORT_WORDS = 15
TAIL_CHARS = 1600
HEAD_CHARS = 256
SLUG = r"^[a-z0-9]+(-[a-z0-9]+){1,4}$"


def trim_all(c: Column) -> Column:
    """From the first to the last character that is no white space: one look ahead and one back, however long its runs are."""
    return F.regexp_extract(c, rf"(?s)^{GAP}*+(.*{INK})", 1)


def one_line(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, f"{GAP}+", " "))


def word_count(c: Column) -> Column:
    trimmed = trim_all(c)  # outside of any branch, so that it is made once
    return F.size(F.split(trimmed, f"{GAP}+")) - (trimmed == "").cast("int")


def is_short_turn(c: Column, words: int = SHORT_WORDS) -> Column:
    return word_count(c) <= words


def tail(c: Column, n: int = TAIL_CHARS) -> Column:
    return F.right(c, F.lit(n))


def snippet(c: Column, limit: int = 120, mark: str = "...") -> Column:
    """One line of at most ``limit`` characters, the mark included.

    Nothing behind ``limit + 1`` characters other than white space can change it.
    """
    line = one_line(F.regexp_extract(c, rf"^{GAP}*+(?:{INK}{GAP}*+){{0,{limit + 1}}}+", 0))
    return F.when(F.length(line) > limit, F.concat(F.left(line, F.lit(limit - len(mark))), F.lit(mark))).otherwise(line)


def capped(c: Column, limit: int, mark: str = "…") -> Column:
    """The first ``limit`` characters, then the mark if anything was left out."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(mark))).otherwise(c)


def normalize_key(c: Column) -> Column:
    """Lower case; letters, digits and single spaces only; '' for nothing left."""
    return one_line(F.regexp_replace(F.lower(c), rf"[^a-z0-9\p{{L}}\p{{N}}{SPACE}]", ""))


def decode_project_dir(c: Column) -> Column:
    """A directory name back to a path: dashes part segments, a leading dash is the root."""
    body = F.regexp_replace(F.regexp_replace(c, "^-+|-+$", ""), "-+", "/")
    return F.when(c.startswith("-"), F.concat(F.lit("/"), body)).otherwise(body)


def base_name(path: Column, fallback: Column | str) -> Column:
    """The last segment of a path, or the fallback if it has none."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(fallback) if isinstance(fallback, str) else fallback)


def core_uuid(c: Column) -> Column:
    """The 36-character id inside ``sess_<id>`` or ``cli_<id>_x``, else the name itself."""
    found = F.regexp_extract(c, r"^(?:sess|cli)_([0-9a-fA-F-]{36})", 1)
    return F.when(found == "", c).otherwise(found)


def epoch_to_iso(seconds: Column) -> Column:
    """ISO-8601 UTC with milliseconds of a number of seconds; '' for null."""
    return F.coalesce(F.date_format(F.timestamp_millis(F.floor(seconds * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))


def sanitize_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")


def slug_words(name: Column) -> Column:
    """Two to five lower-case words of a document name, as an array.

    The first five words that end within ``HEAD_CHARS`` of a longer name are its
    words; only names with fewer there are read to their ends.
    """
    split = lambda x: F.split(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "-")
    words = lambda pieces: F.slice(F.filter(pieces, lambda w: w != ""), 1, 5)
    head = F.transform(F.array(split(F.left(name, F.lit(HEAD_CHARS)))), lambda p: words(F.slice(p, 1, F.size(p) - 1)))[0]  # the last word may go on
    longer = F.length(F.left(name, F.lit(HEAD_CHARS + 8))) == HEAD_CHARS + 8  # so the ending isn't in the head
    found = F.transform(F.array(head), lambda w: F.when(longer & (F.size(w) == 5), w).otherwise(words(split(F.regexp_replace(name, r"\.md$", "")))))[0]
    session = F.array(F.lit("session"))
    return F.transform(F.array(found), lambda w: F.when(F.size(w) == 0, F.concat(session, session)).when(F.size(w) == 1, F.concat(w, session)).otherwise(w))[0]


def suffix_slug(slug: Column, n: Column) -> Column:
    """``slug-n``; at five words the last one gives way."""
    words = F.split(slug, "-")
    return F.when(F.size(words) < 5, F.concat_ws("-", slug, n.cast("string"))).otherwise(F.concat_ws("-", F.array_join(F.slice(words, 1, 4), "-"), n.cast("string")))


def valid_slug(c: Column) -> Column:
    return c.rlike(SLUG)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def edited(content: Column, recorded: Column) -> Column:
    """True iff a hash is recorded, the content exists and differs from it."""
    return F.coalesce(content_hash(content) != recorded, F.lit(False))


def strip_fence(c: Column) -> Column:
    """The body of the first fenced block, whatever its tag; else the trimmed text."""
    body = F.regexp_extract(c, r"(?s)```[A-Za-z0-9_+-]*[^\S\n]*\n(.*?)```", 1)
    return F.when(c.rlike(r"(?s)```[A-Za-z0-9_+-]*[^\S\n]*\n(.*?)```"), trim_all(body)).otherwise(trim_all(c))


def parse_document(c: Column) -> Column:
    """struct(comment, title, body) of a document with an optional leading comment and ``# title``."""
    comment = F.regexp_extract(c, r"(?s)^\s*(<!--.*?-->)", 1)
    rest = trim_all(F.regexp_replace(c, r"(?s)^\s*<!--.*?-->", ""))
    title = F.regexp_extract(rest, r"^# ([^\n]*)", 1)
    return F.struct(comment.alias("comment"), trim_all(title).alias("title"), trim_all(F.regexp_replace(rest, r"^# [^\n]*\n?", "")).alias("body"))


def middle_cut(content: Column, budget: int | Column, note: tuple[str, str] = ("\n\n[... cut ", " characters here ...]\n\n")) -> Column:
    """struct(text, dropped): at most ``budget`` characters, head and tail kept around a note.

    The note states the exact number of dropped characters, whose digits change
    the note's own length; five substitutions settle it.  A budget below the note
    gives the note's beginning, with everything dropped.
    """
    before, after = note
    n, fixed, budget = F.length(content), len(before) + len(after), F.lit(budget)

    def kept(dropped: Column) -> Column:
        return budget - fixed - F.length(dropped.cast("string"))

    keep = kept(n - budget)
    for _ in range(5):
        keep = kept(n - keep)
    marked = lambda dropped: F.concat(F.lit(before), dropped.cast("string"), F.lit(after))
    head = F.ceil(keep / 2).cast("int")
    cut = F.concat(F.left(content, head), marked(n - keep), F.right(content, keep - head))
    short, none = F.left(marked(n), budget), keep <= 0
    return F.struct(
        F.when(n <= budget, content).when(none, short).otherwise(cut).alias("text"),
        F.when(n <= budget, 0).when(none, n).otherwise(n - keep).cast("long").alias("dropped"),
    )
