"""Repair of conversations by a generalised LR parser with edits.

The role grammar's LR table is built from its productions.  A conversation is
parsed on a graph-structured stack: all stacks that the edits so far allow are
kept at once, equal stack tops are one node, which keeps the least (cost, audit)
and a link to each node that it may stand on.  A row is kept, reroled or deleted,
and rows may be inserted anywhere, each at its price.

What a stretch of rows does to the stack tops is a small table (from each top to
each top the cheapest edits), and the tables of neighbouring stretches combine
in any grouping.  So a conversation of any length is parsed in stretches by many
tasks, which are then combined in order.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched, groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from turnmill.llm.scratch import materialise

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1  # costs; keeping a row costs nothing
ROLES = {"u": "user", "a": "assistant"}  # that rows are inserted as and reroled to, by initial
#: A talk is empty or holds pairs of a user's and an assistant's turn, maybe after one of the system.
TALK = [("talk", ()), ("talk", ("turns",)), ("talk", ("s", "turns")), ("turns", ("pair",)), ("turns", ("turns", "pair")), ("pair", ("u", "a"))]

LONG_ROWS, LONG_CHARS = 5_000, 16 << 20  # of a conversation beyond which it is parsed in stretches
STRETCH = 1_000  # rows

_SPACES = " \t\n\x0b\x0c\r"


class RoleTable:
    """LR(0) table of a grammar, closed into moves of stack tops.

    ``moves[top][symbol]`` are the tops after a shift and all reductions that
    follow; ``ends`` are the tops at which the talk may end.  The stack's graph
    has one node a state, as equal tops merge; its links are found once, by
    shifting and reducing until neither adds any.
    """

    def __init__(self, productions: list[tuple[str, tuple[str, ...]]]):
        start, heads = productions[0][0], {head for head, _ in productions}

        def closed(items: set) -> frozenset:
            items, todo = set(items), list(items)
            while todo:
                rule, dot = todo.pop()
                body = productions[rule][1]
                new = {(i, 0) for i, (head, _) in enumerate(productions) if dot < len(body) and head == body[dot]} - items
                items |= new
                todo += new
            return frozenset(items)

        first = closed({(i, 0) for i, (head, _) in enumerate(productions) if head == start})
        states, goto, todo = {first: 0}, {}, [first]
        while todo:
            items = todo.pop()
            for symbol in {productions[r][1][d] for r, d in items if d < len(productions[r][1])}:
                after = closed({(r, d + 1) for r, d in items if productions[r][1][d : d + 1] == (symbol,)})
                if after not in states:
                    states[after] = len(states)
                    todo.append(after)
                goto[states[items], symbol] = states[after]
        reduces = {n: [r for r, d in items if d == len(productions[r][1]) and productions[r][0] != start] for items, n in states.items()}
        self.ends = {n for items, n in states.items() if any(productions[r][0] == start and d == len(productions[r][1]) for r, d in items)}
        links: dict[int, set[int]] = defaultdict(set)  # state -> states it may stand on

        def settle(top: int) -> set[int]:
            out = set() if reduces[top] else {top}
            for rule in reduces[top]:
                head, body = productions[rule]
                bases = {top}
                for _ in body:
                    bases = set().union(*(links[b] for b in bases))
                for base in bases:
                    links[goto[base, head]].add(base)
                    out |= settle(goto[base, head])
            return out

        self.moves: dict[int, dict[str, frozenset[int]]] = {}
        size = -1
        while size != (size := sum(map(len, links.values())) + sum(len(t) for m in self.moves.values() for t in m.values())):
            tops, self.moves = [0], {}
            for top in tops:
                moves = self.moves.setdefault(top, {})
                for (state, symbol), after in goto.items():
                    if state == top and symbol not in heads:
                        links[after].add(top)
                        moves[symbol] = frozenset(settle(after))
                        tops += sorted(moves[symbol] - set(tops))
        self.tops = sorted(self.moves)


_TABLE = RoleTable(TALK)
Tops = dict[int, tuple[int, str]]  # stack top -> the least (cost, audit)


def _offer(tops: Tops, top: int, cost: int, audit: str) -> bool:
    if top not in tops or (cost, audit) < tops[top]:
        tops[top] = (cost, audit)
        return True
    return False


def _inserted(tops: Tops) -> Tops:
    """Insert turns before what comes next, as often as it helps."""
    while any([_offer(tops, to, cost + INSERT, audit + "I") for top, (cost, audit) in list(tops.items()) for x in ROLES for to in _TABLE.moves[top].get(x, ())]):
        pass
    return tops


def _row(tops: Tops, initial: str, bad: bool, truncated: bool, copies: int) -> Tops:
    """One row, kept, reroled or deleted, and its further copies, which are deleted."""
    after: Tops = {}
    for top, (cost, audit) in tops.items():
        _offer(after, top, cost + DELETE, audit + "D")
        if not bad:
            for to in _TABLE.moves[top].get(initial, ()):
                _offer(after, to, cost + TRUNCATED * truncated, audit + "K")
            for x in ROLES:
                for to in _TABLE.moves[top].get(x, ()):
                    _offer(after, to, cost + REROLE + TRUNCATED * truncated, audit + "R")
    if copies > 1:
        _inserted(after)
        after = {top: (cost + DELETE * (copies - 1), audit + "D" * (copies - 1)) for top, (cost, audit) in after.items()}
    return _inserted(after)


def parse(rows: Iterable[tuple[str, bool, bool, int]], entry: int = 0) -> Tops:
    """Tops after rows of (role initial, must go, truncated, copies), from one top."""
    tops = _inserted({entry: (0, "")})
    for row in rows:
        tops = _row(tops, *row)
    return tops


def best_end(tops: Tops) -> tuple[int, str]:
    return min(found for top, found in tops.items() if top in _TABLE.ends)


@lru_cache(maxsize=1 << 16)
def _short(rows: tuple) -> tuple[int, str]:
    return best_end(parse(rows))


class Repaired:
    """The repaired rows in order, as the audit's letters and the rows come along."""

    def __init__(self, audit: str):
        self.letters, self.last, self.first = iter(audit), "", True

    def _out(self, role: str | None, text: str) -> str:
        role = role if role is not None else ROLES["a" if self.last == "u" else "u"]
        line, self.last, self.first = ("" if self.first else "\n") + f"{role}:{text}", role[:1], False
        return line

    def row(self, role: str, text: str) -> str:
        """What stands for a row, and for the turns inserted before it."""
        out = ""
        for letter in self.letters:
            if letter == "I":
                out += self._out(None, "")
            else:
                return out + ("" if letter == "D" else self._out(role if letter == "K" else None, text))
        raise ValueError("more rows than letters")

    def rest(self) -> str:
        return "".join(self._out(None, "") for _ in self.letters)


class Counts:
    """Faults of a stretch of rows in order; neighbouring stretches add up."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "first_turn", "last_turn", "least", "most")
    SCHEMA = "blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, first_turn long, last_turn long, least long, most long"

    def __init__(self, *values):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.first_turn = self.last_turn = self.least = self.most = None
        for name, value in zip(self.FIELDS, values):
            setattr(self, name, value)

    def _follow(self, initial: str) -> None:
        if self.first is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial

    def row(self, turn: int | None, initial: str, blank: bool, seen: bool, truncated: bool, copies: int) -> bool:
        """Count a row; whether it must go (its further copies always must)."""
        self._follow(initial)
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - (not seen)
            self.truncated += bool(truncated and not seen)
        self.illegal += copies - 1
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
                self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.most = turn, turn
            self.least = turn if self.least is None else self.least
        return blank or seen

    def add(self, o: Counts) -> None:
        """The counts of the rows that follow."""
        if o.first is not None:
            self._follow(o.first)
            self.last = o.last
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(o, name))
        if o.first_turn is not None:
            self.turns -= o.first_turn == self.last_turn
            self.first_turn = o.first_turn if self.first_turn is None else self.first_turn
            self.last_turn, self.most = o.last_turn, o.most
            self.least = o.least if self.least is None else self.least

    def shown(self) -> tuple[int, ...]:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


# ---- Spark ----

_SHOWN = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ORDER = ("turn", "role", "text")


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with known damage by ``crc32(conv:turn) % 20`` (nulls are one space): 0 drops a row, 1 empties its
    text, 2 removes its sentence ends, 3 repeats it, 4 makes its role user.  ``copies`` tells how often the row stands there now."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced(text_col), "[.!?]", "")).otherwise(spaced(text_col))
    return rows.select(
        F.col(conv_col).alias(conv_col), F.col(turn_col).alias(turn_col), F.when(kind == 4, ROLES["u"]).otherwise(spaced(role_col)).alias(role_col),
        text.alias(text_col), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(first column, rows of the others) of the stretches of equal first columns; the rows are read as they come."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, some in groupby(rows, key=lambda r: r[0]):
        yield key, (row[1:] for row in some)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    for some in batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema, strict=True)], schema=schema)


def _whole(batches: Iterator[pa.RecordBatch], schema: pa.Schema, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Conversations below the bounds, one after the other."""

    def one(conv: object, rows: Iterator[tuple]) -> tuple:
        counts, symbols, kept, seen = Counts(), [], [], set()
        for turn, role, text, blank, truncated, copies in rows:
            if copies:
                again = (role, text) in seen
                seen.add((role, text))
                symbols.append((role[:1], counts.row(turn, role[:1], blank, again, truncated, copies), truncated, copies))
                kept += [(role, text)] * copies
        cost, audit = _short(tuple(symbols)) if len(symbols) <= 32 else best_end(parse(symbols))
        lines = Repaired(audit)
        repaired = "".join([lines.row(*row) for row in kept]) + lines.rest()
        return (conv, *counts.shown(), cost, audit, hashlib.sha256(repaired.encode()).hexdigest(), *([repaired] if with_text else []))

    return _batches((one(*group) for group in _grouped(batches)), schema)


def _stretches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, stretch: int) -> Iterator[pa.RecordBatch]:
    """Counts and table of each ``stretch`` rows of a conversation in one task."""
    part = TaskContext.get().partitionId()

    def found() -> Iterator[tuple]:
        for conv, rows in _grouped(batches):
            for number in range(1 << 62):
                some = list(islice(rows, stretch))
                if not some:
                    break
                counts, symbols = Counts(), []
                for turn, role, _, blank, truncated, copies, seen in some:
                    symbols.append((role[:1], counts.row(turn, role[:1], blank, seen, truncated, copies), truncated, copies))
                table = [(entry, to, *best) for entry in _TABLE.tops for to, best in parse(symbols, entry).items()]
                yield (conv, part, number, *(getattr(counts, f) for f in Counts.FIELDS), *zip(*table))

    return _batches(found(), schema, 50)


def _combined(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Counts, cost and audit of each conversation from its stretches in order."""

    def one(conv: object, stretches: Iterator[tuple]) -> tuple:
        counts, tops = Counts(), _inserted({0: (0, "")})
        for _, _, *rest in stretches:
            counts.add(Counts(*rest[: len(Counts.FIELDS)]))
            after: Tops = {}
            for entry, to, cost, audit in zip(*rest[len(Counts.FIELDS) :], strict=True):
                if entry in tops:
                    _offer(after, to, tops[entry][0] + cost, tops[entry][1] + audit)
            tops = after
        cost, audit = best_end(tops)
        return (conv, *counts.shown(), cost, audit)

    return _batches((one(*group) for group in _grouped(batches)), schema, 1)


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema, with_text: bool) -> Iterator[pa.RecordBatch]:
    """The repaired rows of each conversation, hashed as they come after its audit."""

    def one(conv: object, rows: Iterator[tuple]) -> tuple:
        lines, sha, whole = Repaired(next(rows)[-1]), hashlib.sha256(), []

        def put(piece: str) -> None:
            sha.update(piece.encode())
            if with_text:
                whole.append(piece)

        for _, _, role, text, copies, _ in rows:
            for _ in range(copies):
                put(lines.row(role, text))
        put(lines.rest())
        return (conv, sha.hexdigest(), *(["".join(whole)] if with_text else []))

    return _batches((one(*group) for group in _grouped(batches)), schema, 1)


def repair_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    copies_col: str | None = None, with_text: bool = False, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS, stretch: int = STRETCH,
) -> DataFrame:
    """The cheapest edits that give each conversation the roles ``(s?(ua)+)?``.

    Rows stand by turn (nulls first), then role and text.  A row's first fault
    counts: blank, duplicate (role and text seen before), truncated (its last
    character that isn't white space ends no sentence).  Blank and duplicate rows
    are deleted (3); others are kept, reroled to user or assistant (2) or
    deleted, and cost 1 more if truncated and not deleted; empty turns are
    inserted (2).  Of the cheapest edits those whose initials (D, I, K, R) come
    first as text are taken; they determine the repaired rows.

    Returns for each conversation ``gaps`` (turn numbers missing between its
    first and last, nulls ignored), ``blank``, ``duplicate``, ``truncated``,
    ``illegal`` (neighbours whose role initials are none of su, ua, au), ``cost``,
    ``audit`` and ``repaired_sha256`` of the lines ``role:text``; ``with_text``
    adds ``repaired``.  Nulls in role and text are one space; a null conversation
    id is one conversation; a role without an initial can't be kept; other
    columns are ignored; an empty table gives no rows.  ``copies_col`` tells how
    often a row stands there; conversations that are left without rows have zeros.

    Conversations beyond ``long_rows`` or ``long_chars`` are parsed in stretches of
    ``stretch`` rows by many tasks, copies of a row at once; only their digest is made by one
    task, as a SHA-256 must be, over rows that stream through it in order.
    """
    conv = rows.schema[conv_col]
    text, role = F.coalesce(F.col(text_col), F.lit(" ")), F.coalesce(F.col(role_col), F.lit(" "))
    last = F.right(F.rtrim(text, F.lit(_SPACES)), F.lit(1))
    copies = F.col(copies_col).cast("long") if copies_col else F.lit(1).cast("long")
    known = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.when(copies > 0, text).otherwise("").alias("text"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"), copies.alias("copies"),
    )
    key = T.StructField("conv", conv.dataType)
    shown = [*(T.StructField(c, T.LongType()) for c in _SHOWN), T.StructField("audit", T.StringType())]
    digest = [T.StructField("repaired_sha256", T.StringType()), *([T.StructField("repaired", T.StringType())] if with_text else [])]

    sizes = known.groupBy("conv").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.length("text")).alias("chars"))
    huge = materialise(sizes.filter((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select(F.col("conv").alias("huge")), "huge")
    some = not huge.isEmpty()
    is_huge = F.col("conv").eqNullSafe(F.col("huge"))

    in_order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    out = T.StructType([key, *shown, *digest])
    short = known.join(huge, is_huge, "left_anti") if some else known
    result = short.repartition("conv").sortWithinPartitions(*in_order).mapInArrow(lambda b, s=to_arrow_schema(out): _whole(b, s, with_text), out)
    if some:
        result = result.union(_long(known.join(huge, is_huge, "left_semi"), in_order, T.StructType([key, *shown]), T.StructType([key, *digest]), with_text, stretch))
    return result.withColumnRenamed("conv", conv_col)


def _long(known: DataFrame, in_order: list[Column], shown: T.StructType, digest: T.StructType, with_text: bool, stretch: int) -> DataFrame:
    """Conversations beyond the bounds: copies counted, stretches parsed where range partitioning puts them, tables combined."""
    key = shown.fields[0]
    merged = known.filter("copies > 0").groupBy("conv", *_ORDER, "blank", "truncated").agg(F.sum("copies").alias("copies"))
    merged = materialise(merged.withColumn("digest", F.sha2("text", 256)).withColumn("at", F.struct(F.col("turn").isNotNull().alias("later"), F.col("turn").alias("turn"))), "merged")
    firsts = merged.groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.min("at").alias("_first"))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    # written first, as range partitioning reads its input twice (once for a sample)
    placed = materialise(merged.join(firsts, same).select("conv", *_ORDER, "blank", "truncated", "copies", (F.col("at") > F.col("_first")).alias("seen")), "placed")
    parts = T.StructType([
        key, T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType()), *T._parse_datatype_string(Counts.SCHEMA).fields,
        *(T.StructField(c, T.ArrayType(kind)) for c, kind in (("entry", T.IntegerType()), ("to", T.IntegerType()), ("cost", T.LongType()), ("audit", T.StringType()))),
    ])
    stretches = placed.repartitionByRange(*in_order).sortWithinPartitions(*in_order).mapInArrow(lambda b, s=to_arrow_schema(parts): _stretches(b, s, stretch), parts)
    stretches = materialise(stretches, "stretches")
    found = stretches.repartition("conv").sortWithinPartitions("conv", "part", "number").mapInArrow(lambda b, s=to_arrow_schema(shown): _combined(b, s), shown)
    found = materialise(found, "repairs")
    audits = found.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), "audit")
    lines = audits.union(placed.select("conv", F.lit(1), *_ORDER, "copies", F.lit(None).cast("string")))
    order = [in_order[0], F.col("kind"), *in_order[1:]]
    hashed = lines.repartition("conv").sortWithinPartitions(*order).mapInArrow(lambda b, s=to_arrow_schema(digest): _digests(b, s, with_text), digest)
    hashed = hashed.withColumnRenamed("conv", "_conv")
    return found.join(hashed, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
