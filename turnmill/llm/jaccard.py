"""Exact Jaccard join of word-shingle sets by parity sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnmill.llm.components import connected_components
from turnmill.llm.scratch import materialise
from turnmill.llm.wordhash import BLANK_WORD, LOWER, Texts, Words, gram_hashes, mix, slices

SHINGLE = 5
PERCENT = 80  # two documents link when 100 * common >= PERCENT * all shingles
COMMON = 5  # pieces that linked sets are sure to share; see ``sketch_keys``
BLOCK_TOKENS = 1_000_000  # shingles of a group that one task holds at once, twice at most

_NULL_ID = 2**63 - 1
_SLICE = 1 << 20  # bytes of text whose shingles a worker holds at once
_LEVEL = np.uint64(31)  # the low bits of a key tell its size band
_WHOLE = 1 << 40  # pieces of a band of small sets: each shingle is a piece


def shingle_sets(words: Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row of fewer words is one shingle, one without words none."""
    grams, first, out = words.grams(SHINGLE), words.first.tolist(), []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(gram_hashes(words.hash[a:b], b - a)[:1])
        else:
            out.append(grams[:0])
    return out


def set_name(hashes: np.ndarray) -> np.uint64:
    """A 64-bit name of a set: equal sets have equal names."""
    n = np.uint64(len(hashes))
    return mix(np.array([np.bitwise_xor.reduce(hashes) ^ mix(hashes.sum(dtype=np.uint64)[None] + n)[0]], dtype=np.uint64))[0]


def _band(size: int) -> int:
    """Size band: 0 below 8 shingles, then one for each factor of 4."""
    band, upper = 0, 8
    while size >= upper:
        band, upper = band + 1, upper * 4
    return band


def sketch_keys(hashes: np.ndarray) -> np.ndarray:
    """Join keys of a set: equal pieces of parity sketches, one pigeonhole scheme for each size band.

    A sketch XORs the hash of each shingle into the piece that the hash picks, so
    two sketches differ in no more pieces than the sets' symmetric difference has
    shingles.  For linked sets that is at most a quarter of either size, d.  A set
    of k non-empty pieces thus shares k - d of them with any partner, and by
    keeping the first d + COMMON in the order of pieces, both keep COMMON shared
    ones.  Pieces hold 2.5 shingles at most on average, so k - d exceeds COMMON
    by many deviations; bands below 128 shingles use single shingles, where it
    holds always.  Sets of 4 to 7 link only to themselves with one shingle more or
    less: their keys are the whole XOR and the XOR without each one.  A set whose
    partners may be in the next band has keys in both.
    """
    n = len(hashes)
    if n < 4:
        return np.zeros(0, dtype=np.uint64)  # linked to equal sets alone
    own, out = _band(n), []
    for band in range(own, _band(n + n // 4) + 1):
        tag, salt = np.uint64(band), np.uint64(band * 0x9E3779B97F4A7C15 % 2**64)
        if band == 0:
            whole = np.bitwise_xor.reduce(hashes)
            out.append(mix(np.r_[whole, whole ^ hashes]) & ~_LEVEL)
            continue
        upper = 8 * 4**band
        pieces = _WHOLE if upper <= 128 else int(upper / 2.5)
        mixed = mix(hashes + salt)
        piece = mixed % np.uint64(pieces)
        order = np.argsort(piece)
        piece = piece[order]
        start = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])[: n // 4 + COMMON + 1]
        used = n if len(start) <= n // 4 + COMMON else start[-1]
        start = start[: n // 4 + COMMON]
        parity = np.bitwise_xor.reduceat(mix(mixed[order[:used]]), start)
        out.append(mix(parity ^ mix(piece[start] * np.uint64(64) + tag)) & ~_LEVEL | tag)
    return np.concatenate(out)


def bit_sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Parity bit sketches (sets x words of 64 bits): each shingle flips one bit."""
    out = np.zeros((len(sets), bits // 64), dtype=np.uint64)
    mask = np.uint64(bits - 1)
    step = max(1, (4 << 20) // bits)
    for i in range(0, len(sets), step):
        some = sets[i : i + step]
        place = np.repeat(np.arange(len(some), dtype=np.int64) * bits, [len(s) for s in some]) + (np.concatenate(some) & mask).astype(np.int64)
        parity = (np.bincount(place, minlength=len(some) * bits) & 1).astype(np.uint8)
        out[i : i + step] = np.packbits(parity.reshape(len(some), bits), axis=1).view(np.uint64)
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def sketch_bits(size: int) -> int:
    """Bits of a set's sketch: a power of two, two to four for each shingle."""
    return max(64, 1 << int(2 * size - 1).bit_length())


def near_members(size: np.ndarray, sketches: list[np.ndarray], side: np.ndarray, cross: bool) -> np.ndarray:
    """Whether any other member's sketch allows a link with each member.

    Sizes and Hamming distances bound a pair's similarity from above.  A sketch
    of twice the bits is folded by XOR to its partner's width.  With ``cross``
    only pairs of unequal ``side`` are compared.  One row of distances is held at
    a time, and a pair of which both are known to have a partner isn't compared.
    """
    alive, widths = np.zeros(len(size), dtype=bool), {}
    for i in np.argsort(size, kind="stable").tolist():
        widths.setdefault(len(sketches[i]), []).append(i)
    matrix = {w: np.stack([sketches[i] for i in own]) for w, own in widths.items()}
    for w, own in widths.items():
        partners = [(np.array(own), matrix[w], True)]
        if 2 * w in widths:
            wide = matrix[2 * w]
            partners.append((np.array(widths[2 * w]), wide[:, :w] ^ wide[:, w:], False))
        for x, i in enumerate(own):
            for other, rows, same in partners:
                lo = x + 1 if same else 0
                to = int(np.searchsorted(size[other], size[i] * 100 // PERCENT, side="right"))
                at = np.arange(lo, max(lo, to))
                if alive[i]:
                    at = at[~alive[other[at]]]
                if cross:
                    at = at[side[other[at]] != side[i]]
                if not len(at):
                    continue
                distance = np.bitwise_count(rows[at] ^ matrix[w][x]).sum(axis=1, dtype=np.int64)
                fit = other[at[distance * (100 + PERCENT) <= (size[i] + size[other[at]]) * (100 - PERCENT)]]
                alive[fit] = True
                alive[i] |= len(fit) > 0
    return alive


def common_counts(sets: list[np.ndarray], asked: np.ndarray, held: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, shingles that set i has in common with each set) of every i in ``asked``; exact for the sets in ``held``, 0 for others.

    Each shingle lists the sets that hold it, so that a set takes a few passes over
    its shingles' lists, not one a partner.  If ``asked`` and ``held`` are the same,
    a pair is counted at the first of its two sets only.
    """
    own, each = asked is held, np.array([len(sets[j]) for j in held])
    known, code = np.unique(np.concatenate([sets[j] for j in held]), return_inverse=True)
    holder = np.repeat(held, each)[np.argsort(code, kind="stable")]
    end = np.cumsum(np.bincount(code, minlength=len(known)))
    start = np.r_[0, end[:-1]]
    for i in asked.tolist():
        at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
        at = at[known[at] == sets[i]]
        if own:
            start[at] += 1  # the list's first one is i itself
        n = end[at] - start[at]
        ends = np.cumsum(n)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[at] - (ends - n), n)
        yield i, np.bincount(holder[place], minlength=len(sets))


def connected_sets(sets: list[np.ndarray]) -> np.ndarray:
    """The least index of each set's component of links, found by visiting only sets that no visited one has reached.

    A visit counts what a set has in common with the sets that are left, so a group
    of near copies takes one visit, and the lists shrink as sets are reached.
    """
    size, part = np.array([len(s) for s in sets]), np.arange(len(sets))
    left = np.ones(len(sets), dtype=bool)

    def listed() -> tuple[np.ndarray, ...]:
        held = np.flatnonzero(left)
        known, code = np.unique(np.concatenate([sets[j] for j in held]), return_inverse=True)
        holder = np.repeat(held, size[held])[np.argsort(code, kind="stable")]
        end = np.cumsum(np.bincount(code, minlength=len(known)))
        return known, holder, np.r_[0, end[:-1]], end

    indexed, (known, holder, start, end) = len(sets), listed()
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed], todo = False, [seed]
        while todo and (rest := int(left.sum())):
            if 2 * rest < indexed:
                indexed, (known, holder, start, end) = rest, listed()
            i = todo.pop()
            at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
            at = at[known[at] == sets[i]]
            n = end[at] - start[at]
            ends = np.cumsum(n)
            place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[at] - (ends - n), n)
            common = np.bincount(holder[place], minlength=len(sets))
            reached = np.flatnonzero(left & (common > 0) & (100 * common >= PERCENT * (size[i] + size - common)))
            left[reached], part[reached] = False, seed
            todo += reached.tolist()
    return part


def group_links(names: np.ndarray, sets: list[np.ndarray], side: np.ndarray, cross: bool, copies: np.ndarray, centers: list[list[int]], center: int, counts: bool = True) -> tuple[list[tuple[int, int]], np.ndarray]:
    """What links connect in a group, as a star from each part's least name, and the linked copies of each set.

    Without ``counts`` only what connects the sets is verified (see ``connected_sets``), else every pair.  Two sets may meet in several groups;
    their link is counted in the one with the least of the ``centers`` that both have.
    """
    size = np.array([len(s) for s in sets])
    part, found = np.arange(len(sets)), np.zeros(len(sets), dtype=np.int64)
    elsewhere: dict[int, list[int]] = {}
    for i, own in enumerate(centers):
        for c in own:
            if c < center:
                elsewhere.setdefault(c, []).append(i)
    asked = held = np.arange(len(sets))
    if cross:
        asked, held = np.flatnonzero(side == side[0]), np.flatnonzero(side != side[0])
    if not counts:
        part = connected_sets(sets)
    for i, common in common_counts(sets, asked, held) if counts and len(held) else ():
        link = (common > 0) & (100 * common >= PERCENT * (size[i] + size - common))
        to = np.flatnonzero(link)
        met = part[to]
        if (met != part[i]).any():
            part[np.isin(part, np.append(met, part[i]))] = min(int(met.min()), int(part[i]))
        for c in centers[i]:
            if c < center:
                link[elsewhere[c]] = False
        to = np.flatnonzero(link)
        found[i] += copies[to].sum()
        found[to] += copies[i]
    together: dict[int, list[int]] = {}
    for i, k in enumerate(part.tolist()):
        together.setdefault(k, []).append(int(names[i]))
    return [(least, name) for own in together.values() for least in (min(own),) for name in own if name != least], found


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            sets = shingle_sets(Words(Texts(part.column(1)), BLANK_WORD, LOWER))
            names = [int(set_name(s).view(np.int64)) if len(s) else None for s in sets]
            sketch = [bit_sketches([s], sketch_bits(len(s)))[0].tobytes() if len(s) >= 4 else None for s in sets]
            found = [pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), *found, *part.columns[2:]], names=["doc", "node", "n", "sketch", *part.schema.names[2:]])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            keys, names = [], []
            for s in shingle_sets(Words(Texts(part.column(0)), BLANK_WORD, LOWER)):
                found = sketch_keys(s)
                if len(found):
                    keys.append(found)
                    names.append(np.full(len(found), set_name(s)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, names)], names=["key", "node"])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list, list[list]]]:
    """Rows that are equal in their first ``keys`` columns, as (key, columns' values), from sorted batches."""
    group, rows = None, []
    for batch in batches:
        for *values, in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if values[:keys] != group:
                if rows:
                    yield group, list(map(list, zip(*rows, strict=True)))
                group, rows = values[:keys], []
            rows.append(values[keys:])
    if rows:
        yield group, list(map(list, zip(*rows, strict=True)))


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (center, one, other): the members that some member's sketch allows a link with."""
    for key, (block, node, doc, n, sketch) in _runs(batches, 3):
        side, size = np.array(block), np.array(n)
        alive = np.flatnonzero(near_members(size, [np.frombuffer(s, dtype=np.uint64) for s in sketch], side, key[1] != key[2])).tolist()
        if alive:
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([k] * len(alive), t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array([block[i] for i in alive], pa.int32()), pa.array([node[i] for i in alive], pa.int64()), pa.array([doc[i] for i in alive], pa.int64())],
                names=["center", "one", "other", "block", "node", "doc"])


def _compare(batches: Iterator[pa.RecordBatch], counts: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (center, one, other): verified links that connect the members of each block pair (n is 0), and a member's number of links (a is b)."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, dict]]:
        group, members = None, {}
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                sets = shingle_sets(Words(Texts(part.column(7)), BLANK_WORD, LOWER))
                for *key, block, node, copies, centers, s in zip(*(c.to_pylist() for c in part.columns[:7]), sets, strict=True):
                    if key != group:
                        if members:
                            yield group, members
                        group, members = key, {}
                    if len(s) and int(set_name(s).view(np.int64)) == node:  # an id may stand for several texts
                        members[node] = (s, block, copies, centers)
        if members:
            yield group, members

    for key, members in sets_of(batches):
        if len(members) > 1:
            sets, block, copies, centers = zip(*members.values(), strict=True)
            names = np.array(list(members))
            edges, found = group_links(names, list(sets), np.array(block), key[1] != key[2], np.array(copies), list(centers), key[0], counts)
            rows = [*((a, b, 0) for a, b in edges), *((k, k, n) for k, n in zip(names.tolist(), found.tolist(), strict=True) if n)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["a", "b", "n"])


def candidate_groups(entries: DataFrame) -> DataFrame:
    """(center, node) groups such that linked sets are together in one.

    A key that two sets share is a bucket, and its center is the member that is
    in most buckets (so one original gathers all its copies).  Every set leaves
    the COMMON - 1 most populous of its buckets, as linked sets share COMMON: a
    passage that many unlike documents hold seldom brings them together.  Repeated
    rows count once; buckets of equal size are ordered by key and members of equal
    degree by node, so ties are settled alike in every run; no entries give no groups.
    """
    ends = entries.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    shared = materialise(ends.filter("least <> most").select("key"), "shared")
    buckets = materialise(entries.join(shared, "key").distinct(), "buckets")
    # aggregates of a key are written before they are joined back, so that Spark can split a hot key's join
    sizes = materialise(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("members")), "sizes")
    band = F.col("key").bitwiseAND(31)
    by_node = Window.partitionBy("node")
    ranked = buckets.join(sizes, "key").withColumn("degree", F.count(F.lit(1)).over(by_node))
    order = Window.partitionBy("node", band).orderBy(F.desc("members"), F.desc("key"))
    ranked = materialise(ranked.select("key", "node", "degree", F.row_number().over(order).alias("place")), "ranked")
    centers = materialise(ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("best")).select("key", F.col("best.node").alias("center")), "centers")
    placed = ranked.filter((band == 0) | (F.col("place") > COMMON - 1)).select("key", "node").join(centers, "key")
    return placed.select("center", "node").distinct()


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_links: bool = False) -> DataFrame:
    """Exact near-duplicate components of whole texts.

    Words are runs of non-blank characters, A-Z lower-cased; a document's set is
    its distinct ``SHINGLE``-word shingles (fewer words: the whole sequence as
    one).  Documents link when their sets' Jaccard similarity is ``PERCENT`` % or
    more.  Equal sets are one node; nodes meet by shared sketch pieces, and the
    groups' members are compared block against block inside tasks, which verify
    every pair and emit links that connect them and counts of links, never all pairs.

    Returns id, ``n_shingles`` and ``component_id``, the smallest id reachable by
    links, itself included; with ``with_links`` also ``n_links``, the number of
    other rows that link with the row, its copies included.  A null or empty text has no shingles and is linked
    with nothing; a null id counts as largest (as does 2**63 - 1, the one number
    that stands for it) and its row's component is null only if no row of the
    component has an id; rows of equal ids are judged each by its text; an empty
    table gives no rows; other columns are ignored.  ``id_col`` is an integer column.
    """
    known = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    found = _classes(docs, id_col, text_col, with_links)
    return found.select(known("doc").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), known("component").alias("component_id"), *(["n_links"] if with_links else []))


def first_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their near duplicates: of each component the row with the smallest id stays.

    Rows, not ids, are chosen: of equal ids, and of null ids (the largest), the
    text's hash decides.  Rows equal in id and text are one document, of which one
    row stays; a document without shingles has no near duplicates.  All columns
    are kept, whatever their names; texts are shuffled once; an empty table gives no rows.
    """
    key = lambda: (F.xxhash64(id_col, text_col).alias("key1"), F.xxhash64(F.lit("row"), text_col, id_col).alias("key2"))
    found = materialise(_classes(docs.select(id_col, text_col, *key()), id_col, text_col, False, ("key1", "key2")), "classes")
    first = found.filter("root is not null").groupBy("root").agg(F.min(F.struct("doc", "key1", "key2")).alias("first")).select("first.key1", "first.key2")
    kept = first.union(found.filter("root is null").select("key1", "key2").distinct())
    rows = docs.select(*key(), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(kept, ["key1", "key2"]).dropDuplicates(["key1", "key2"]).select("row.*")


def _classes(docs: DataFrame, id_col: str, text_col: str, with_links: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc (a null id is ``_NULL_ID``), n, component, root (the component's node; null without shingles), n_links, and the LONG columns ``keep``."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), F.col(text_col).alias("text"), *keep)
    base = materialise(rows.mapInArrow(_names, ", ".join(["doc long, node long, n long, sketch binary", *(f"{c} long" for c in keep)])), "sets")
    first = base.filter("node is not null").groupBy("node").agg(F.min("doc").alias("first"))
    sketched = base.filter("sketch is not null").groupBy("node").agg(F.min("doc").alias("doc"), F.max("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))

    groups = materialise(candidate_groups(rows.select("text").mapInArrow(_entries, "key long, node long")), "groups")
    members = groups.join(sketched.drop("copies"), "node")
    totals = groups.join(sketched.select("node", "n"), "node").groupBy("center").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    totals = materialise(totals, "totals")  # a table of its own, so that Spark can split a hot center's join
    blocks = F.ceil(F.col("total") / BLOCK_TOKENS).cast("int")
    members = members.join(totals, "center").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = members.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("one", F.least("block", "with")).withColumn("other", F.greatest("block", "with"))
    keys = ["center", "one", "other"]
    screened = pairs.select(*keys, "block", "node", "doc", "n", "sketch").repartition(*keys).sortWithinPartitions(*keys)
    alive = materialise(screened.mapInArrow(_screen, "center long, one int, other int, block int, node long, doc long"), "alive")
    # texts are long and ``alive`` grows with the corpus, so it is never sent to all tasks
    met = alive.groupBy("node").agg(F.collect_set("center").alias("centers")).join(sketched.select("node", "copies"), "node")
    known_of = alive.join(met, "node")
    placed = rows.select("doc", "text").join(known_of.hint("merge"), "doc").select(*keys, "block", "node", "copies", "centers", "text").repartition(*keys).sortWithinPartitions(*keys)
    links = materialise(placed.mapInArrow(lambda batches: _compare(batches, with_links), "a long, b long, n long"), "links")
    roots = connected_components(links.select("a", "b"))

    least = roots.join(first, "node").groupBy("root").agg(F.min("first").alias("component"))
    found = roots.join(least, "root").select("node", "root", "component")
    out = base.drop("sketch").join(first.select("node", "first"), "node", "left").join(found, "node", "left")
    counts = []
    if with_links:
        copies = base.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
        near = links.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("near"))
        out = out.join(copies.join(near, "node", "left"), "node", "left")
        counts = [F.coalesce(F.col("copies") - 1 + F.coalesce("near", F.lit(0)), F.lit(0)).alias("n_links")]
    return out.select("doc", "n", F.coalesce("component", "first", "doc").alias("component"), F.coalesce("root", "node").alias("root"), *counts, *keep)
