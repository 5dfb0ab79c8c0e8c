"""Periodic runs of words by maximal-pair enumeration.

A run of period q is the same thing as a maximal pair at distance q: two equal
stretches of words, q apart, that neither the words before nor the words after
extend.  So no run is ever grown: the suffixes of a text are sorted, the
LCP-interval tree over them is walked bottom-up with a list of positions for each
left word, and where two children of an interval meet, each pair of positions
with unlike left words whose distance is short enough for the interval's depth
is a run.

A text is one row, its runs follow from it alone, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.llm.wordhash import Texts, Words, gram_hashes, mix, slices

MIN_LENGTH, MIN_EXPONENT = 6, 4

_WIDE = 8  # left words of a node from which its positions are kept in one list, too
_SLICE = 2 << 20  # bytes of text whose suffixes are sorted together
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def ranks(key: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of the 1, 2, 4, ... words from each place on, until all places differ.

    ``key`` tells words apart and grows from text to text, ``end`` is where the
    text of each place ends.  Only places that still share a rank are sorted anew.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    active = order[~(fresh & np.r_[fresh[1:], True])]
    found, h = [rank], 1
    while len(active):
        after = active + h
        second = np.where(after < end[active], rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[active]))
        active, second, first = active[by], second[by], rank[active][by]
        group = np.r_[True, first[1:] != first[:-1]]
        fresh = group | np.r_[True, second[1:] != second[:-1]]
        place = np.arange(len(active))
        rank = rank.copy()
        rank[active] = first + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        found.append(rank)
        active = active[~(fresh & np.r_[fresh[1:], True])]
        h *= 2
    return found


def common_prefixes(found: list[np.ndarray], suffixes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in order (of the same text)."""
    a, b = suffixes[:-1], suffixes[1:]
    shared = np.zeros(len(a), dtype=np.int64)
    for level in range(len(found) - 1, -1, -1):
        i, j = a + shared, b + shared
        inside = (i < end[a]) & (j < end[b])
        equal = found[level][np.where(inside, i, 0)] == found[level][np.where(inside, j, 0)]
        shared += np.where(inside & equal & (end[a] == end[b]), 1 << level, 0)
    return np.r_[0, shared]


class _Node:
    """Positions below an interval, sorted, by the word to their left."""

    __slots__ = ("by", "size", "every")

    def __init__(self, position: int, left: int):
        self.by, self.size, self.every = {left: [position]}, 1, None


def _meet(a: _Node, b: _Node, depth: int, exponent: int, left: list[int], out: list) -> _Node:
    """Report the pairs between two children of an interval of ``depth`` shared words, and unite them, small into large."""
    if a.size < b.size:
        a, b = b, a
    reach = depth // (exponent - 1)
    if not (len(a.by) == len(b.by) == 1 and a.by.keys() == b.by.keys()):
        for word, some in b.by.items():
            for i in some:
                if a.every is not None:
                    lo, hi = bisect_left(a.every, i - reach), bisect_right(a.every, i + reach)
                    if hi - lo <= len(a.by):
                        out += [(min(i, j), abs(i - j), depth) for j in a.every[lo:hi] if left[j] != word]
                        continue
                for other, many in a.by.items():
                    if other != word:
                        lo = bisect_left(many, i - reach)
                        while lo < len(many) and many[lo] <= i + reach:
                            out.append((min(i, many[lo]), abs(i - many[lo]), depth))
                            lo += 1
    for word, some in b.by.items():
        mine = a.by.setdefault(word, some)
        if mine is not some:
            for i in some:
                insort(mine, i)
    if a.every is not None:
        for some in b.by.values():
            for i in some:
                insort(a.every, i)
    elif len(a.by) > _WIDE:
        a.every = sorted(i for some in a.by.values() for i in some)
    a.size += b.size
    return a


def maximal_pairs(suffixes: list[int], shared: list[int], left: list[int], exponent: int) -> list[tuple[int, int, int]]:
    """(position, distance, shared words) of the maximal pairs whose distance is at most shared words / (exponent - 1).

    ``shared`` has what each suffix shares with the one before it (the first: anything).
    """
    out: list[tuple[int, int, int]] = []
    stack: list[list] = []
    node = _Node(suffixes[0], left[suffixes[0]])
    for k in range(1, len(suffixes) + 1):
        depth = shared[k] if k < len(suffixes) else -1
        while stack and stack[-1][0] > depth:
            level, above = stack.pop()
            node = _meet(above, node, level, exponent, left, out)
        if depth < 0:
            break
        if stack and stack[-1][0] == depth:
            stack[-1][1] = _meet(stack[-1][1], node, depth, exponent, left, out)
        else:
            stack.append([depth, node])
        node = _Node(suffixes[k], left[suffixes[k]])
    return out


def runs_of(hashes: np.ndarray, first: np.ndarray, min_length: int, min_exponent: int) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text that has any, by start and period.

    ``hashes`` are the words of all texts, ``first[i]:first[i + 1]`` those of text i.
    """
    least = min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1))  # words that a pair shares at least
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    whole = np.arange(len(row)) + least <= first[1:][row]
    gram = mix(gram_hashes(hashes, least)[whole] + row[whole].astype(np.uint64) * _ODD)
    own = row[whole]
    order = np.argsort(gram)
    twice = np.flatnonzero(gram[order][1:] == gram[order][:-1])
    some = np.unique(own[order[twice]])  # texts in which so many words stand twice
    if not len(some):
        return {}
    pick = np.isin(row, some)
    words, row = hashes[pick], row[pick]
    names, word = np.unique(words, return_inverse=True)
    start = np.searchsorted(row, row)
    end = np.searchsorted(row, row, side="right")
    found = ranks(row * len(names) + word, end)
    suffixes = np.empty(len(row), dtype=np.int64)
    suffixes[found[-1]] = np.arange(len(row))
    shared = common_prefixes(found, suffixes, end)
    left = np.where(np.arange(len(row)) == start, -1, np.r_[-1, found[0][:-1]])

    # stretches of suffixes that share enough words with their neighbours, and of these the ones with places close enough
    joined = shared >= least
    head = np.flatnonzero(~joined & np.r_[joined[1:], False])
    if not len(head):
        return {}
    tail = np.flatnonzero(joined & ~np.r_[joined[1:], False]) + 1
    stretch = np.repeat(np.arange(len(head)), tail - head)
    at = suffixes[np.arange(len(stretch)) + np.repeat(head - np.r_[0, np.cumsum(tail - head)[:-1]], tail - head)]
    by = np.lexsort((at, stretch))
    gap = np.r_[np.iinfo(np.int64).max, np.diff(at[by])]
    bounds = np.r_[0, np.cumsum(tail - head)[:-1]]
    gap[bounds] = np.iinfo(np.int64).max
    nearest = np.minimum.reduceat(gap, bounds)
    deepest = np.maximum.reduceat(np.where(joined, shared, 0), head)
    close = np.flatnonzero(nearest <= deepest // (min_exponent - 1))
    left_words = left.tolist() if len(close) else []

    runs: dict[int, dict] = {}
    for s in close:
        a, b = int(head[s]), int(tail[s])
        for place, q, depth in maximal_pairs(suffixes[a:b].tolist(), shared[a:b].tolist(), left_words, min_exponent):
            if depth + q >= max(min_length, min_exponent * q):
                of = runs.setdefault(int(row[place]), {})
                key = (place - int(start[place]), depth + q)
                of[key] = min(q, of.get(key, q))  # a stretch has its multiples' pairs, too
    return {i: sorted(((s, n, q) for (s, n), q in of.items()), key=lambda r: (r[0], r[2])) for i, of in runs.items()}


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
    rewrite: Callable[[int, int], np.ndarray | None] | None = None, seed_col: str | None = None, with_text: bool = False,
) -> DataFrame:
    """The runs of every whole text, and the text with each run collapsed to its first period.

    A run is a stretch of consecutive words (they end at ASCII white space) whose
    smallest period is q, of at least ``min_length`` and ``min_exponent * q``
    words, that no neighbouring word extends.  Collapsing drops the words that
    any run contains after its first q words.

    Returns id, ``n_words``, ``n_runs``; ``start``, ``length``, ``period`` and
    ``exponent_milli`` of the longest run (ties: the first start, then the smaller
    period; nulls without a run); ``runs_sha256`` of ``start,length,period`` and
    a line feed for each run by start and period; ``collapsed_sha256`` of the
    kept words, joined by one space.  ``with_text`` adds ``runs`` and ``collapsed``.

    A null or blank text has no words and no runs; repeated rows and ids, null ids
    too, are rows of their own; other columns are ignored; an empty table gives
    no rows.  ``rewrite(n_words, seed)`` may tell which of its words stands at each
    place of a text (None: its own), given the LONG in ``seed_col``.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two words and two periods at least")
    schema = T.StructType([
        docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")),
        *(T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")),
        *([T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))), T.StructField("collapsed", T.StringType())] if with_text else []),
    ])
    names = schema.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                yield _scan_slice(part, names, min_length, min_exponent, rewrite, with_text)

    seed = F.col(seed_col).cast("long") if seed_col else F.lit(None).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), seed.alias("seed")).mapInArrow(scan, schema)


def _scan_slice(part: pa.RecordBatch, names: list[str], min_length: int, min_exponent: int, rewrite: Callable | None, with_text: bool) -> pa.RecordBatch:
    texts = Texts(part.column(1))
    words = Words(texts)
    source = np.arange(len(words.start))
    for i, seed in enumerate(part.column(2).to_pylist() if rewrite else []):
        if seed is not None and words.count[i]:
            own = rewrite(int(words.count[i]), seed)
            if own is not None:
                source[words.first[i] : words.first[i + 1]] = words.first[i] + own
    found = runs_of(words.hash[source], words.first, min_length, min_exponent)
    raw, first = texts.data.tobytes(), words.first.tolist()
    starts, ends = words.start[source].tolist(), words.end[source].tolist()
    columns: dict[str, list] = {c: [] for c in names[1:]}
    for i in range(part.num_rows):
        a, b = first[i], first[i + 1]
        runs, kept = found.get(i, []), range(a, b)
        if runs:
            covered = np.zeros(b - a + 1, dtype=np.int64)
            np.add.at(covered, [s + q for s, _, q in runs], 1)
            np.add.at(covered, [s + n for s, n, _ in runs], -1)
            kept = (a + np.flatnonzero(np.cumsum(covered)[:-1] == 0)).tolist()
        text = b" ".join([raw[starts[k] : ends[k]] for k in kept])
        longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        exponent = 1000 * longest[1] // longest[2] if runs else None
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        values = [b - a, len(runs), *longest, exponent, hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest()]
        if with_text:
            values += [[{"start": s, "length": n, "period": q} for s, n, q in runs], text.decode("utf-8")]
        for c, v in zip(names[1:], values, strict=True):
            columns[c].append(v)
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + ([_RUNS, pa.string()] if with_text else [])
    return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(columns[c], kind) for c, kind in zip(names[1:], kinds, strict=True))], names=names)


def repeated_tail(n_words: int, seed: int) -> np.ndarray | None:
    """Damage for a text whose seed ends in 0: from some word on, the text repeats a period three times and more."""
    if seed % 10:
        return None
    g = seed // 10
    a = g % n_words
    place = np.arange(n_words)
    return np.where(place < a, place, a + (place - a) % (1 + (n_words - a) // (3 + g % 8)))
