"""Substring deduplication by recompression: globally named runs and pairs of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.llm.scratch import free, materialise
from turnmill.llm.wordhash import Texts, Words, gram_hashes, mix, slices

WINDOW = 13  # words of a repeat
LEVELS = 2  # rounds of recompression
BLOCK_WORDS = 1 << 20  # words of a text whose symbols are ranked at once

_NULL_ID = 2**63 - 1
_A, _B, _C = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


class Symbols:
    """One level of the parse of a slice of rows.

    ``name`` is a symbol's global name, a hash of what it stands for, so that all
    tasks give equal strings equal names without exchanging a dictionary.
    ``lo:hi`` are the words that decide the symbol: wherever the same words
    stand, the same symbol stands.  A symbol that the edge of its row helped to
    decide reaches beyond the row.  ``context`` names the words ``lo:hi``.
    """

    def __init__(self, name, context, row, lo, hi):
        self.name, self.context, self.row, self.lo, self.hi = name, context, row, lo, hi

    @classmethod
    def of_words(cls, words: Words) -> Symbols:
        at = np.arange(len(words.hash))
        return cls(words.hash, words.hash, words.row_of(), at, at + 1)

    def compress(self, level: int, first: np.ndarray) -> Symbols:
        """Name runs of equal symbols, then the pairs whose left and right symbols fall into the two halves of the alphabet."""
        n = len(self.name)
        if not n:
            return self
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        same_row = self.row[1:] == self.row[:-1]
        head = np.flatnonzero(np.r_[True, ~(same_row & (self.name[1:] == self.name[:-1]))])
        size = np.diff(np.r_[head, n])
        last = head + size - 1
        run = size > 1
        name, context = self.name[head], self.context[head]
        name = np.where(run, mix(name + size.astype(np.uint64) * _A + salt), name)
        context = np.where(run, mix(context * _B + self.context[last] * _C + size.astype(np.uint64)), context)
        row = self.row[head]

        # halves go by the repeated symbol, so one element of a neighbouring run tells its half
        right = (mix(self.name[head] + salt) & np.uint64(1)).astype(bool)
        joined = ~right[:-1] & right[1:] & (row[1:] == row[:-1])
        begin = np.flatnonzero(np.r_[True, ~joined])
        end = np.r_[begin[1:], len(name)] - 1
        pair = end > begin
        own_row = row[begin]
        left_edge = np.r_[True, own_row[1:] != own_row[:-1]]
        right_edge = np.r_[left_edge[1:], True]
        # the elements on either side decided that neither run nor pair went on
        before, after = np.maximum(head[begin] - 1, 0), np.minimum(last[end] + 1, n - 1)
        new_lo = np.where(left_edge, first[own_row] - 1, self.lo[before])
        new_hi = np.where(right_edge, first[own_row + 1] + 1, self.hi[after])
        inner = np.where(pair, mix(context[begin] * _A + context[end] * _B), context[begin])
        new_context = mix(self.context[before] * _C + inner * _A + self.context[after] * _B + salt)
        new_name = np.where(pair, mix(name[begin] * _A + name[end] * _B + salt), name[begin])
        return Symbols(new_name, new_context, own_row, new_lo, new_hi)


def _least_inside(symbols: Symbols, level: int, total: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window start (ascending): the index of the least-named symbol decided inside the window, and whether there is one.

    A rank keeps a symbol's index in its low 24 bits, so windows are taken in
    blocks of ``BLOCK_WORDS`` words and indices count from the block's first symbol.
    """
    n = len(symbols.name)
    if not n or not len(starts):
        return np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
    below = np.zeros(total + 2, dtype=np.int64)
    np.cumsum(np.bincount(np.clip(symbols.lo, -1, total) + 1, minlength=total + 2), out=below)
    upto = np.zeros(total + 3, dtype=np.int64)
    np.cumsum(np.bincount(np.clip(symbols.hi, 0, total + 2), minlength=total + 3), out=upto)
    i, j = below[starts], upto[starts + WINDOW]
    some = j > i
    found = np.zeros(len(starts), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(starts // BLOCK_WORDS, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(starts)], strict=True):
        base, top = int(i[a]), int(j[b - 1])  # both ascend with the starts
        if top > base:
            found[a:b] = base + _least_of(symbols.context[base:top], level, i[a:b] - base, np.where(some[a:b], j[a:b] - i[a:b], 0))
    return found, some


def _least_of(context: np.ndarray, level: int, first: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Of each range of ``width`` symbols from ``first`` on, the index of the least-named one; of no use where ``width`` is 0."""
    rank = (mix(context + np.uint64(level)) & ~np.uint64(0xFFFFFF)) | np.arange(len(context), dtype=np.uint64)
    best = np.full(len(first), np.iinfo(np.uint64).max, dtype=np.uint64)
    span, power = rank, 1
    while True:
        own = (width >= power) & (width < 2 * power)
        if own.any():
            best[own] = np.minimum(span[first[own]], span[first[own] + width[own] - power])
        power *= 2
        if power > width.max(initial=0):
            break
        half = power // 2
        span = np.minimum(span[:-half], span[half:]) if len(span) > half else span
    return (best & np.uint64(0xFFFFFF)).astype(np.int64)


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window start, windows) of runs of consecutive windows that share their anchor symbol.

    A window's anchor is the least-named of the highest-level symbols that the
    window's own words decide, so equal windows have equal anchors, in any row
    and task.  Level 0, the words themselves, always has one.
    """
    total = len(words.hash)
    levels = [Symbols.of_words(words)]
    for level in range(LEVELS):
        levels.append(levels[-1].compress(level, words.first))
    starts = np.flatnonzero(words.gram_ok(WINDOW))
    key = np.zeros(len(starts), dtype=np.uint64)
    symbol = np.zeros(len(starts), dtype=np.int64)
    left = np.arange(len(starts))
    for level in range(LEVELS, -1, -1):
        found, some = _least_inside(levels[level], level, total, starts[left])
        own = left[some]
        key[own] = mix(levels[level].context[found[some]] + np.uint64(level + 1))
        symbol[own] = found[some] * (LEVELS + 1) + level
        left = left[~some]
        if not len(left):
            break
    if not len(starts):
        return key, starts, starts
    head = np.flatnonzero(np.r_[True, (symbol[1:] != symbol[:-1]) | (starts[1:] != starts[:-1] + 1)])
    return key[head], starts[head], np.diff(np.r_[head, len(starts)])


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(Texts(part.column(1)))
            key, start, n = anchors(words)
            row = np.searchsorted(words.first, start, side="right") - 1
            at = start - words.first[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), part.column(0).take(pa.array(row)), pa.array((at << 24) | n)], names=["key", "doc", "span"])


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(Texts(part.column(1)))
            gram, check = words.grams(WINDOW), gram_hashes(words.hash, WINDOW, 1)
            spans = part.column(2)
            flat = spans.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(part.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False))
            start, n = words.first[row] + (flat >> 24), flat & 0xFFFFFF
            keep = start + n + WINDOW - 1 <= words.first[row + 1]  # ids that stand twice bring the other text's spans, too
            start, n, row = start[keep], n[keep], row[keep]
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - n), n)
            row = np.repeat(row, n)
            _, once = np.unique(mix(gram[at] + row.astype(np.uint64) * _A), return_index=True)  # a text's repeats of one window are one row
            at, row = at[once], row[once]
            second = (check[at] >> np.uint64(33)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(gram[at].view(np.int64)), pa.array(second), part.column(0).take(pa.array(row))], names=["window", "check", "doc"])


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = Texts(part.column(1))
            n_words, n_removed, sha, kept_text = [], [], [], []
            raw, bounds = texts.data.tobytes(), texts.bounds.tolist()
            for i in range(part.num_rows):
                words = raw[bounds[i] : bounds[i + 1]].split()  # splits at the same six bytes as the word class
                n_words.append(len(words))
                cuts = part.column(2)[i]
                if cuts.is_valid:
                    own = Words(Texts(part.column(1).slice(i, 1)))
                    gram = own.grams(WINDOW)[: max(0, len(words) - WINDOW + 1)]
                    at = np.flatnonzero(np.isin(gram.view(np.int64), cuts.values.to_numpy(zero_copy_only=False)))
                    covered = np.zeros(len(words) + WINDOW, dtype=np.int64)
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + WINDOW, -1)
                    keep = np.cumsum(covered)[: len(words)] == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_text.append(kept.decode("utf-8"))
            columns = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept_text, pa.string())] if with_text else [])], names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each word covered by a ``WINDOW``-word sequence that also starts in a document with a smaller id.

    Every window is reduced to its anchor symbol (see ``anchors``).  Anchors that
    two documents share reveal the candidate windows, which are then verified by
    hashes of their own words (95 bits) and joined with the least document that
    holds them.  What is shared is found by aggregates, which combine before
    their shuffle, and joined back as plain tables, so that a passage of a third
    of all documents is a skewed join that Spark splits, never one task's rows.
    Windows are judged on the input.

    Returns id, ``n_words``, ``n_removed``, ``kept_sha256`` (kept words joined by
    one space) and, with ``with_text``, ``kept_text``.  A null text has no
    words; a null id counts as larger than every id (as does 2**63 - 1, the one
    number that stands for it); rows with equal ids don't remove each other's words; an empty table gives no rows; other columns are
    ignored.  ``id_col`` is an integer column.
    """
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc")
    rows = docs.select(doc, F.col(text_col).alias("text"))

    marks = rows.mapInArrow(_emit_anchors, "key long, doc long, span long")
    shared = marks.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("key")
    shared = materialise(shared, "shared")
    spans = materialise(marks.join(shared, "key").groupBy("doc").agg(F.collect_list("span").alias("spans")), "spans")  # of one document

    windows = rows.join(spans, "doc").select("doc", "text", "spans").mapInArrow(_emit_windows, "window long, check int, doc long")
    windows, same = materialise(windows, "windows"), ["window", "check"]
    least = windows.groupBy(*same).agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select(*same, "least")
    repeated = windows.join(materialise(least, "least"), same).filter("least < doc")
    cuts = materialise(repeated.groupBy("doc").agg(F.collect_list("window").alias("cuts")), "cuts")
    free(windows)

    schema = T.StructType([
        docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()),
        *([T.StructField("kept_text", T.StringType())] if with_text else []),
    ])
    names = schema.names
    full = docs.select(F.col(id_col).alias("id"), doc, F.col(text_col).alias("text")).join(cuts, "doc", "left").select("id", "text", "cuts")
    return full.mapInArrow(lambda batches: _cut(batches, names, with_text), schema)
