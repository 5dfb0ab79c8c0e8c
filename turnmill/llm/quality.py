"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.llm.wordhash import BYTES, SPACES, Texts, Words, hash_spans, mix, slices

SAMPLE_ROWS = 400  # documents on which cost and selectivity of each rule are estimated
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50  # the base rules

_SYMBOL = np.isin(BYTES, [ord(c) for c in "#*$%&|<>"])
_UPPER, _LOWER = (BYTES >= 65) & (BYTES <= 90), (BYTES >= 97) & (BYTES <= 122)
_LETTER = _UPPER | _LOWER | (BYTES >= 0x80)
_HEAD = (BYTES & 0xC0) != 0x80  # first byte of a code point
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Facts:
    """What rules may ask of a slice of texts; each fact is computed once, and only if asked for.

    ``only`` gives the facts of some rows: what is known of them is sliced, and
    what is asked for later reads their texts alone.
    """

    def __init__(self, array: pa.Array, rows: np.ndarray | None = None, known: dict | None = None):
        self.array, self.rows, self._known, self._whole = array, rows, dict(known or {}), None

    def __len__(self) -> int:
        return len(self.array) if self.rows is None else len(self.rows)

    def only(self, keep: np.ndarray) -> Facts:
        if keep.all():
            return self
        rows = np.flatnonzero(keep) if self.rows is None else self.rows[keep]
        part = Facts(self.array, rows, {name: value[keep] for name, value in self._known.items() if isinstance(value, np.ndarray)})
        part._whole = (self, keep)
        return part

    def again(self) -> Facts:
        """The same rows with the same knowledge, to which later facts of the one aren't known in the other."""
        same = Facts(self.array, self.rows, self._known)
        same._whole = self._whole
        return same

    @property
    def texts(self) -> Texts:
        return self.get("all_texts")

    @property
    def words(self) -> Words:
        return self.get("all_words")

    def _all_texts(self) -> Texts:
        return Texts(self.array if self.rows is None else self.array.take(pa.array(self.rows)))

    def _all_words(self) -> Words:
        if self._whole is None:
            return Words(self.texts)
        whole, keep = self._whole  # the words of the rows that are left, moved to where their texts are now
        return whole.words.only(keep, whole.texts.bounds[:-1][keep] - self.texts.bounds[:-1])

    def get(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = getattr(self, f"_{name}")()
        return self._known[name]

    def _sum(self, flags: np.ndarray) -> np.ndarray:
        """Flags of each row: a search for the row bounds among the flagged places."""
        return np.diff(np.searchsorted(np.flatnonzero(flags), self.texts.bounds))

    def _n_words(self) -> np.ndarray:
        return self.words.count

    def _word_chars(self) -> np.ndarray:
        return self._sum((_HEAD & ~SPACES)[self.texts.data])

    def _n_symbols(self) -> np.ndarray:
        return self._sum(_SYMBOL[self.texts.data])

    def _upper(self) -> np.ndarray:
        return self._sum(_UPPER[self.texts.data])

    def _lower(self) -> np.ndarray:
        return self._sum(_LOWER[self.texts.data])

    def _letter_words(self) -> np.ndarray:
        """Words with a letter: few lack one at their first or last byte, so only those are looked through."""
        data, words = self.texts.data, self.words
        has = _LETTER[data[words.start]] | _LETTER[data[words.end - 1]] if len(words.start) else np.zeros(0, bool)
        left = np.flatnonzero(~has)
        size = words.end[left] - words.start[left]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(words.start[left] - (ends - size), size)
        if len(left):
            has[left] = np.logical_or.reduceat(_LETTER[data[at]], ends - size)
        return self._per_row(has)

    def _per_row(self, flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.words.first])

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and how many of them equal an earlier one, by row."""
        data, bounds = self.texts.data, self.texts.bounds
        breaks = np.flatnonzero(data == 10)
        cuts = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
        ends = np.concatenate([cuts[1:], [len(data)]])
        newline = np.zeros(len(cuts), dtype=bool)
        full = ends > cuts
        newline[full] = data[ends[full] - 1] == 10
        ends = ends - newline
        wordy = np.searchsorted(self.words.start, ends) > np.searchsorted(self.words.start, cuts)
        start, end = cuts[wordy], ends[wordy]
        row = np.searchsorted(bounds, start, side="right") - 1
        key = mix(hash_spans(self.texts, start, end) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(key, return_index=True)
        n = len(self.texts)
        count = np.bincount(row, minlength=n)
        return count, count - np.bincount(row[first], minlength=n)

    def _n_dup_lines(self) -> np.ndarray:
        return self.get("lines")[1]

    def _n_lines(self) -> np.ndarray:
        return self.get("lines")[0]

    def _n_repeat_words(self) -> np.ndarray:
        words = self.words
        at = np.flatnonzero(words.gram_ok(3)) if len(words.start) else np.zeros(0, np.int64)
        key = mix(words.grams(3)[at] + words.row_of()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        hit = at[counts[inverse] > 1]
        covered = np.zeros(len(words.start), dtype=bool)
        for i in range(3):
            covered[hit + i] = True
        return self._per_row(covered)


#: Rejecting rules: each sees the facts and returns True for the rows to reject.  The first three
#: ask for what the result states anyway, the last two for facts of their own.
RULES: dict[str, Callable[[Facts], np.ndarray]] = {
    "many_symbols": lambda f: 100 * f.get("n_symbols") > 10 * f.get("n_words"),
    "repeated_lines": lambda f: 100 * f.get("n_dup_lines") > 30 * f.get("n_lines"),
    "odd_word_length": lambda f: (f.get("word_chars") < 2 * f.get("n_words")) | (f.get("word_chars") > 15 * f.get("n_words")),
    "mostly_capitals": lambda f: 100 * f.get("upper") > 60 * (f.get("upper") + f.get("lower")),
    "few_letter_words": lambda f: 100 * f.get("letter_words") < 70 * f.get("n_words"),
}


def _base(array: pa.Array) -> tuple[Facts, np.ndarray]:
    """Facts with all that the result states of each text, and which rows the base rules reject."""
    facts = Facts(array)
    for name in (*_STATS, "n_lines"):
        facts.get(name)
    return facts, (facts.get("n_words") < MIN_WORDS) | (100 * facts.get("n_repeat_words") > MAX_REPEAT_PERCENT * facts.get("n_words"))


def cascade(facts: Facts, failed: np.ndarray, plan: list[str]) -> np.ndarray:
    """Rows that pass all of ``plan``: each rule sees only the rows that are still in."""
    alive, facts = np.flatnonzero(~failed), facts.only(~failed)
    for name in plan:
        if not len(alive):
            break
        good = ~RULES[name](facts)
        alive, facts = alive[good], facts.only(good)
    kept = np.zeros(len(failed), dtype=bool)
    kept[alive] = True
    return kept


def estimate_rules(docs: DataFrame, rules: list[str], sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, float, float]]:
    """(rule, seconds a row, share rejected) of each rule, measured on the ``sample_rows`` rows of lowest id hash.

    A rule's cost is what it adds: the result's own counts are known before it
    starts, and rows that the base rules reject never reach it.  Without sampled
    rows all are 0.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                facts, failed = _base(part.column(0))
                facts, out = facts.only(~failed), []
                for name in rules:
                    own = facts.again()
                    began = time.perf_counter()
                    rejected = int(RULES[name](own).sum())
                    out.append((name, time.perf_counter() - began, rejected, len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["rule", "seconds", "rejected", "rows"])

    order = F.xxhash64(F.col(id_col))  # ranked alone, so that no task gathers texts of all others
    last = docs.select(order.alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    sample = docs.filter(order <= F.lit(last)).limit(sample_rows).select(F.col(text_col).alias("text"))
    found = sample.mapInArrow(measure, "rule string, seconds double, rejected long, rows long").groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("seconds", "rejected", "rows")))
    by = {r.rule: r for r in found.collect()}  # a row a rule
    return [(name, by[name].seconds / by[name].rows, by[name].rejected / by[name].rows) if name in by and by[name].rows else (name, 0.0, 0.0) for name in rules]


def order_rules(estimates: list[tuple[str, float, float]]) -> list[str]:
    """Most rejection per cost first; ties keep the given order."""
    return [name for name, _, _ in sorted(estimates, key=lambda e: -e[2] / max(e[1], 1e-9))]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts, base verdict and cascade verdict of every whole text.

    A document is kept if it passes the base rules and then every rule of
    ``RULES``; the rules run in the order of rejection per cost, each only on the
    rows that are still in.  Costs are measured, so the order may differ from run
    to run; it changes the work and no value of the result.

    A null or empty text has no words and fails the base rules; repeated rows
    give repeated rows; an empty table gives none; other columns are ignored.
    """
    plan = order_rules(estimate_rules(docs, list(RULES), sample_rows, id_col, text_col))
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in _STATS),
        T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
    ])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                facts, failed = _base(part.column(1))
                stats = [pa.array(facts.get(c).astype(np.int64)) for c in _STATS]
                yield pa.RecordBatch.from_arrays([part.column(0), *stats, pa.array(failed), pa.array(cascade(facts, failed, plan))], names=[f.name for f in schema.fields])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(judge, schema)
