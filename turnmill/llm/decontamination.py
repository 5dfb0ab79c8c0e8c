"""Benchmark decontamination by winnowed fingerprints that are extended to whole windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.llm.scratch import materialise
from turnmill.llm.wordhash import ALNUM_WORD, LOWER, Texts, Words, gram_hashes, slices

WINDOW = 10  # words of a window
GRAM = 5  # words of a fingerprint; the least of WINDOW - GRAM + 1 neighbours is kept
BROADCAST_POSTINGS = 2_000_000  # (window, item) pairs up to which the benchmark is sent to every task

CHECK = 1  # salt of the second hash of a window

_GRAMS = WINDOW - GRAM + 1


def _least(grams: np.ndarray) -> np.ndarray:
    """The least hash of each run of ``_GRAMS`` fingerprints: what winnowing keeps for each window."""
    n = max(0, len(grams) - _GRAMS + 1)
    out = grams[:n].copy()
    for i in range(1, _GRAMS):
        np.minimum(out, grams[i : n + i], out=out)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, window, check, fingerprint, n_words) of the items; a shorter item is one window and its own fingerprint.

    ``check`` is a second hash of the window's words: a hit needs both.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(Texts(part.column(1)), ALNUM_WORD, LOWER)
                rows, found, checks, prints, sizes = [], [], [], [], []
                for i in range(part.num_rows):
                    own = words.hash[words.first[i] : words.first[i + 1]]
                    if not len(own):
                        continue
                    k = min(WINDOW, len(own))
                    window = gram_hashes(own, k)[: len(own) - k + 1]
                    rows.append(np.full(len(window), i))
                    found.append(window)
                    checks.append(gram_hashes(own, k, CHECK)[: len(own) - k + 1])
                    prints.append(_least(gram_hashes(own, GRAM)[: len(own) - GRAM + 1]) if k == WINDOW else window)
                    sizes.append(np.full(len(window), k))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(np.concatenate(rows))), *(_signed(np.concatenate(x)) for x in (found, checks, prints)), pa.array(np.concatenate(sizes), pa.int32())],
                        names=["item", "window", "check", "print", "size"],
                    )

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return items.mapInArrow(windows, "item string, window long, check long, print long, size int").distinct()


class Index:
    """Windows and postings of a bounded benchmark, for use inside tasks."""

    def __init__(self, item: list[str | None], window: np.ndarray, check: np.ndarray, prints: np.ndarray, size: np.ndarray):
        self.names = sorted({x for x in item if x is not None})
        number = {x: i for i, x in enumerate(self.names)}
        numbers = np.array([-1 if x is None else number[x] for x in item], dtype=np.int64)
        self.by_size = {}
        for k in np.unique(size).tolist():
            own = np.flatnonzero(size == k)
            order = own[np.argsort(window[own], kind="stable")]
            keys, first = np.unique(window[order], return_index=True)
            self.by_size[k] = (keys, check[order][first], np.r_[first, len(order)], numbers[order])
        full = np.unique(prints[size == WINDOW])
        self.prints = full
        self.bits = np.zeros(1 << 22, dtype=bool)  # a cheap first look before the search
        self.bits[(full >> np.uint64(42)).astype(np.int64)] = True

    def has_print(self, least: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[(least >> np.uint64(42)).astype(np.int64)])
        return maybe[_in(self.prints, least[maybe])]


def _in(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), dtype=bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _candidates(words: Words, sizes: list[int], has_print) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, word positions, window hashes): for whole windows only where the kept fingerprint is wanted."""
    for k in sizes:
        ok = words.gram_ok(k)
        if k == WINDOW:
            least = _least(gram_hashes(words.hash, GRAM))
            at = has_print(least)
            at = at[ok[at]]
            hashes = _grams_at(words.hash, at, k)
        else:
            at = np.flatnonzero(ok)
            hashes = gram_hashes(words.hash, k)[at]
        yield k, at, hashes


def _grams_at(words: np.ndarray, at: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """``gram_hashes`` at some positions only."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    return gram_hashes(words[(at[:, None] + np.arange(k)).ravel()], k, salt)[::k]


def _cover(n: int, at: np.ndarray, k: int) -> np.ndarray:
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + k, -1)
    return np.cumsum(edges[:-1]) > 0


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_postings: int = BROADCAST_POSTINGS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Words of each document inside any occurrence of a benchmark window, and the items they come from.

    Training and test fingerprints (winnowed ``GRAM``-grams) are joined; every
    hit is extended to the whole windows around it and verified there, so each
    shared span of ``WINDOW`` words is found.  Items of fewer words are one
    window and are matched at their own length.  A benchmark of at most
    ``broadcast_postings`` (window, item) pairs is sent to the tasks and the
    documents aren't shuffled; a larger one is joined by fingerprint and window.

    Returns id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` (of the
    comma-joined item ids, sorted as strings) and ``contaminated``.  A null text
    has no words, an item with a null id marks words but isn't listed, equal ids
    of items count once, repeated documents are judged alike, an empty table
    gives no rows, an empty benchmark no hits.  Other columns are ignored but for
    those named in ``keep``, which are carried along.
    """
    windows = materialise(benchmark_windows(benchmark), "windows")
    if windows.count() <= broadcast_postings:
        return _by_broadcast(docs, windows, id_col, text_col, keep)
    return _by_join(docs, windows, id_col, text_col, keep)


def _carried(keep: tuple[str, ...], once: str | None = None) -> list:
    """Columns to carry along; the column ``once`` is there already."""
    return [F.lit(None).alias(f"_keep{i}") if c == once else F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]


def _schema(docs: DataFrame, id_col: str, keep: tuple[str, ...]) -> T.StructType:
    return T.StructType([
        *(docs.schema[c] for c in (id_col, *keep)), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")),
        T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
    ])


def _by_broadcast(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    rows = windows.toArrow()
    to_unsigned = lambda c: rows.column(c).to_numpy().astype(np.int64).view(np.uint64)
    window, check, size = to_unsigned("window"), to_unsigned("check"), rows.column("size").to_numpy()
    if any(len(np.unique(window[size == k])) < len(np.unique(np.stack([window, check])[:, size == k], axis=1).T) for k in np.unique(size)):
        return _by_join(docs, windows, id_col, text_col, keep)  # one hash of two windows, which the index can't tell apart
    index = Index(rows.column("item").to_pylist(), window, check, to_unsigned("print"), size)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = _schema(docs, id_col, keep)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(Texts(part.column(1)), ALNUM_WORD, LOWER)
                n, total = part.num_rows, len(words.hash)
                hit, pairs = np.zeros(total, dtype=bool), []
                row_of = words.row_of()
                for k, at, hashes in _candidates(words, sorted(index.by_size), index.has_print):
                    keys, checks, first, items = index.by_size[k]
                    found = _in(keys, hashes)
                    at, slot = at[found], np.searchsorted(keys, hashes[found])
                    same = checks[slot] == _grams_at(words.hash, at, k, CHECK)
                    at, slot = at[same], slot[same]
                    if not len(at):
                        continue
                    hit |= _cover(total, at, k)
                    seen = np.unique(row_of[at] * len(keys) + slot)
                    row, slot = seen // len(keys), seen % len(keys)
                    sizes = first[slot + 1] - first[slot]
                    ends = np.cumsum(sizes)
                    posting = np.arange(ends[-1]) + np.repeat(first[slot] - (ends - sizes), sizes)
                    pairs.append(np.stack([np.repeat(row, sizes), items[posting]]))
                n_items, sha = np.zeros(n, dtype=np.int64), [nothing] * n
                if pairs:
                    row, item = np.unique(np.concatenate(pairs, axis=1), axis=1)
                    row, item = row[item >= 0], item[item >= 0]
                    cuts = np.searchsorted(row, np.arange(n + 1))
                    n_items = np.diff(cuts)
                    for i in np.flatnonzero(n_items):
                        sha[i] = hashlib.sha256(",".join(index.names[j] for j in item[cuts[i] : cuts[i + 1]]).encode()).hexdigest()
                sums = np.r_[0, np.cumsum(hit)]
                n_hit = np.diff(sums[words.first])
                kept = [part.column(1) if c == text_col else x for c, x in zip(keep, part.columns[2:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *kept, pa.array(words.count.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array(n_items.astype(np.int64)), pa.array(sha), pa.array(n_hit > 0)],
                    names=[f.name for f in schema.fields],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_carried(keep, text_col)).mapInArrow(search, schema)


def _by_join(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The same for a benchmark of any size.  Results depend on the text alone, so rows are keyed by its digest."""
    sizes = [r["size"] for r in windows.select("size").distinct().orderBy("size").collect()]  # WINDOW values at most
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("key"), *_carried(keep))
    texts = keyed.select("key", "text")

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(Texts(part.column(1)), ALNUM_WORD, LOWER)
                row_of, found = words.row_of(), []
                for k in sizes:
                    at = np.flatnonzero(words.gram_ok(k))
                    value = (_least(gram_hashes(words.hash, GRAM)) if k == WINDOW else gram_hashes(words.hash, k))[at]
                    kept = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (row_of[at[1:]] != row_of[at[:-1]])]) if len(at) else at
                    found.append((row_of[at[kept]], value[kept], np.full(len(kept), k)))
                row, value, size = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), _signed(value), pa.array(size, pa.int32())], names=["key", "print", "size"])

    wanted = windows.select("print", "size").distinct()
    hits = texts.mapInArrow(fingerprints, "key string, print long, size int").join(wanted, ["print", "size"])
    by_text = hits.groupBy("key").agg(F.collect_set("print").alias("prints"))  # of one text, so bounded by its length

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for i in range(part.num_rows):
                    words = Words(Texts(part.column(1).slice(i, 1)), ALNUM_WORD, LOWER)
                    prints = np.unique(np.array(part.column(2)[i].as_py(), dtype=np.int64).view(np.uint64))
                    for k, at, hashes in _candidates(words, sizes, lambda least, p=prints: np.flatnonzero(_in(p, least))):
                        if k != WINDOW:
                            at, hashes = at[_in(prints, hashes)], hashes[_in(prints, hashes)]
                        row, check = pa.array(np.full(len(at), i)), _grams_at(words.hash, at, k, CHECK)
                        columns = [part.column(0).take(row), _signed(hashes), _signed(check), pa.array(at, pa.int64()), pa.array(np.full(len(at), k), pa.int32())]
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "window", "check", "at", "size"])

    once = texts.join(by_text, "key").dropDuplicates(["key"]).select("key", "text", "prints")
    found = once.mapInArrow(extend, "key string, window long, check long, at long, size int")
    same = ["window", "check", "size"]
    found = materialise(found.join(windows.select(*same).distinct(), same), "hits")
    covered = found.select("key", F.explode(F.expr("sequence(at, at + size - 1)")).alias("word")).distinct().groupBy("key").agg(F.count("word").alias("n_hit"))
    items = found.select("key", *same).distinct().join(windows, same).filter("item is not null").select("key", "item").distinct()
    listed = items.groupBy("key").agg(F.count("item").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(Texts(part.column(2)), ALNUM_WORD, LOWER, hashes=False)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *part.columns[3:], pa.array(words.count.astype(np.int64))], names=schema.names)

    fields = _schema(docs, id_col, keep).fields
    kept = [T.StructField(f"_keep{i}", f.dataType) for i, f in enumerate(fields[1 : 1 + len(keep)])]
    schema = T.StructType([T.StructField("id", fields[0].dataType), T.StructField("key", T.StringType()), *kept, T.StructField("n_words", T.LongType())])
    counted = keyed.select("id", "key", "text", *(f.name for f in kept)).mapInArrow(count_words, schema)
    return counted.join(covered, "key", "left").join(listed, "key", "left").select(
        F.col("id").alias(id_col), *(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)), "n_words", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")),
        F.coalesce("items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
