"""Language identification with a blended-spectrum presence kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.llm.wordhash import BYTES, Texts, slices

SAMPLE_PER_LANGUAGE = 500  # about so many training documents of each language are learned from
SAMPLE_ROWS = 20_000  # and at most so many in all
LANDMARKS = 256
RIDGE = 0.1
SHARPNESS = 4.0  # of the softmax that turns margins into a score
SPECTRUM = (1, 2, 3)  # n-gram lengths in bytes of UTF-8
BUCKETS = 1 << 15
UNDETERMINED = "und"

_ROWS_AT_ONCE = 128
_BYTES_AT_ONCE = 1 << 19
#: ASCII letters fold to lower case, all other ASCII to one separator, other bytes stay.
_FOLD = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, np.where(((BYTES >= 97) & (BYTES <= 122)) | (BYTES >= 128), BYTES, 32)).astype(np.uint32)
_ASCII_LETTER = ((BYTES >= 65) & (BYTES <= 90)) | ((BYTES >= 97) & (BYTES <= 122))


def presence(texts: Texts, first: int, last: int) -> np.ndarray:
    """Which hashed n-grams rows ``first`` to ``last`` hold, as a (rows x BUCKETS) boolean matrix.

    Bytes are taken ``_BYTES_AT_ONCE`` at a time, so a long text takes no more memory than a short one.
    """
    begin, end = int(texts.bounds[first]), int(texts.bounds[last])
    starts, ends = texts.bounds[first:last], texts.bounds[first + 1 : last + 1]
    out = np.zeros((last - first) * BUCKETS, dtype=bool)
    for at in range(begin, end, _BYTES_AT_ONCE):
        to = min(end, at + _BYTES_AT_ONCE)
        code = _FOLD[texts.data[at : min(end, to + max(SPECTRUM) - 1)]]  # n-grams may reach into the next part
        parts = np.clip(ends, at, to) - np.clip(starts, at, to)
        row = np.repeat(np.arange(last - first, dtype=np.int64) * BUCKETS, parts)
        left = np.repeat(ends, parts) - np.arange(at, to)  # bytes to the end of the row, which n-grams don't pass
        gram = np.zeros(to - at, dtype=np.uint32)
        for n in range(1, max(SPECTRUM) + 1):
            more = code[n - 1 : n - 1 + to - at] + np.uint32(1)
            gram *= np.uint32(263)
            gram[: len(more)] += more
            if n not in SPECTRUM:
                continue
            bucket = ((gram + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            ok = left >= n
            out[(row + bucket)[ok]] = True
    return out.reshape(last - first, BUCKETS)


def _has_letter(part: pa.RecordBatch, texts: Texts) -> np.ndarray:
    at = np.flatnonzero(_ASCII_LETTER[texts.data])
    found = np.diff(np.searchsorted(at, texts.bounds)) > 0
    for i in np.flatnonzero(~found & (np.diff(texts.bounds) > 0)):
        found[i] = any(c.isalpha() for c in part.column(1)[i].as_py())
    return found


def held_out(id_col: str) -> F.Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2 (a null id is '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Model:
    """Languages and the weight of each n-gram bucket for each of them."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Softmax of one-versus-rest margins, by one matrix product for the batch."""
        norm = np.sqrt(np.maximum(x.sum(axis=1, dtype=np.float32), 1))[:, None]
        margin = (x.astype(np.float32) @ self.weights) / norm * SHARPNESS
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(packed: np.ndarray, labels: list[str]) -> Model:
    """Nyström features on landmarks, then one-versus-rest kernel ridge regression.

    ``packed`` has a row of presence bits a document; they are unpacked some rows
    at a time.  The features are linear in the presence vector but for its norm,
    so the landmarks fold into one weight matrix (buckets x languages).  Landmarks
    are the first rows of each language: the rows come in an order of chance.
    """

    def unit(rows: np.ndarray) -> np.ndarray:
        x = np.unpackbits(packed[rows], axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]

    languages = sorted(set(labels))
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    each = max(1, LANDMARKS // len(languages))
    chosen = np.concatenate([np.flatnonzero(np.array(labels) == name)[:each] for name in languages])
    marks = unit(chosen)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    use = value > 1e-6 * value.max()
    root = vector[:, use] / np.sqrt(value[use])
    every = np.arange(len(labels))
    kernel = np.concatenate([unit(every[i : i + _ROWS_AT_ONCE]) @ marks.T for i in range(0, len(every), _ROWS_AT_ONCE)])
    phi = kernel.astype(np.float64) @ root
    share = 1.0 / y.clip(0).sum(axis=0)  # languages weigh alike, however many rows each has
    weight = (y.clip(0) * share).sum(axis=1)
    weight /= weight.mean()
    ridge = np.linalg.solve(phi.T @ (phi * weight[:, None]) + RIDGE * np.eye(phi.shape[1]), phi.T @ (y * weight[:, None]))
    return Model(languages, (marks.T @ (root @ ridge).astype(np.float32)).astype(np.float32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from a bounded sample of the labelled rows with a letter outside the held-out fold; None without any.

    Rows are chosen by the hash of their id, about ``SAMPLE_PER_LANGUAGE`` of
    each language; the driver gets their packed presence bits, not their texts,
    and orders them by a hash of id and text.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & ~held_out(id_col) & F.col(text_col).rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return None
    each = min(SAMPLE_PER_LANGUAGE, max(1, SAMPLE_ROWS // len(counts)))
    limit = F.create_map(*(F.lit(v) for k, n in sorted(counts.items()) for v in (k, float(min(1.0, each / n)))))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.filter(draw < F.element_at(limit, F.col(lang_col))).limit(SAMPLE_ROWS)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, found = Texts(part.column(1)), []
                for i in range(0, len(texts), _ROWS_AT_ONCE):
                    found += [b.tobytes() for b in np.packbits(presence(texts, i, min(len(texts), i + _ROWS_AT_ONCE)), axis=1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.binary())], names=["lang", "place", "bits"])

    place = F.xxhash64(F.col(id_col), F.col(text_col), F.lit("place")).alias("place")
    rows = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place).mapInArrow(bits, "lang string, place long, bits binary").collect()
    rows = sorted((r["lang"], r["place"], bytes(r["bits"])) for r in rows)
    if not rows:
        return None
    return fit(np.array([np.frombuffer(b, dtype=np.uint8) for *_, b in rows]), [name for name, *_ in rows])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Language and score (0 to 1) of every whole text; only the text decides.

    ``und`` with score 0 for a null text, one without a letter, or without a
    model.  Ties go to the first language in order.  Repeated rows are judged
    alike; ``keep`` names columns to carry along; an empty table gives no rows.
    """
    schema = T.StructType([*(docs.schema[c] for c in (id_col, *keep)), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column(1))
                known = _has_letter(part, texts) if model else np.zeros(len(texts), dtype=bool)
                names, score = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
                for i in range(0, len(texts) if model else 0, _ROWS_AT_ONCE):
                    to = min(len(texts), i + _ROWS_AT_ONCE)
                    found = model.scores(presence(texts, i, to))
                    best = found.argmax(axis=1)
                    names[i:to] = np.array(model.languages, dtype=object)[best]
                    score[i:to] = found[np.arange(to - i), best]
                names[~known], score[~known] = UNDETERMINED, 0.0
                kept = [part.column(1) if c == text_col else x for c, x in zip(keep, part.columns[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *kept, pa.array(names.tolist(), pa.string()), pa.array(score)], names=schema.names)

    carried = [F.lit(None).alias(f"_keep{i}") if c == text_col else F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]  # the text goes once
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carried).mapInArrow(label, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train outside the held-out fold, then label every document: id, ``held_out``, ``lang_pred``, ``score``."""
    found = identify(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
