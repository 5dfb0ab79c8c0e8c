"""Vectorised word hashing of Arrow string arrays (the inner step of several operators).

Spark partitions the rows; inside a task these helpers turn a slice of an Arrow
string column into word positions and 64-bit word hashes with a fixed number of
NumPy passes, so no Python loop runs over characters or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BLOCKS = 1 << 17  # 8-byte blocks that are hashed at once

BYTES = np.arange(256)
SPACES = (BYTES == 0x20) | ((BYTES >= 0x09) & (BYTES <= 0x0D))
#: Words of the "blank" kind end at ASCII white space; of the "alnum" kind at any
#: ASCII character that is neither a digit nor a letter.
BLANK_WORD = ~SPACES
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)
ALNUM_WORD = ((BYTES >= 0x30) & (BYTES <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A)) | (BYTES >= 0x80)
SAME = BYTES.astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """A slice of an Arrow string array: its bytes and the byte bounds of each row.

    A null row has no bytes; ``valid`` tells nulls from empty texts.
    """

    def __init__(self, array: pa.Array):
        if isinstance(array, pa.ChunkedArray):
            array = array.combine_chunks()
        wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
        n, first = len(array), array.offset
        _, bounds, data = array.buffers()
        if n:
            offsets = np.frombuffer(bounds, dtype=np.int64 if wide else np.int32, count=first + n + 1)[first:].astype(np.int64)
        else:
            offsets = np.zeros(1, dtype=np.int64)
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.bounds = offsets - offsets[0]
        self.valid = np.asarray(array.is_valid()) if n else np.zeros(0, bool)

    def __len__(self) -> int:
        return len(self.valid)


def slices(batch: pa.RecordBatch, column: str, limit: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` of about ``limit`` text bytes each (a longer text stands alone)."""
    texts = Texts(batch.column(batch.schema.get_field_index(column)))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(texts.bounds, texts.bounds[start] + limit, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield batch.slice(start, end - start)
        start = end


class Words:
    """Word bounds and hashes of ``texts``; ``first[i]:first[i + 1]`` are the words of row i."""

    def __init__(self, texts: Texts, is_word: np.ndarray = BLANK_WORD, fold: np.ndarray = SAME, hashes: bool = True):
        data, bounds = texts.data, texts.bounds
        inside = is_word[data]
        before = np.empty(len(data), dtype=bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
            rows = bounds[:-1][bounds[:-1] < len(data)]
            before[rows] = False
            self.start = np.flatnonzero(inside & ~before)
            after = np.empty(len(data), dtype=bool)
            after[-1] = False
            after[:-1] = inside[1:]
            after[rows[rows > 0] - 1] = False
            self.end = np.flatnonzero(inside & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)
        self.hash = _hash_spans(data, self.start, self.end, fold) if hashes else None

    def only(self, keep: np.ndarray, back: np.ndarray) -> Words:
        """The words of the rows to keep, without hashes, each kept row's moved back by so many bytes."""
        part, own = Words.__new__(Words), np.repeat(keep, self.count)
        part.count = self.count[keep]
        shift = np.repeat(back, part.count)
        part.start, part.end, part.hash = self.start[own] - shift, self.end[own] - shift, None
        part.first = np.concatenate([[0], np.cumsum(part.count)])
        return part

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k - 1 words of a row have none that counts."""
        return gram_hashes(self.hash, k)

    def gram_ok(self, k: int) -> np.ndarray:
        """True where k words of the same row follow (the word itself included)."""
        ends = np.repeat(self.first[1:], self.count)
        return np.arange(len(self.start)) + k <= ends


def gram_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of the k words from each word on; another ``salt`` gives hashes that are independent of the first."""
    n = len(words)
    total = np.zeros(n, dtype=np.uint64)
    factor = 1 + salt
    for i in range(min(k, n)):
        factor = (factor * int(_M2) + 2 * k) % 2**64
        total[: n - i] += words[i:] * np.uint64(factor | 1)
    return mix(total)


def hash_spans(texts: Texts, start: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    return _hash_spans(texts.data, start, end, fold)


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans (ascending, apart).

    A span is cut into blocks of eight bytes from its own start.  Each block is
    mixed together with its place before the blocks are summed, so that no
    arithmetic between blocks (as in a polynomial modulo 2**64) makes unlike
    spans collide.
    """
    out = np.empty(len(start), dtype=np.uint64)
    blocks = (end - start + 7) >> 3
    total = np.cumsum(blocks)
    i, n = 0, len(start)
    while i < n:
        done = int(total[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + _BLOCKS, side="right")))
        base, top = int(start[i]), int(end[j - 1])
        piece = np.zeros(top - base + 8, dtype=np.uint8)
        piece[:-8] = data[base:top] if fold is SAME else fold[data[base:top]]
        eight = np.ndarray(len(piece) - 7, dtype="<u8", buffer=piece.data, strides=(1,))  # the eight bytes from each byte on
        size, own = end[i:j] - start[i:j], blocks[i:j]
        if int(own.max(initial=0)) <= 1:
            rest, value, place, first = size, eight[start[i:j] - base], np.uint64(1), None
        else:
            first = np.cumsum(own) - own
            at = np.arange(int(own.sum())) - np.repeat(first, own)
            value = eight[np.repeat(start[i:j] - base, own) + (at << 3)]
            rest = np.repeat(size, own) - (at << 3)
            place = at.astype(np.uint64) + np.uint64(1)
        value = value & (~np.uint64(0) >> ((8 - np.minimum(rest, 8)) << 3).astype(np.uint64))
        mixed = mix(value * _M2 + mix(np.atleast_1d(place * _M1)))
        if first is not None:
            mixed = np.add.reduceat(mixed, first)
        out[i:j] = mix(mixed + size.astype(np.uint64) * _M1)
        i = j
    return out
