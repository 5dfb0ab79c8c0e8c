"""Best-fit packing of tokenised documents, planned over the length histogram."""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.llm.ranking import with_global_rank
from turnmill.llm.wordhash import Texts, Words, slices

SEPARATOR = 0  # id that ends each document
CACHED_WORDS = 1_000_000  # of a Python worker's word cache, which starts anew when it is full
_PIECES = 200_000
# The rules of the default vocabulary's file, by which a text's words can be encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
# The same pattern for the characters of a plain word.
_LATIN = "\u00df-\u00f6\u00f8-\u00ff"
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z{_LATIN}0-9]+").findall
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
#: The byte-level alphabet: a byte that isn't printable stands as a character from 256 on, in byte order.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTE_LETTERS = {c: "".join(chr(b) if b in _SHOWN else chr(256 + _HIDDEN.index(b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}

_workers: dict = {}  # of this Python worker, so that its later tasks know the words

_IDS = T.ArrayType(T.IntegerType())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenised_pieces(docs: DataFrame, size: int, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of each document: its ids, then ``SEPARATOR``, cut every ``size`` tokens.

    Returns id, ``piece``, ``start``, ``length``, ``ids_crc32`` and, with
    ``with_ids``, ``ids``.  A vocabulary file with the default's rules splits at
    white space, so each distinct word is encoded once for a task and the ids are
    gathered by array indexing; with any other ``tokenizer`` file whole texts are
    encoded.  A null text is empty and gives the separator alone.
    """
    path = tokenizer or default_tokenizer()
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    schema = T.StructType([*fields, *([T.StructField("ids", _IDS)] if with_ids else [])])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _workers.get(path) or WordIds(path)
        _workers[path] = words
        for batch in batches:
            for part in slices(batch, "text"):
                yield _pieces(part, words, size, with_ids, [f.name for f in fields])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, schema)


class WordIds:
    """Token ids by word hash: sorted keys, and the ids of all known words in one flat pool."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces = Tokenizer.from_file(path), {}
        rules = json.loads(self.tokenizer.to_str())
        self.by_word = rules["normalizer"] == _NORMALIZER and rules["pre_tokenizer"] == _PRE_TOKENIZER and rules["model"]["type"] == "BPE"
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(1 << 20, dtype=np.uint32)
        self.first, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.used = 0

    def of(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All documents' ids in one array (a separator after each document), and each document's end in it."""
        if not self.by_word:
            return self._of_texts(texts)
        words = Words(texts)
        distinct, example, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > CACHED_WORDS:
            self.clear()
        place = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), dtype=bool)
        if len(self.keys):
            new = self.keys[np.minimum(place, len(self.keys) - 1)] != distinct
        if new.any():
            chosen = example[new]
            self._learn(distinct[new], place[new], texts.data, words.start[chosen], words.end[chosen])
        at = self.slots[np.searchsorted(self.keys, distinct)][inverse]
        first, size = self.first[at], self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        row = words.row_of()
        out = np.zeros(total + len(texts), dtype="<u4")
        order = np.arange(total)
        out[order + np.repeat(row, size)] = self.pool[order + np.repeat(first - (ends - size), size)]
        through = np.r_[0, ends][words.first[1:]]
        return out, through + np.arange(1, len(texts) + 1)

    def _of_texts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        raw, bounds = texts.data.tobytes(), texts.bounds.tolist()
        whole = [raw[a:b].decode("utf-8") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        ids = [np.array([*e.ids, SEPARATOR], dtype="<u4") for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        return np.concatenate(ids) if ids else np.zeros(0, dtype="<u4"), np.cumsum([len(x) for x in ids], dtype=np.int64)

    def _learn(self, keys: np.ndarray, place: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        raw = data.tobytes()
        flat, sizes = self._encode([raw[a:b].decode("utf-8") for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        size = np.array(sizes, dtype=np.int64)
        self.slots = np.insert(self.slots, place, np.arange(len(keys)) + len(self.first))
        self.keys = np.insert(self.keys, place, keys)
        self.first = np.concatenate([self.first, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(flat)

    def _encode(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of each word.  A plain word (printable ASCII and Latin-1 letters) is cut into the vocabulary's
        own pieces here and each piece goes to the model; any other goes through the whole tokenizer."""
        tokenize, known, flat, sizes = self.tokenizer.model.tokenize, self.pieces, [], []
        if len(known) > _PIECES:
            known.clear()
        for word in words:
            before = len(flat)
            if _PLAIN(word) and "<|" not in word:
                low = word.lower()
                for piece in (low,) if low.isalpha() else _CUT(low):
                    ids = known.get(piece)
                    if ids is None:
                        ids = known[piece] = [t.id for t in tokenize(piece if piece.isascii() else piece.translate(_BYTE_LETTERS))]
                    flat += ids
            else:
                flat += self.tokenizer.encode(word, add_special_tokens=False).ids
            sizes.append(len(flat) - before)
        return flat, sizes


def _pieces(part: pa.RecordBatch, words: WordIds, size: int, with_ids: bool, names: list[str]) -> pa.RecordBatch:
    ids, ends = words.of(Texts(part.column(1)))
    rows, piece, start, length, crc, first = [], [], [], [], [], 0
    cuts = [0]
    for i, end in enumerate(ends.tolist()):
        for k, at in enumerate(range(first, end, size)):
            to = min(at + size, end)
            rows.append(i)
            piece.append(k)
            start.append(at - first)
            length.append(to - at)
            crc.append(zlib.crc32(ids[at:to]))
            cuts.append(to)
        first = end
    columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))))
    return pa.RecordBatch.from_arrays(columns, names=[*names, *(["ids"] if with_ids else [])])


def plan_best_fit(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of equal lengths.

    Returns (length, first rank, end rank, first sequence, offset): the pieces of
    that length and those ranks take that offset in consecutive sequences.  Open
    sequences of equal room are kept as intervals, so the work follows the number
    of distinct lengths (``size`` at most), not that of documents.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> (first sequence, sequences)
    plan, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            fit = next((r for r in range(length, size) if room.get(r)), None)
            if fit is None:
                each = size // length
                full, rest = divmod(left, each)
                for sequences, per in ((full, each), (1, rest)):
                    if not sequences or not per:
                        continue
                    for i in range(per):
                        plan.append((length, rank, rank + sequences, opened, i * length))
                        rank += sequences
                    if size > per * length:
                        room[size - per * length].append((opened, sequences))
                    opened += sequences
                break
            base, sequences = room[fit].pop()
            taken = min(left, sequences)
            if sequences > taken:
                room[fit].append((base + taken, sequences - taken))
            plan.append((length, rank, rank + taken, base, size - fit))
            if fit > length:
                room[fit - length].append((base, taken))
            rank, left = rank + taken, left - taken
    return plan


def pack(pieces: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Give every piece its ``sequence_id`` and ``offset`` in sequences of ``size`` tokens.

    The histogram of lengths (``size`` rows at most) is all the driver sees; each
    piece finds its planned slot by its rank within its length.  A length shared
    by a third of all pieces is ranked by many tasks (see ``ranking``).  ``order``
    fixes ranks; pieces equal in all of it take slots in any order.
    """
    ranked, sums = with_global_rank(pieces, "length", order)
    histogram = {int(r["_group"]): int(r["rows"]) for r in sums.select("_group", "rows").collect()}
    plan = sorted(plan_best_fit(histogram, size))
    table = np.array(plan, dtype=np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # bounded: a few intervals a length
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        keys = (slots[:, 0] << 44) + slots[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("rank")).to_numpy(zero_copy_only=False)
            slot = slots[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            kept = [c for c in names if c not in ("rank", "before")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(c)) for c in kept), pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])],
                names=[*kept, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack all documents; see ``tokenised_pieces`` and ``pack``.

    Null and empty texts give one piece of one token, repeated rows are packed
    like any others, an empty table gives no rows, other columns are ignored.
    """
    return pack(tokenised_pieces(docs, size, tokenizer, id_col, text_col), size, [id_col, "piece", "ids_crc32"])
