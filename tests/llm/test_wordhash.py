"""Word hashes: equal words only, whatever their arithmetic, place, length and neighbours."""

import random

import numpy as np
import pyarrow as pa
import pytest

from turnmill.llm import wordhash
from turnmill.llm.wordhash import BLANK_WORD, LOWER, Texts, Words, gram_hashes


def thue_morse(n, letters):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def mirrored(n):
    """Two words whose polynomial hashes are equal modulo 2 ** 64 for every odd base."""
    return thue_morse(n, "ab"), thue_morse(n, "ba")


@pytest.mark.parametrize("n", [1024, 2048, 4096, 16384])
def test_thue_morse_words_differ(n):
    a, b = Words(Texts(pa.array([" ".join(mirrored(n))]))).hash
    assert a != b


@pytest.mark.parametrize("blocks", [1, 3, 1 << 17])
def test_hashes_depend_on_the_word_alone(monkeypatch, blocks):
    monkeypatch.setattr(wordhash, "_BLOCKS", blocks)
    rng = random.Random(blocks)
    words = ["".join(rng.choice("abZé日\x00") for _ in range(rng.randint(1, 40))) for _ in range(800)]
    words += ["x" * 7, "x" * 8, "x" * 9, "x" * 16, "x" * 17, "y" * 5000, "12345678" * 2, "1234567812345679"]
    known = {}
    for part in ([" ".join(words)], [None, "", " \n".join(reversed(words)), words[3]]):
        found = Words(Texts(pa.array(part, pa.string())))
        said = [w for t in part for w in (t or "").split()]
        for w, h in zip(said, found.hash.tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    a, b, c = Words(Texts(pa.array(["ABCdefghIJ abcDEFGHij abcDEFGHié"])), BLANK_WORD, LOWER).hash
    assert a == b != c


def test_second_hashes_are_independent():
    words = np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)
    assert not (gram_hashes(words, 5) == gram_hashes(words, 5, 1)).any()
