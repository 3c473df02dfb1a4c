"""Words of whole texts as bytes, and statistics of them.

A word is a run of bytes other than the blank and \\x09 to \\x0D, the only ones that bytes.split() parts at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered by one Python worker at most; beyond it the memory starts anew.
MEMO = 200_000
_WHITE, _FOLLOWING, _SYMBOLS = b" \t\n\x0b\x0c\r", bytes(range(0x80, 0xC0)), b"#*$%&|<>"


def texts_of(batch, column: str = "text") -> list[bytes]:
    """Null texts are empty."""
    return pc.fill_null(batch.column(column).cast(pa.large_binary()), b"").to_pylist()


class Hashes(dict):
    """word -> a hash of it that is the same on every machine."""

    def __init__(self, of=zlib.crc32, dtype=np.uint32):
        self.of, self.dtype = of, dtype

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = self.of(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=self.dtype, count=len(words))


def word_chars(text: bytes) -> int:
    """Code points in words."""
    return len(text.translate(None, _WHITE + _FOLLOWING))


def count_of(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def n_symbols(text: bytes) -> int:
    return count_of(text, _SYMBOLS)


def n_dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, from 0."""
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    return np.array([put(x, len(seen)) for x in words], dtype=np.int64)


def n_repeat_words(numbers: np.ndarray) -> int:
    """Words in three-word windows that the text has twice or more."""
    if len(numbers) < 4:
        return 0
    if int(numbers.max()) < 1 << 21:
        key = (numbers[:-2] << 42) | (numbers[1:-1] << 21) | numbers[2:]
    else:  # two words that follow one another get a number, then three do
        two = np.unique((numbers[:-1] << 32) | numbers[1:], return_inverse=True)[1]
        key = (two[:-1] << 32) | numbers[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    found = np.zeros(len(key), dtype=bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    covered = np.zeros(len(numbers), dtype=bool)
    for k in range(3):
        covered[k : k + len(key)] |= found
    return int(covered.sum())
