"""Words of many texts at once, as 64-bit hashes.

A word is a run of 0-9, a-z and code points from U+0080 on, after lower-casing A-Z.  In
UTF-8 that is a property of single bytes, so a whole batch of texts is cut by array
operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import U64, mix, random_words, text_buffer

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True
_IS_WORD[65:91] = True
_BYTE = random_words(256, 1)[_LOWER]
_STEP = U64(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """``hashes[first[d] : first[d + 1]]`` are the words of text ``d``."""

    hashes: np.ndarray
    first: np.ndarray

    def of(self, d: int) -> np.ndarray:
        return self.hashes[self.first[d] : self.first[d + 1]]


def batch_words(texts: pa.Array) -> Words:
    data, at = text_buffer(texts)
    inside = _IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(data)]
    begins[heads] |= inside[heads]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, at)
    if not len(starts):
        return Words(np.zeros(0, U64), first)
    lengths = np.add.reduceat(inside, starts, dtype=np.int64)
    from_byte = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(from_byte, lengths)
    power = np.cumprod(np.full(int(lengths.max()) + 1, _STEP, U64))
    values = _BYTE[data[inside]] * power[within]
    return Words(mix(np.add.reduceat(values, from_byte) + lengths.astype(U64)), first)


def word_hash(words: list[str]) -> np.ndarray:
    """Hashes of single words, as batch_words gives them."""
    return batch_words(pa.array(words, pa.string())).hashes


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, by the run's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out = out * _STEP + hashes[i : i + n]
    return mix(out)
