"""Texts cut into the pieces of a split pattern, and a memory of what pieces were encoded to."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from sys import getsizeof

import numpy as np
import regex

_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
#: Characters on which SIMPLE is the same as the pattern of the public byte-level vocabularies.
_OTHER = re.compile(f"[^\t\n\r -~{_LATIN}]")
_SIMPLE = re.compile(
    rf" ?[{_LATIN}]++| ?[0-9]++|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s0-9{_LATIN}]++|\s+(?!\S)|\s+"
)
#: The pattern that SIMPLE stands for; any other pattern is used as it is.
_KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Pieces that, one after the other, are cut into themselves.
WORD = re.compile(f" [{_LATIN}]+")
#: Those of them that are ASCII.
PLAIN = re.compile(b" [A-Za-z]+")

#: What SIMPLE tells apart, by byte; in texts that it can cut, all bytes from 128 on are of letters.
_SPACE, _LETTER, _DIGIT, _REST, _NEVER = range(5)
_KIND = np.full(256, _NEVER, np.uint8)
_KIND[33:127] = _REST
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[0x80:0xC0] = _KIND[0xC3:0xCA] = _LETTER


def _texts_at(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers of the texts that hold the given places of the buffer."""
    return np.searchsorted(at, places, "right") - 1


def latin_pieces(data: np.ndarray, at: np.ndarray, whole: Iterable[bytes] = ()) -> np.ndarray:
    """Where the pieces begin that SIMPLE cuts texts into, given as one UTF-8 buffer and its offsets.

    A text that SIMPLE cannot cut, or in which an entry of ``whole`` begins, is one piece.
    """
    kind = _KIND[data]
    first = np.zeros(len(data) + 1, bool)  # of a text
    first[at] = True
    begins = first.copy()
    begins[1:-1] |= kind[1:] != kind[:-1]
    # the last of some blanks goes with what follows if it is a space, else it stands alone
    blank = kind == _SPACE
    last = blank[:-1] > (blank[1:] | first[1:-1])
    begins[:-2] |= last
    begins[1:-1] &= ~(last & (data[:-1] == 32))
    # an apostrophe that begins a piece takes one or two letters along
    marks = np.flatnonzero(data == 39)
    marks = marks[begins[marks]]
    after = np.concatenate([data, np.zeros(2, np.uint8)])
    end = at[_texts_at(at, marks) + 1]
    one, two = after[marks + 1], after[marks + 2]
    for letters, size in ((np.isin(one, list(b"stmd")), 2),
                          (np.isin(one, list(b"rv")) & (two == 101) | (one == 108) & (two == 108), 3)):
        found = marks[letters & (marks + size <= end)]
        begins[found + 1] = False
        begins[found + size] = True
    odd = np.flatnonzero(kind == _NEVER)
    lead = np.flatnonzero((data == 0xC3) | (data == 0xC9))
    then = after[lead + 1]
    # multiplication and division sign, and what follows the last Latin letter
    no_letter = np.where(data[lead] == 0xC3, (then == 0x97) | (then == 0xB7), then > 0x8F)
    kept = set(np.unique(_texts_at(at, np.concatenate([odd, lead[no_letter]]))).tolist())
    raw = data.tobytes() if whole else b""
    for token in whole:
        place = raw.find(token)
        while 0 <= place < len(raw):
            text = int(_texts_at(at, place))
            kept.add(text)
            place = raw.find(token, at[text + 1])
    for text in kept:
        begins[at[text] + 1 : at[text + 1]] = False
    return np.flatnonzero(begins[:-1])


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Cuts a text into the matches of ``pattern``."""
    full = regex.compile(pattern).findall
    if pattern != _KNOWN:
        return full
    simple, other = _SIMPLE.findall, _OTHER.search
    return lambda text: full(text) if other(text) else simple(text)


#: Length of the longest piece that is remembered.
SHORT = 64


#: Bytes that remembered pieces may take, and what each takes beside its own objects.
REMEMBERED, ENTRY = 96 << 20, 100


class Codes:
    """Remembers what pieces were encoded to; ``encode`` is asked for new ones, many at a time.

    A code is a tuple of bytes.  The memory is bounded to ``most`` bytes: when half of that is
    full, the pieces not met since the half before are forgotten, which costs time, not results.
    """

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], Iterable], most: int = REMEMBERED):
        self.split, self.encode, self.most = split, encode, most
        self.known, self.before, self.held = {}, {}, 0

    def of(self, texts: list[str]) -> list[list]:
        """The codes of each text's pieces, in order."""
        known, out = self.known, []
        for text in texts:
            pieces = self.split(text)
            out.append(list(map(known.get, pieces, pieces)))  # a new piece stands for itself
        new = {c for codes in out for c in codes if c.__class__ is str}
        if new:
            fresh = {u: self.before[u] for u in new if u in self.before}
            asked = [u for u in new if u not in fresh]
            fresh.update(zip(asked, self.encode(asked)))
            out = [[fresh[c] if c.__class__ is str else c for c in codes] for codes in out]
            self._remember(fresh)
        return out

    def _remember(self, fresh: dict) -> None:
        for u, code in fresh.items():
            if len(u) <= SHORT:
                self.known[u] = code
                self.held += getsizeof(u) + getsizeof(code) + sum(map(getsizeof, code)) + ENTRY
                if 2 * self.held >= self.most:
                    self.before, self.known, self.held = self.known, {}, 0


class Memory:
    """Remembers as Codes does, for pieces as bytes that were cut elsewhere."""

    def __init__(self, encode: Callable[[list[bytes]], Iterable], most: int = 1_000_000):
        self.encode, self.most, self.known = encode, most, {}

    def each(self, pieces: list[bytes]) -> list:
        """The codes of pieces that all differ."""
        if len(self.known) > self.most:
            self.known.clear()
        out = list(map(self.known.get, pieces))
        new = [u for u, code in zip(pieces, out) if code is None]
        if new:
            fresh = list(self.encode(new))
            self.known.update(zip(new, fresh))
            for u in new:
                if len(u) > SHORT:
                    del self.known[u]
            left = iter(fresh)
            out = [next(left) if code is None else code for code in out]
        return out
