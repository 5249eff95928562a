"""Words and shingles of whole texts as 64-bit hashes, in numpy.

Bytes get random weights; the hash of a word is the polynomial of its bytes,
taken from running sums, then mixed. Words are found bytewise: the separators of
both word patterns used here are ASCII, so UTF-8 needs no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
#: Bytes that one step hashes; longer texts are cut between words.
STEP_BYTES = 1 << 20
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_JOIN = _U(0xD1342543DE82EF95)

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: a-z, 0-9 and all beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_WEIGHTS = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        for k, b in enumerate((_BASE, _INVERSE)):
            table = np.full(size, b, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word never crosses a row offset."""
    inside = word[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    rows = offsets[(offsets > 0) & (offsets < len(data))]
    begin[rows] = inside[rows]
    end[rows - 1] = inside[rows - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span, the same wherever the span lies."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + STEP_BYTES, side="right")))
        part = data[low : ends[stop - 1]]
        powers, inverse = _power_tables(len(part) + 1)
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_WEIGHTS[part] * powers[: len(part)], out=sums[1:])
        a, b = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        at = stop
    return out


def hashed_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and the number of the first word of each row."""
    data = LOWER[data]
    starts, ends = word_spans(data, offsets, word)
    return hash_spans(data, starts, ends), np.searchsorted(starts, offsets)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k successive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] + _U(k)
    for i in range(1, k):
        out *= _JOIN
        out += words[i : i + n]
    return mix(out)


def row_grams(words: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row, the hashes of its k-grams; of fewer words, the one of all."""
    everywhere = grams(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield everywhere[a : b - k + 1]
        else:
            yield grams(words[a:b], b - a) if b > a else words[a:a]
