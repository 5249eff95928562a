"""Unit tables: texts are cut at white space, distinct units are encoded once.

A unit is a run of white space with what follows it up to the next run, cut once
more where a sign follows a letter. Neither of the tokenizers used here lets a
token cross the border between two units, so ids of a text are those of its
units, joined by array lookups.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

from simloom.llm.shared import text_buffer

#: Bytes that remembered units may take, by an estimate; a full table starts afresh.
TABLE_BYTES = 48 << 20
#: What a unit takes beside its text and ids: string and number objects, a place in the dict.
UNIT_BYTES = 190
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 12 << 20

#: Classes of bytes: 0 other, 1 white space, 2 visible, 3 letter, 4 sign, 5 lead byte of
#: U+00C0 to U+01FF (all visible), 6 continuation byte. Signs are those that never belong
#: to what a letter before them begins; the brackets of special tokens are not among them.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 2
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 3
_CLASS[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = 4
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = 1
_CLASS[0xC3:0xC8] = 5
_CLASS[0x80:0xC0] = 6
#: By classes of a byte and the next: 1 a border, 2 a border if the byte before was a lead byte.
_BORDER = np.zeros(64, np.uint8)
_BORDER[[2 * 8 + 1, 3 * 8 + 1, 4 * 8 + 1, 3 * 8 + 4]] = 1
_BORDER[6 * 8 + 1] = 2


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts as strings, and the number of the first unit of each text.

    A unit begins where white space follows a byte that is surely none.
    """
    mark = np.zeros(len(data) + 1, bool)
    if len(data):
        kind = _CLASS[data]
        border = _BORDER[(kind[:-1] << 3) | kind[1:]]
        mark[1:-1] = border == 1
        maybe = np.flatnonzero(border == 2)
        mark[maybe[kind[maybe - 1] == 5] + 1] = True
    mark[offsets] = True
    borders = np.flatnonzero(mark)
    # Borders of empty texts coincide; each still needs a first unit.
    first = np.searchsorted(borders, offsets)
    strings = pa.StringArray.from_buffers(
        len(borders) - 1, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))
    )
    return strings, first


def take(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``flat[offsets[i]:offsets[i + 1]]`` for each i, joined."""
    sizes = offsets[which + 1] - offsets[which]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(offsets[which] - ends + sizes, sizes)]


class UnitTable:
    """Token ids of units, by a function that encodes a list of new ones."""

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], fold: np.ndarray | None = None, limit: int = TABLE_BYTES):
        """``fold`` maps bytes to those that the encoder treats alike, where no special token can arise."""
        self.encode, self.fold, self.limit = encode, fold, limit
        self.clear()

    def clear(self) -> None:
        self.held = 0
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.offsets = np.zeros(1, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        runs = self.encode(fresh)
        base = len(self.index)
        self.index.update(zip(fresh, range(base, base + len(fresh))))
        self.held += sum(map(len, fresh)) + UNIT_BYTES * len(fresh)
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        more = np.fromiter((x for r in runs for x in r), np.uint32, int(sizes.sum()))
        self.flat = np.concatenate([self.flat, more])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])

    def encode_texts(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column; null is empty."""
        data, offsets = text_buffer(column)
        if self.fold is not None and not ((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any():  # no "<|"
            data = self.fold[data]
        strings, first = units(data, offsets)
        coded = strings.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        fresh = [u for u in distinct if u not in self.index]
        if fresh:
            if self.held > self.limit:
                self.clear()
                fresh = distinct
            self._learn(fresh)
        known = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        which = known[coded.indices.to_numpy()]
        ids = take(self.flat, self.offsets, which)
        ends = np.concatenate([[0], np.cumsum(self.offsets[which + 1] - self.offsets[which])])[first]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
