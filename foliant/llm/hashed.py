"""Words of whole Arrow columns as 64-bit hashes, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once, about.
CHUNK = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S8 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(8)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOW = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another (ends: where each ends), and the number of words of each."""
    none = np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    if not len(data):
        return none
    word = ~_BLANK[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    heads = np.append(0, ends[:-1])
    heads = heads[heads < len(data)]
    begin[heads] = word[heads]  # a word doesn't go on from one text into the next
    starts = np.flatnonzero(begin)
    if not len(starts):
        return none
    # a word's hash adds up what each byte at its place gives
    at = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    x = mix((_LOW[data[starts[0] :]] | (at.astype(np.uint64) << _S8)) + MIX)
    x *= word[starts[0] :]
    return np.add.reduceat(x, starts - starts[0]), np.diff(np.searchsorted(starts, ends), prepend=0)


def words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For stretches of the column: the hashes of all words (white space is space and U+0009 to U+000D, A-Z lower-cased), and how many each text has."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield _words(data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i])
        i = j
