"""Words and shingles of whole Arrow batches of texts, hashed with numpy.

A word is a longest run of bytes other than space and 0x09-0x0D; A-Z count as a-z.  Hashes have 64 bits and
depend on nothing but the word, so they agree between workers and runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text whose hashes are in memory at once; a longer word is taken whole
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def numbers(count: int, seed: int) -> np.ndarray:
    """Fixed pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        at = np.arange(1, count + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)
    return mix(at) | _U(1)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = numbers(256, 11)[_LOWER]
_BYTE[_SPACE] = 0
_PLACE = numbers(1 << 12, 12)
_STEP = numbers(64, 13)


def _places(count: int) -> np.ndarray:
    global _PLACE
    if count > len(_PLACE):
        _PLACE = numbers(1 << int(count).bit_length(), 12)
    return _PLACE


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is the empty text."""
    column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch: byte places, hashes, and per text the range of its words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n + 1 places in the word arrays

    def of(self, text: int) -> np.ndarray:
        return self.hash[self.first[text]:self.first[text + 1]]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int | None = None) -> np.ndarray:
    """One hash per word; ``most``: of its first bytes only, for features on word beginnings."""
    out = np.empty(len(start), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK, "right")))
            s, low = start[at:to], start[at]
            part = data[low:end[to - 1]]
            length = np.diff(np.append(s, low + len(part)))
            place = np.arange(len(part)) - np.repeat(s - low, length)
            value = _BYTE[part] * _places(int(length.max()))[place]
            size = end[at:to] - s
            if most is not None:
                value[place >= most] = 0
                size = np.minimum(size, most)
            out[at:to] = np.add.reduceat(value, s - low) + size.astype(np.uint64)
            at = to
    return mix(out)


def words(column: pa.Array) -> Words:
    data, offsets = text_buffer(column)
    start, end, first = word_places(data, offsets)
    return Words(start, end, hash_words(data, start, end), first)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` words; shorter texts have one, of all their words, or none."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(width, n)
    with np.errstate(over="ignore"):
        total = hashes[:n - size + 1] * _STEP[0]
        for i in range(1, size):
            total = total + hashes[i:n - size + 1 + i] * _STEP[i]
        return mix(total + _U(size))


def batch_shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``width`` words inside one text, for a whole batch at once."""
    n = len(found.hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = found.hash[:n] * _STEP[0]
        for i in range(1, width):
            total = total + found.hash[i:n + i] * _STEP[i]
        total = mix(total + _U(width))
    last = np.repeat(found.first[1:], np.diff(found.first))[:n]
    at = np.flatnonzero(np.arange(n) + width <= last)
    return total[at], at


def portions(batch: pa.RecordBatch, column: int = 1, most: int = 4 << 20):
    """Slices of a batch with about ``most`` bytes of text each; a longer text is a slice of its own."""
    sizes = np.cumsum(np.diff(text_buffer(batch.column(column))[1]))
    at = 0
    while at < len(batch):
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def prefix_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """Hashes of the first bytes of every word, one row per length; a shorter word counts as it is."""
    out = np.empty((len(lengths), len(start)), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK, "right")))
            s, low, size = start[at:to], start[at], (end - start)[at:to]
            part = data[low:end[to - 1]]
            place = np.arange(len(part)) - np.repeat(s - low, np.diff(np.append(s, low + len(part))))
            value = _BYTE[part] * _places(int(place.max()) + 1)[place]
            for row, most in enumerate(lengths):
                kept = np.where(place < most, value, _U(0))
                out[row, at:to] = np.add.reduceat(kept, s - low) + np.minimum(size, most).astype(np.uint64)
            at = to
    return mix(out)
