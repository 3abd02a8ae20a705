"""Vectorised words of Arrow text batches: byte-class tokenisation and window hashes in numpy.

A word is a maximal run of bytes of a class. All classes used here hold every byte >= 0x80 or
only ASCII separators outside, so byte runs equal code-point runs in UTF-8.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_U = np.uint64


def _class(outside: list[range]) -> np.ndarray:
    table = np.ones(256, np.bool_)
    for r in outside:
        table[list(r)] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = _class([range(0x20, 0x21), range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z
ALNUM = _class([range(0x00, 0x30), range(0x3A, 0x61), range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public splitmix64 constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Starting values of independent hashes.
SEEDS = np.random.RandomState(11).randint(1, 1 << 62, 4, dtype=np.int64).astype(np.uint64)
#: Ranges of more bytes than this are digested one by one.
LONG = 256
#: Of the first k bytes of an eight.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number each; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each byte range, chained over its groups of eight bytes (no polynomial); long ranges by a keyed digest."""
    size = end - start
    chunks = eights(data)
    h = mix(size.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + SEEDS[seed])
    h = mix(h ^ (chunks[start] & MASKS[np.minimum(size, 8)]))
    live = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while len(live):
        left = np.minimum(size[live] - at, 8)
        h[live] = mix((h[live] + SEEDS[3]) ^ (chunks[start[live] + at] & MASKS[left]))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=int(SEEDS[seed]).to_bytes(8, "little")).digest(), "little")
    return h


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two neighbours, order kept."""
    x = a * _U(0x9E3779B97F4A7C15) + b
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash of each run of ``length`` values, joined from runs of powers of two."""
    n, out, done, width, power = len(hashes), None, 0, 1, hashes
    if n < length:
        return np.zeros(0, np.uint64)
    while True:
        if length & width:
            m = n - done - width + 1
            out = power[:m] if out is None else _join(out[:m], power[done : done + m])
            done += width
        if done == length:
            return out[: n - length + 1]
        power = _join(power[:-width], power[width:])
        width *= 2


@dataclass
class Words:
    """Words of consecutive documents: byte range of each, and first[d]:first[d + 1] are document d's."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    ends_at: int = 0

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return byte_hashes(self.data, self.start, self.end, seed)

    def windows(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``length`` words inside one document, and the run's first word."""
        at = window_starts(self.first, length)
        return mix(runs(hashes, length)[at] ^ _U(length)), at

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def join(self, a: int, b: int, keep: np.ndarray | None = None) -> bytes:
        picks = range(a, b) if keep is None else (np.flatnonzero(keep) + a).tolist()
        raw = self.data
        return b" ".join([raw[s:e].tobytes() for s, e in zip(self.start[picks].tolist(), self.end[picks].tolist())])


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Indexes of words with ``length - 1`` more words of the same document behind them."""
    n = int(first[-1])
    ok = np.ones(n, np.bool_)
    left = np.minimum(np.diff(first), length - 1)
    if left.any():
        off = np.repeat(first[1:] - left, left) + (np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left))
        ok[off] = False
    return np.flatnonzero(ok)


def tokenize(texts: pa.Array, table: np.ndarray = SPACED, lower: bool = False) -> Words:
    """Words of every whole text; a null has none."""
    texts = texts.cast(pa.large_binary())
    n, off = len(texts), np.zeros(1, np.int64)
    if n:
        buffers = texts.buffers()
        off = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if n and off[-1] > off[0] else np.zeros(0, np.uint8)
    if lower:
        data = LOWER[data]
    off = off - off[0]
    inside = table[data]
    edge = np.zeros(len(data) + 1, np.bool_)
    edge[off] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    if len(data):
        ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, off))


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text (a longer text stands alone)."""
    col = batch.column(batch.schema.get_field_index(column))
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, i, n = np.cumsum(sizes), 0, batch.num_rows
    while i < n:
        base = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, base + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def lean(run: Callable) -> Callable:
    """run, whose worker gives freed memory back to the system when a task ends: idle workers stay small while other stages run."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
            if trim:
                trim(0)

    return task
