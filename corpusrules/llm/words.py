"""Words of whole texts as flat numpy arrays: one pass over UTF-8 bytes, a 64-bit hash per word, no Python loop per word.

Everything here works on one Arrow array of texts, in pieces of about ``PIECE`` bytes (a longer text is a piece of its
own), so memory follows the longest text, not the batch.  Null texts have no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from typing import NamedTuple, TypeVar

import numpy as np
import pyarrow as pa

PIECE = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of words ``[^\x20\x09-\x0D]+``: everything but ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False


Item = TypeVar("Item")


def release() -> None:
    """Gives memory that Arrow and the C library keep for later back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(batches: Iterable[Item]) -> Iterator[Item]:
    """The batches; what one of them took is given back before the next."""
    for batch in batches:
        yield batch
        release()


class Words(NamedTuple):
    """Words of rows ``first`` to ``last`` (exclusive): byte bounds in ``data``, and each word's row within the piece."""

    first: int
    last: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    def bounds(self) -> np.ndarray:
        """Where each row's words begin, with the total at the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offset of each; a null is as long as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if len(texts) else pa.array([], pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, bounds


def pieces(bounds: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield first, last
        first = last


def split_words(texts: pa.Array, kept: np.ndarray = SPACED) -> Iterator[Words]:
    """A-Z lower-cased, cut at every byte outside ``kept``."""
    flat, bounds = text_buffer(texts)
    for first, last in pieces(bounds):
        offsets = bounds[first : last + 1] - bounds[first]
        data = _LOWER[flat[bounds[first] : bounds[last]]]
        inside = kept[data]
        size = len(data)
        before = np.zeros(size + 1, dtype=bool)
        before[1:] = inside
        after = np.zeros(size + 1, dtype=bool)
        after[:size] = inside
        edge = np.zeros(size + 1, dtype=bool)
        edge[offsets] = True
        start = np.flatnonzero(after & (~before | edge))
        end = np.flatnonzero(before & (~after | edge))
        row = np.searchsorted(offsets, start, "right") - 1
        yield Words(first, last, data, start, end, row)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def hash_words(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes a step."""
    padded = np.zeros(len(words.data) + 8, np.uint8)
    padded[: len(words.data)] = words.data
    eights = np.ndarray((len(words.data) + 1,), "<u8", padded, strides=(1,))
    length = (words.end - words.start).astype(np.int64)
    hashed = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(length)), words.start
    left = length
    while len(live):
        value = eights[at]
        short = np.minimum(left, 8).astype(np.uint64)
        value = value & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short))
        hashed[live] = mix(hashed[live] ^ value)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return hashed


def join_hashes(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of several, in order."""
    out = np.full(len(hashes[0]), 0x2545F4914F6CDD1D + len(hashes), np.uint64)
    for h in hashes:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h)
    return out


def shingle_sets(words: Words, hashes: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row of a piece: their hashes, ascending within the row, and each row's bounds.

    A row of fewer than ``width`` words has its whole sequence as its one shingle, a row without words has none.
    """
    bounds = words.bounds()
    counts = np.diff(bounds)
    inner = len(hashes) - width + 1
    found, owner = [], []
    if inner > 0:
        same = words.row[: inner] == words.row[width - 1 :]
        found.append(join_hashes([hashes[k : k + inner] for k in range(width)])[same])
        owner.append(words.row[:inner][same])
    for few in range(1, width):
        rows = np.flatnonzero(counts == few)
        if len(rows):
            found.append(join_hashes([hashes[bounds[rows] + k] for k in range(few)]))
            owner.append(rows)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(words.rows + 1, np.int64)
    value, row = np.concatenate(found), np.concatenate(owner)
    if len(found) > 1:
        order = np.argsort(row, kind="stable")
        value, row = value[order], row[order]
    at = np.searchsorted(row, np.arange(words.rows + 1))
    for a, b in zip(at[:-1], at[1:], strict=True):
        value[a:b].sort()
    first = np.ones(len(value), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[first], np.searchsorted(row[first], np.arange(words.rows + 1))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the runs between bounds; empty runs are 0."""
    total = np.zeros(len(bounds) - 1, values.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        total[full] = np.add.reduceat(values, bounds[:-1][full])
    return total
