"""Words and stretches of text columns as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import hashing

_U = np.uint64


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, set for the bytes of the given (first, last) ranges."""
    flags = np.zeros(256, bool)
    for a, b in ranges:
        flags[a:b + 1] = True
    return flags


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of ``inside`` bytes within a row, and each row's first run (n + 1 places)."""
    n = len(data)
    flag = inside[data]
    begins, ends = flag.copy(), flag.copy()
    begins[1:] &= ~flag[:-1]
    ends[:-1] &= ~flag[1:]
    edges = offsets[1:-1]
    first, last = edges[edges < n], edges[edges > 0] - 1
    begins[first] = flag[first]
    ends[last] = flag[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The given stretches of ``data``, joined."""
    return data[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))]


def as_array(data: np.ndarray, lengths: np.ndarray, of: pa.DataType | None = None) -> pa.Array:
    """An Arrow column whose rows are consecutive stretches of ``data`` (strings unless ``of`` says otherwise)."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(of or pa.large_string(), len(lengths), buffers)


def spaced_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words alone, each followed by one space: the bytes, and begin and end of each word in them."""
    lengths = ends - starts
    begin = np.cumsum(lengths + 1) - lengths - 1
    out = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    out[np.repeat(begin - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))] = \
        gather(data, starts, lengths)
    return out, begin, begin + lengths


def row_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's bytes."""
    lengths = np.diff(offsets)
    out = lengths.astype(_U)
    full = np.flatnonzero(lengths)
    if len(full):
        place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(place.max()) + 1, _U(0xD6E8FEB86659FD93), _U))
            out[full] += np.add.reduceat(hashing.BYTE_VALUES[data] * powers[place], offsets[:-1][full])
    return hashing.mix(out)
