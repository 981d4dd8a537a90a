"""Vectorised hashing of text columns (numpy over Arrow buffers).

All hashes are 64 bits of arithmetic mod 2**64 over a fixed table, finished by
an avalanche step, so they agree between tasks, machines and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
SHINGLE_WORDS = 5


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche: every input bit changes about half of the output bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


with np.errstate(over="ignore"):
    BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_BASE, _STEP = _U(0xD6E8FEB86659FD93), _U(0xA3B195354A39B70D)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``max_bytes`` of text; a longer text is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased, split at ASCII white space), and each row's word offsets."""
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    begins[first] = ~space[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    begin = np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, n)))])
    place = np.arange(n, dtype=np.int64) - begin  # of a byte in its word
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, _U))
        values = BYTE_VALUES[_LOWER[data]] * powers[place]
        values[space] = 0
        hashes = mix(np.add.reduceat(values, starts))
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its word shingles; a row of fewer words has one
    shingle (all of them), a row without words none."""
    wh, at = word_hashes(data, offsets)
    out = []
    with np.errstate(over="ignore"):
        weights = np.cumprod(np.full(words, _STEP, _U))
        sums = np.zeros(max(len(wh) - words + 1, 0), _U)
        for t in range(words):
            sums += wh[t:t + len(sums)] * weights[t]
        full = mix(sums)
        for s, e in zip(at[:-1], at[1:]):
            if e - s >= words:
                out.append(np.unique(full[s:e - words + 1]))
            elif e > s:
                short = (wh[s:e] * weights[:e - s]).sum(dtype=_U) + _U(e - s)
                out.append(mix(np.array([short], _U)))
            else:
                out.append(np.zeros(0, _U))
    return out


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each position that has so many (Horner, by doubling)."""
    if len(data) < width:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out, done = None, 0
        run, length, factor = BYTE_VALUES[data], 1, _BASE  # run[i]: the length bytes from i; factor: base**length
        done_factor, left = _U(1), width
        while left:
            if left & 1:
                if out is None:
                    out, done, done_factor = run, length, factor
                else:
                    m = min(len(out), len(run) - done)
                    out = out[:m] + run[done:done + m] * done_factor
                    done, done_factor = done + length, done_factor * factor
            left >>= 1
            if left:
                m = len(run) - length
                run = run[:m] + run[length:length + m] * factor
                length, factor = 2 * length, factor * factor
        return mix(out[:len(data) - width + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[:done - width], values[width - done:]) if done < width else values
