"""Sums per (lang, text) key over tables packed into few rows.

``(lang, text, n)`` tables travel as zstd-packed Arrow streams, one row per sender and
part of the key space, so a shuffle holds about what the compressed texts take.  The
key space is cut into ``parts`` parts of about ``PART_BYTES``; a sender splits its table
into at most ``FAN`` ranges of parts.  Where there are more parts than that, the ranges are merged,
summed and split again in as many levels as needed: the rows of a level are (senders x FAN),
never (senders x parts).  In between, a range is dealt over as many groups as it has parts, so
that no task holds more than about ``PART_BYTES`` and a key that every sender holds is summed on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import hashing, segments

PART_BYTES = 20 << 20   # keys of a part
FAN = 1024              # ranges of parts that a sender splits into

ROW = "part long, salt long, blob binary"
_ROW_SCHEMA = pa.schema([("part", pa.int64()), ("salt", pa.int64()), ("blob", pa.binary())])
TABLE_SCHEMA = pa.schema([("lang", pa.large_string()), ("text", pa.large_string()), ("n", pa.int64())])


def part_count(key_bytes: int) -> int:
    return max(1, -(-key_bytes // PART_BYTES))


def widths(parts: int) -> list[int]:
    """Parts in a range, level by level: FAN**k, ..., FAN, 1."""
    out = [1]
    while out[0] * FAN < parts:
        out.insert(0, out[0] * FAN)
    return out


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    coded = table.set_column(0, "lang", table.column("lang").combine_chunks().dictionary_encode())
    with pa.ipc.new_stream(sink, coded.schema) as writer:
        writer.write_table(coded)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def unpack(blob: bytes) -> pa.Table:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
    return table.set_column(0, "lang", table.column("lang").cast(pa.large_string())).cast(TABLE_SCHEMA)


def summed(tables: list[pa.Table]) -> pa.Table:
    """One row per key."""
    whole = pa.concat_tables(tables).combine_chunks()
    lang, text = (whole.column(c).combine_chunks().dictionary_encode() for c in ("lang", "text"))
    n_texts = len(text.dictionary)
    key = lang.indices.to_numpy().astype(np.int64) * n_texts + text.indices.to_numpy()
    if len(lang.dictionary) > 4:  # else the keys are dense enough to be summed in place
        used, key = np.unique(key, return_inverse=True)
        sums = np.zeros(len(used), np.int64)
        np.add.at(sums, key, whole.column("n").to_numpy())
    else:
        sums = np.zeros(len(lang.dictionary) * n_texts, np.int64)
        np.add.at(sums, key, whole.column("n").to_numpy())
        used = np.flatnonzero(sums)
        sums = sums[used]
    return pa.table([lang.dictionary.take(pa.array(used // max(n_texts, 1))), text.dictionary.take(pa.array(used % max(n_texts, 1))),
                     pa.array(sums)], schema=TABLE_SCHEMA)


def send(table: pa.Table, parts: int, width: int, seed: int) -> Iterator[pa.RecordBatch]:
    """A summed table as packed rows, one per range of ``width`` parts."""
    if not table.num_rows:
        return
    h = segments.row_hashes(*hashing.text_buffer(table.column("text")))
    part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    span = part // width
    order = np.argsort(span, kind="stable")
    used, first = np.unique(span[order], return_index=True)
    for k, rows in zip(used, np.split(order, first[1:])):
        yield pa.RecordBatch.from_pylist([{"part": int(k) * width, "salt": seed % width, "blob": pack(table.take(pa.array(rows)))}],
                                         schema=_ROW_SCHEMA)


def _merged(group: Iterator[pa.RecordBatch], limit: int) -> tuple[pa.Table, int]:
    """The sum of a group's tables, folded whenever what is held has doubled, and a number for the group."""
    waiting, held, fold, seed = [], 0, limit, 0
    for batch in group:
        seed = batch.column("part")[0].as_py() * 1_000_003 + batch.column("salt")[0].as_py()
        for blob in batch.column("blob"):
            waiting.append(unpack(blob.as_py()))
            held += waiting[-1].nbytes
            if held > fold:
                waiting = [summed(waiting)]
                held = waiting[0].nbytes
                fold = max(limit, 2 * held)
    return summed(waiting), seed


def _merge(parts: int, width: int, limit: int):
    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seed = _merged(group, limit)
        yield from send(table, parts, width, seed)
    return run


def sum_keys(sent: DataFrame, parts: int, finish: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The summed table of each part goes through ``finish``; ``sent`` holds the rows of ``send`` with the
    first of ``widths(parts)``."""
    limit = PART_BYTES
    for width in widths(parts)[1:]:
        sent = sent.groupBy("part", "salt").applyInArrow(_merge(parts, width, limit), ROW)

    def last(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from finish(_merged(group, limit)[0])
    return sent.groupBy("part").applyInArrow(last, schema)
