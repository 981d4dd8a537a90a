"""Suffix-array dedup: removal of byte strings that also start in an earlier document.

A byte goes when it is covered by a string of ``LENGTH`` bytes that also starts in
a document with a smaller id.  Sorting all suffixes would move every byte many
times, so the suffix array is sparse: in each window of LENGTH bytes the suffix
whose ``LEAD`` leading bytes hash lowest stands for the window.  The choice depends
on the window's content alone, so equal windows choose alike, and about one
suffix in 17 is kept.  Its context (at most 2 * LENGTH - LEAD bytes) holds all windows
it stands for.

1. Blocks of documents send the hashes of the leading bytes, packed, to shards,
   and get back which of them occur twice in the corpus.  All others are done.
2. Blocks send the contexts of the rest to buckets.  Splitters are quantiles of the
   leading bytes in a bounded sample; equal leading bytes share a bucket, so no
   run of equal suffixes crosses a boundary.  Of equal contexts in a block only those of its
   smallest document travel; the others are removed on the spot.  A passage that any
   share of all documents hold so reaches its bucket once per block.
3. A bucket orders its suffixes by multikey quicksort, 8 bytes a key: a key sorts
   only the ties of the one before.  Within a run of equal leading bytes the windows are
   compared by 64-bit fingerprint, and each learns the smallest document that holds it.
4. The removed spans go back, packed by groups of blocks and then by block, and the blocks cut the texts.

Blocks meet their results by an id made of partition, place and documents; the scans are held to one
division of the files into partitions, and results without their block stop the job.  Texts travel twice,
zstd-packed; task memory is bounded by the block and bucket sizes plus one text.

Defined results: a null text is empty; a text shorter than LENGTH keeps all; a null
id counts as larger than any other; rows with equal ids remove nothing from one another;
an empty table gives an empty result; other columns are ignored.  Ids are integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import hashing

LENGTH = 50
LEAD = 16
BLOCK_BYTES = 1 << 20     # text of a block
SCAN_BYTES = 1 << 18      # text hashed at once
SHARD_BYTES = 8 << 20    # text whose leading bytes one shard of step 1 holds
BUCKET_BYTES = 2 << 20    # text whose repeated suffixes one bucket of step 3 holds
SLICE_WINDOWS = 1 << 17   # windows of a bucket compared at once
SAMPLE_BYTES = 16 << 20   # text of the sample that the splitters come from
NO_ID = np.iinfo(np.int64).max

_ROW = "part int, block long, head binary, bits binary, contexts binary, spans binary"
_ROW_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int64())]
                        + [(c, pa.binary()) for c in ("head", "bits", "contexts", "spans")])


def _pack(*arrays: np.ndarray) -> bytes:
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    sizes = np.array([len(raw)] + [len(r) for r in raw], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(raw))


def _unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    starts = 8 + 8 * n + np.concatenate([[0], np.cumsum(sizes)])
    return [np.frombuffer(raw[starts[i]:starts[i + 1]], t) for i, t in enumerate(types)]


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_ROW_SCHEMA)


class _Suffixes:
    """The suffixes that stand for the windows of a block: ``at`` their place, ``first`` and ``last``
    their windows, ``lead`` the hash of the leading bytes, ``content`` that of the context."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        parts, n = [], len(data)
        width = LENGTH - LEAD + 1
        for lo in range(0, max(n - LENGTH + 1, 0), SCAN_BYTES):
            hi = min(lo + SCAN_BYTES, n - LENGTH + 1)
            piece = data[lo:hi + LENGTH - 1]
            lead = hashing.rolling(piece, LEAD)
            low = hashing.sliding_min((lead & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(lead), dtype=np.uint64), width)
            place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
            windows = np.arange(lo, hi)
            ends = offsets[np.searchsorted(offsets, windows, side="right")]
            windows = windows[windows + LENGTH <= ends] - lo  # within one document
            if not len(windows):
                continue
            owner = place[windows]
            begin = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(windows) != 1)))
            first, last = windows[begin], windows[np.append(begin[1:], len(windows)) - 1]
            full = hashing.rolling(piece, LENGTH)
            with np.errstate(over="ignore"):
                content = hashing.mix(full[first] * np.uint64(3) + full[last] * np.uint64(7) + (last - first).astype(np.uint64))
            parts.append((owner[begin] + lo, first + lo, last + lo, lead[owner[begin]], content))
        empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        self.at, self.first, self.last, self.lead, self.content = map(np.concatenate, zip(*(parts or [empty])))

    def shards(self, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Shard per suffix, and the order by shard."""
        shard = ((self.lead >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)
        return shard, np.argsort(shard, kind="stable")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Block id, ids, bytes and offsets of each block of a partition.  The id holds the partition, the
    place and the documents: rows of another division of the input never meet a block's text."""
    seq = 0
    for batch in hashing.chunks(batches, "text", BLOCK_BYTES):
        data, offsets = hashing.text_buffer(batch.column("text"))
        ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.array([TaskContext.get().partitionId(), seq], np.int64)
        digest = hashlib.blake2b(place.tobytes() + ids.tobytes() + offsets.tobytes(), digest_size=8).digest()
        yield int.from_bytes(digest, "little", signed=True), ids, data, offsets
        seq += 1


def _send_leads(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, data, offsets in _blocks(batches):
            s = _Suffixes(data, offsets)
            shard, order = s.shards(n_shards)
            used, starts = np.unique(shard[order], return_index=True)
            lead = s.lead[order].astype(np.uint32)  # with the shard, more than 32 bits of the hash
            rows = [{"part": int(k), "block": block, "bits": lead[a:b].tobytes()}
                    for k, a, b in zip(used, starts, np.append(starts[1:], len(order)))]
            if rows:
                yield from _table(rows).to_batches()
    return run


def _repeated(group: pa.Table) -> pa.Table:
    """Step 1: one bit per suffix, set when its leading bytes occur twice."""
    rows = group.to_pylist()
    parts = [np.frombuffer(r["bits"], np.uint32) for r in rows]
    _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    twice, at = counts[inverse] > 1, 0
    for r, part in zip(rows, parts):
        r["bits"] = zstandard.compress(np.packbits(twice[at:at + len(part)]).tobytes())
        at += len(part)
    return _table(rows)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, ids, data, offsets in _blocks(batches):
        yield from _table([{"part": -1, "block": block, "head": _pack(ids, offsets, data)}]).to_batches()


def _head(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads = [r["head"] for r in rows if r["head"] is not None]
    if len(heads) != 1:
        raise RuntimeError("the rows of the input changed between two scans; write them as a table first")
    return tuple(_unpack(heads[0], np.int64, np.int64, np.uint8))


def _big_endian(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as an unsigned number in byte order."""
    word = np.zeros(len(at), np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | data[at + j]
    return word


def _send_contexts(n_shards: int, splitters: list[int]):
    cuts = np.array(splitters, np.uint64)

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        ids, offsets, data = _head(rows)
        block, s = rows[0]["block"], _Suffixes(data, offsets)
        shard, order = s.shards(n_shards)
        counts = np.bincount(shard, minlength=n_shards)
        starts = np.concatenate([[0], np.cumsum(counts)])
        repeated = np.zeros(len(s.at), bool)
        for r in rows:
            if r["bits"] is not None:
                a, b = starts[r["part"]], starts[r["part"] + 1]
                bits = np.frombuffer(zstandard.decompress(r["bits"]), np.uint8)
                repeated[order[a:b]] = np.unpackbits(bits, count=b - a).astype(bool)
        pick = np.flatnonzero(repeated)
        first, last, at, content = s.first[pick], s.last[pick], s.at[pick], s.content[pick]
        owner = ids[np.searchsorted(offsets, first, side="right") - 1]
        # equal contexts of this block: the smallest id decides for the others
        by_content = np.lexsort((owner, content))
        run_start = np.append(True, content[by_content][1:] != content[by_content][:-1])
        smallest = owner[by_content][np.maximum.accumulate(np.where(run_start, np.arange(len(pick)), 0))] \
            if len(pick) else owner
        here = np.zeros(len(pick), bool)
        here[by_content] = owner[by_content] > smallest
        out = []
        if here.any():
            out.append({"part": block % max(1, len(cuts) + 1), "block": block,
                        "spans": _pack(first[here].astype(np.uint32), (last[here] + LENGTH).astype(np.uint32))})
        first, last, at, owner = (x[~here] for x in (first, last, at, owner))
        bucket = np.searchsorted(cuts, _big_endian(data, at), side="right")
        order = np.argsort(bucket, kind="stable")
        used, starts = np.unique(bucket[order], return_index=True)
        for k, a, b in zip(used, starts, np.append(starts[1:], len(order))):
            p = order[a:b]
            lengths = last[p] - first[p] + LENGTH
            text = _gather(data, first[p], lengths)
            out.append({"part": int(k), "block": block, "contexts": _pack(
                np.diff(owner[p], prepend=0), np.diff(first[p], prepend=0).astype(np.int32),
                (at[p] - first[p]).astype(np.uint8), (last[p] - first[p] + 1).astype(np.uint8), text)})
        return _table(out)
    return run


def multikey_order(n_keys: int, key, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of n strings by multikey quicksort and the number of the run of equals of each place:
    ``key(k, which)`` is the k-th key of some of them; each key sorts only what the ones before left tied."""
    order, runs = np.arange(n), np.zeros(n, np.int64)
    tied = np.arange(n)  # places whose strings are not told apart yet
    for k in range(n_keys):
        if not len(tied):
            break
        keys = key(k, order[tied])
        by = np.lexsort((keys, runs[tied]))
        order[tied] = order[tied][by]
        keys, old = keys[by], runs[tied]
        new = np.zeros(n, bool)
        new[tied] = np.append(True, (keys[1:] != keys[:-1]) | (old[1:] != old[:-1]))
        new[1:] |= runs[1:] != runs[:-1]
        runs = np.cumsum(new) - new[0]
        sizes = np.bincount(runs, minlength=1)
        tied = np.flatnonzero(sizes[runs] > 1)
    return order, runs


def _bucket(n_groups: int):
    """Step 3: the spans of a bucket's windows that a smaller document holds, a row per group of blocks."""
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        found = [(r["block"], *_unpack(r["spans"], np.uint32, np.uint32)) for r in rows if r["spans"] is not None]
        found += _bucket_spans([r for r in rows if r["contexts"] is not None])
        if not found:
            return _table([])
        block = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
        a, b = (np.concatenate([f[i] for f in found]).astype(np.uint32) for i in (1, 2))
        target = block % n_groups
        order = np.lexsort((block, target))
        used, first = np.unique(target[order], return_index=True)
        return _table([{"part": int(k), "block": int(k), "spans": _pack(np.diff(block[p], prepend=0), a[p], b[p])}
                       for k, p in zip(used, np.split(order, first[1:]))])
    return run


def _to_blocks(group: pa.Table) -> pa.Table:
    """The spans of a group of blocks, a row per block."""
    fields = [_unpack(s, np.int64, np.uint32, np.uint32) for s in group.column("spans").to_pylist()]
    block = np.concatenate([np.cumsum(f[0]) for f in fields])
    a, b = (np.concatenate([f[i] for f in fields]) for i in (1, 2))
    order = np.argsort(block, kind="stable")
    used, first = np.unique(block[order], return_index=True)
    return _table([{"part": -1, "block": int(k), "spans": _pack(a[p], b[p])} for k, p in zip(used, np.split(order, first[1:]))])


def _bucket_spans(sent: list[dict]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Block, begins and ends of the spans that a bucket's contexts give."""
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    if not sent:
        return out
    fields = [_unpack(r["contexts"], np.int64, np.int32, np.uint8, np.uint8, np.uint8) for r in sent]
    owner = np.concatenate([np.cumsum(f[0]) for f in fields])
    first = np.concatenate([np.cumsum(f[1].astype(np.int64)) for f in fields])
    lead, n_windows, data = (np.concatenate([f[i] for f in fields]) for i in (2, 3, 4))
    source = np.repeat(np.arange(len(sent)), [len(f[0]) for f in fields])
    n_windows = n_windows.astype(np.int64)
    lengths = n_windows + LENGTH - 1
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order, runs = multikey_order(LEAD // 8, lambda k, which: _big_endian(data, (start + lead)[which] + 8 * k), len(owner))
    # runs of equal leading bytes with two documents or more
    begin = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
    several = np.minimum.reduceat(owner[order], begin) != np.maximum.reduceat(owner[order], begin)
    live = several[runs]
    pick, run = order[live], runs[live]
    # whole runs at a time, about SLICE_WINDOWS windows
    n = n_windows[pick]
    windows_before = np.cumsum(n) - n
    run_begin = np.flatnonzero(np.append(True, run[1:] != run[:-1]))[:len(run)]
    piece = np.repeat(windows_before[run_begin], np.diff(np.append(run_begin, len(run)))) // SLICE_WINDOWS
    for part in np.split(np.arange(len(pick)), np.flatnonzero(np.diff(piece)) + 1):
        p = pick[part]
        a, b, src = _held_spans(_gather(data, start[p], lengths[p]), n_windows[p], run[part], owner[p], first[p], source[p])
        order_of = np.argsort(src, kind="stable")
        used, begins = np.unique(src[order_of], return_index=True)
        out += [(sent[k]["block"], a[at], b[at]) for k, at in zip(used, np.split(order_of, begins[1:]))]
    return out


def _gather(data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The given stretches of ``data``, joined."""
    return data[np.repeat(start - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))]


def _held_spans(data: np.ndarray, n: np.ndarray, run: np.ndarray, owner: np.ndarray, first: np.ndarray,
                source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and block number of the spans whose windows a smaller document holds: record r
    has ``n[r]`` windows, from ``first[r]`` on, in its joined context in ``data``."""
    total = int(n.sum())
    record = np.repeat(np.arange(len(n)), n)
    j = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    with np.errstate(over="ignore"):
        key = hashing.rolling(data, LENGTH)[begin[record] + j] + hashing.mix(run.astype(np.uint64))[record]
    by = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))[:total]
    who = owner[record]
    smallest = np.repeat(np.minimum.reduceat(who[by], heads), np.diff(np.append(heads, total))) if total else who
    held = np.zeros(total, bool)
    held[by] = who[by] > smallest
    # consecutive windows of a record join to one span
    same = record[1:] == record[:-1]
    opens = np.flatnonzero(held & ~np.append(False, same & held[:-1])[:total])
    closes = np.flatnonzero(held & ~np.append(same & held[1:], False)[:total])
    place = first[record] + j
    return place[opens], place[closes] + LENGTH, source[record[opens]]


_RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept binary"
_RESULT_SCHEMA = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                            ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(digest: bool):
    """Step 4: per document its counts and the bytes that stay (or their SHA-256)."""
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        ids, offsets, data = _head(rows)
        edge = np.zeros(len(data) + 1, np.int32)
        for r in rows:
            if r["spans"] is not None:
                a, b = _unpack(r["spans"], np.uint32, np.uint32)
                np.add.at(edge, a, 1)
                np.add.at(edge, b, -1)
        gone = np.cumsum(edge[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        opens[inner] = gone[inner]
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        kept = [data[s:e][~gone[s:e]].tobytes() for s, e in zip(offsets[:-1], offsets[1:])]
        if digest:
            kept = [hashlib.sha256(k).digest() for k in kept]
        return pa.Table.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(np.diff(offsets)), pa.array(count(gone)),
                                     pa.array(count(opens)), pa.array(kept, pa.binary())], schema=_RESULT_SCHEMA)
    return run


def _sample_leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, data, offsets in _blocks(batches):
        s = _Suffixes(data, offsets)
        words = _big_endian(data, s.at) ^ np.uint64(1 << 63)  # signed order is byte order
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64))], names=["word"])


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept`` per document: the UTF-8 bytes that stay, joined, or
    with ``digest`` their SHA-256.  ``docs`` must give the same rows in the same order on every scan
    (a table does)."""
    spark, split = docs.sparkSession, "spark.sql.files.minPartitionNum"
    if spark.conf.get(split, None) is not None:
        return _dedup_spans(docs, id_col, text_col, digest)
    # else the number of executors at hand decides how small files are split, scan by scan
    spark.conf.set(split, str(spark.sparkContext.defaultParallelism))
    try:
        return materialize(_dedup_spans(docs, id_col, text_col, digest), "suffix-kept")
    finally:
        spark.conf.unset(split)


def _dedup_spans(docs: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards, n_buckets = max(1, -(-size // SHARD_BYTES)), max(1, -(-size // BUCKET_BYTES))
    splitters = []
    if n_buckets > 1:
        fractions = [i / n_buckets for i in range(1, n_buckets)]
        sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(10_000)) < max(1, min(10_000, 10_000 * SAMPLE_BYTES // size)))
        found = sample.mapInArrow(_sample_leads, "word long").agg(
            F.percentile_approx("word", fractions, 100_000)).first()[0] or []
        splitters = sorted({w + (1 << 63) for w in found})
    texts = lambda: rows.mapInArrow(_texts, _ROW)
    bits = rows.mapInArrow(_send_leads(n_shards), _ROW).groupBy("part").applyInArrow(_repeated, _ROW)
    contexts = texts().unionByName(bits).groupBy("block").applyInArrow(_send_contexts(n_shards, splitters), _ROW)
    n_groups = math.isqrt(size // BLOCK_BYTES) + 1  # of blocks: the rows sent are buckets x groups, not buckets x blocks
    spans = contexts.groupBy("part").applyInArrow(_bucket(n_groups), _ROW).groupBy("part").applyInArrow(_to_blocks, _ROW)
    return texts().unionByName(spans).groupBy("block").applyInArrow(_cut(digest), _RESULT)
