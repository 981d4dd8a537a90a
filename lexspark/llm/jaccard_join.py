"""N-gram Jaccard self-join by T-occurrence search, with connected components.

Documents are sets of 5-word shingles (64-bit hashes).  Two documents link when
their Jaccard similarity is at least ``threshold``; x then shares at least
``T = ceil(threshold * |x|)`` shingles with any partner.

1. Shingles are hashed in Arrow batches and sent to shards by hash, packed: one
   row per (block of documents, shard).  A shard knows which of its shingles
   occur twice in the corpus and returns only those, with the count.  This is the
   one large shuffle (8 bytes per shingle); unique shingles end here.
2. A document with fewer than T repeated shingles links with nothing.  The others
   keep their repeated shingles, rarest first; equal sets become one class.
3. Inverted lists of the shingles of each class's prefix (the ``|x| - T + 1`` rarest)
   tell which documents may meet.  Documents that share lists form families
   (two rounds of smallest label); families are cut into blocks of about
   ``BLOCK_DOCS`` documents, and only pairs of blocks that share a list meet.
4. In a pair of blocks DivideSkip runs per query document: the L longest of its
   lists are set aside, the short ones are merged and documents reaching T - L
   occurrences are kept, the long lists are probed by binary search, and the
   exact overlap decides.  A task returns a spanning forest of the links it found and
   the number of links per document, never all pairs.
5. Components of the forests, by alternating stars.

A family of g different near copies costs (g / BLOCK_DOCS)**2 / 2 block pairs;
exact copies, however many, are one class.  Task memory is bounded by the
shard and block sizes (plus one text).

Defined results: null and empty texts have 0 shingles and link with nothing; a
text of fewer than 5 words is one shingle; a row with a null id links with nothing and has a null
component; rows that repeat an id are separate texts that count as linked, and classes with the same
smallest id count their links together; an
empty table gives an empty result; other columns are ignored.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import hashing
from .common import join_groups, unused
from .components import components

THRESHOLD_PERCENT = 75
BLOCK_BYTES = 1 << 19   # text of a block of documents in step 1
SHARD_BYTES = 8 << 20   # text whose shingles one shard holds
BLOCK_DOCS = 384        # documents of a block in step 4

_PACKED = "shard int, block long, ids binary, ns binary, sigs binary, docs binary, hashes binary, counts binary"


def _need(n):
    """Smallest overlap of a set of n with any partner."""
    return -(-THRESHOLD_PERCENT * n // 100)


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_PACKED_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64())]
                           + [(c, pa.binary()) for c in ("ids", "ns", "sigs", "docs", "hashes", "counts")])


def _pack(n_shards: int):
    """Step 1, map side: documents to one row per (block, shard), and a head row per block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in hashing.chunks(batches, "text", BLOCK_BYTES):
            sets = hashing.shingle_hashes(*hashing.text_buffer(batch.column("text")))
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            ns = np.array([len(s) for s in sets], np.int64)
            with np.errstate(over="ignore"):
                sigs = np.array([(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(hashing.mix(s + np.uint64(77)))))
                                 for s in sets], np.uint64).reshape(-1, 2)
            block = (TaskContext.get().partitionId() << 32) + seq
            seq += 1
            hashes = np.concatenate(sets)
            docs = np.repeat(np.arange(len(sets), dtype=np.uint32), ns)
            shard = ((hashes >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            hashes, docs, shard = hashes[order], docs[order], shard[order]
            used, starts = np.unique(shard, return_index=True)
            ends = np.append(starts[1:], len(shard))
            rows = [{"shard": int(block % n_shards), "block": block, "ids": _blob(ids), "ns": _blob(ns), "sigs": _blob(sigs)}]
            rows += [{"shard": int(k), "block": block, "docs": _blob(docs[s:e]), "hashes": _blob(hashes[s:e])}
                     for k, s, e in zip(used, starts, ends)]
            yield _rows(rows, _PACKED_SCHEMA)
    return run


def _repeated(group: pa.Table) -> pa.Table:
    """Step 1, shard side: of each packed row the shingles that occur in two documents or more."""
    rows = group.to_pylist()
    out = [r for r in rows if r["hashes"] is None]
    packed = [r for r in rows if r["hashes"] is not None]
    if packed:
        parts = [np.frombuffer(r["hashes"], np.uint64) for r in packed]
        hashes = np.concatenate(parts)
        _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        counts = counts[inverse].astype(np.int64)
        at = 0
        for r, part in zip(packed, parts):
            n = counts[at:at + len(part)]
            at += len(part)
            keep = n > 1
            if keep.any():
                out.append({**r, "docs": _blob(np.frombuffer(r["docs"], np.uint32)[keep]),
                            "hashes": _blob(part[keep]), "counts": _blob(n[keep])})
    return pa.Table.from_pylist(out, schema=_PACKED_SCHEMA)


_DOCS = "id long, n long, s1 long, s2 long, prefix int, hashes binary"
_DOCS_SCHEMA = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
                          ("prefix", pa.int32()), ("hashes", pa.binary())])


def _unpack(group: pa.Table) -> pa.Table:
    """Step 2: a block's documents, with the repeated shingles (rarest first) of those that may link."""
    rows = group.to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    ids, ns = (np.frombuffer(head[c], np.int64) for c in ("ids", "ns"))
    sigs = np.frombuffer(head["sigs"], np.int64).reshape(-1, 2)
    rest = [r for r in rows if r["hashes"] is not None]
    prefix, blobs = np.zeros(len(ids), np.int32), [None] * len(ids)
    if rest:
        docs, hashes, counts = (np.concatenate([np.frombuffer(r[c], t) for r in rest])
                                for c, t in (("docs", np.uint32), ("hashes", np.uint64), ("counts", np.int64)))
        order = np.lexsort((hashes, counts, docs))
        docs, hashes = docs[order], hashes[order]
        bounds = np.searchsorted(docs, np.arange(len(ids) + 1))
        for i in np.flatnonzero(np.diff(bounds) >= np.maximum(_need(ns), 1)):
            s, e = bounds[i], bounds[i + 1]
            prefix[i] = e - s - _need(ns[i]) + 1
            blobs[i] = _blob(hashes[s:e])
    return pa.Table.from_arrays([pa.array(ids), pa.array(ns), pa.array(sigs[:, 0]), pa.array(sigs[:, 1]),
                                 pa.array(prefix), pa.array(blobs, pa.binary())], schema=_DOCS_SCHEMA)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.frombuffer(h, np.int64)[:p] for h, p in zip(batch.column("hashes").to_pylist(),
                                                              batch.column("prefix").to_pylist())]
        ids = np.repeat(batch.column("id").to_numpy(), [len(x) for x in lists])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists or [np.zeros(0, np.int64)])), pa.array(ids)],
                                         names=["h", "id"])


class _Forest:
    """Union-find over a task's documents, by position."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)


_FOUND_SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def _search(group: pa.Table) -> pa.Table:
    """Step 4: the links between the two sides of a block pair (or within one block): a row
    (u, its tree's smallest id, number of links found) per document with a link."""
    group = group.sort_by("id")
    ids, ns = group.column("id").to_numpy(), group.column("n").to_numpy()
    side = group.column("side").to_numpy()
    sets = [np.sort(np.frombuffer(h, np.uint64)) for h in group.column("hashes").to_pylist()]
    within = not side.any()
    indexed = np.arange(len(ids)) if within else np.flatnonzero(side == 1)
    queries = indexed if within else np.flatnonzero(side == 0)
    # inverted lists of the indexed side: positions in order, one run per shingle
    hashes = np.concatenate([sets[i] for i in indexed])
    owner = np.repeat(indexed, [len(sets[i]) for i in indexed])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    keys, begin = np.unique(hashes, return_index=True)
    end = np.append(begin[1:], len(hashes))
    forest, links = _Forest(len(ids)), np.zeros(len(ids), np.int64)
    for q in queries:
        at = np.minimum(np.searchsorted(keys, sets[q]), len(keys) - 1)
        at = at[keys[at] == sets[q]]
        need = int(_need(ns[q]))
        if len(at) < need:
            continue
        lengths = end[at] - begin[at]
        by_length = np.argsort(-lengths, kind="stable")
        # DivideSkip: the more the long lists outweigh the short ones, the more are set aside
        n_long = min(need - 1, int(need / (0.01 * np.log2(lengths.max() + 1) + 1)))
        long, short = at[by_length[:n_long]], at[by_length[n_long:]]
        merged = np.sort(np.concatenate([owner[begin[k]:end[k]] for k in short]), kind="stable")
        merged = merged[merged > q] if within else merged
        found, count = np.unique(merged, return_counts=True)
        keep = count >= need - n_long
        found, count = found[keep], count[keep]
        keep = (_need(ns[found]) <= ns[q]) & (ns[found] >= need)
        found, count = found[keep], count[keep]
        for k in long:
            if not len(found):
                break
            run = owner[begin[k]:end[k]]
            place = np.minimum(np.searchsorted(run, found), len(run) - 1)
            count = count + (run[place] == found)
        linked = found[100 * count >= THRESHOLD_PERCENT * (ns[q] + ns[found] - count)]
        links[q] += len(linked)
        links[linked] += 1
        for j in linked:
            forest.join(int(q), int(j))
    some = np.flatnonzero(links)
    return pa.Table.from_arrays([pa.array(ids[some]), pa.array(ids[[forest.root(int(i)) for i in some]].astype(np.int64)),
                                 pa.array(links[some])], schema=_FOUND_SCHEMA)


def _families(postings: DataFrame, rounds: int = 2) -> DataFrame:
    """``id, label``: documents that share lists, within ``rounds`` steps of the smallest label."""
    labels = postings.select("id").distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        lists = postings.join(labels, "id").groupBy("h").agg(F.min("label").alias("label"))
        labels = postings.join(lists, "h").groupBy("id").agg(F.min("label").alias("label"))
    return labels


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``classes(id, n_shingles, class_id)`` per row and ``found(u, v, links)`` between classes:
    v is the smallest document of u's tree, links the links of u that one search found."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    known = rows.where("id is not null")
    packed = known.mapInArrow(_pack(max(1, -(-size // SHARD_BYTES))), _PACKED)
    shards = packed.groupBy("shard").applyInArrow(_repeated, _PACKED)
    sets = materialize(shards.groupBy("block").applyInArrow(_unpack, _DOCS), "shingle-sets")

    same = ["n", "s1", "s2"]
    firsts = materialize(sets.where("n > 0").groupBy(*same).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")),
                         "shingle-firsts")
    some = sets.where("n > 0").select("id", *same)
    classes = join_groups(some, firsts, same, "copies", sets.count()).select("id", F.col("n").alias("n_shingles"), "class_id")
    none = sets.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("class_id"))
    classes = materialize(classes.unionByName(none), "shingle-classes")
    # each different set once, under its smallest id; an id with several texts may stand for several sets
    firsts = firsts.select(F.col("class_id").alias("id"), *same)
    sets = sets.where("hashes is not null").join(firsts, ["id", *same], "left_semi").dropDuplicates(["id", *same])
    sets = materialize(sets.select("id", "n", "prefix", "hashes"), "shingle-reps")

    postings = sets.select("id", "prefix", "hashes").mapInArrow(_postings, "h long, id long")
    shared = postings.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("h")
    postings = materialize(postings.join(shared, "h", "left_semi"), "shingle-postings")
    labels = _families(postings)
    sizes = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).alias("parts"))
    blocks = materialize(labels.join(sizes, "label").select(
        "id", F.xxhash64("label", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")), "shingle-blocks")

    lists = postings.join(blocks, "id").select("h", "block").distinct()
    several = lists.groupBy("h").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select("h")
    lists = lists.join(several, "h", "left_semi")
    across = lists.withColumnRenamed("block", "a").join(lists.withColumnRenamed("block", "b"), "h") \
                  .where("a < b").select("a", "b").distinct()
    inside = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("block").alias("a"), F.col("block").alias("b"))
    pairs = across.unionByName(inside)
    sides = pairs.select("a", "b", F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(
        pairs.where("a <> b").select("a", "b", F.col("b").alias("block"), F.lit(1).alias("side")))
    members = sides.join(blocks.join(sets, "id"), "block")
    found = members.select("a", "b", "side", "id", "n", "hashes").groupBy("a", "b").applyInArrow(
        _search, "u long, v long, links long")
    return classes, materialize(found, "shingle-links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, class_id, component_id, n_links`` per row; ``n_links`` counts the links of
    the row's class to other classes."""
    classes, found = links(docs, id_col, text_col)
    # A row with several texts ties their classes together.
    ties = found.select("u", "v").unionByName(classes.select(F.col("id").alias("u"), F.col("class_id").alias("v")))
    per_class = components(ties.where("u <> v"))
    degree = found.groupBy(F.col("u").alias("class_id")).agg(F.sum("links").alias("n_links"))
    none = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text"))
    nulls = none.mapInArrow(_count_only, "id long, n_shingles long").select(
        "id", "n_shingles", F.col("id").alias("class_id"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = (classes.join(per_class, "id", "left").join(degree, "class_id", "left")
           .select("id", "n_shingles", "class_id", F.coalesce("component_id", "id").alias("component_id"),
                   F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return out.unionByName(nulls)


def _count_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in hashing.chunks(batches, "text", BLOCK_BYTES):
        sets = hashing.shingle_hashes(*hashing.text_buffer(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64())],
                                         names=["id", "n_shingles"])


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays (the smallest id), with all its columns; rows with a
    null id stay."""
    key = unused(docs, "dropped")
    dropped = jaccard_components(docs, id_col, text_col).where("id <> component_id").select(
        F.col("id").alias(key)).distinct()
    return docs.join(dropped, F.col(id_col) == F.col(key), "left_anti")
