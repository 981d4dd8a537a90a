"""Postings packed into blocks over dense document ids, and pruned top-k search on them.

Documents are numbered 0, 1, 2... by length (then key), so neighbours are of like length.
A block holds the postings of one term in one range of ``SPAN`` ids::

    term, range, n, max_tf, offs ARRAY<INT>, freqs ARRAY<INT>, counts ARRAY<INT>

``offs`` are ids relative to the range's first one, ascending, so they are small; ``counts`` are
the documents' term counts, so that a block scores without a join.  The term is stored once per block, the
document key once per document (``docs``), and is joined for the k results only.

``max_tf`` bounds what a block can add to a document's rank.  A search reads these bounds first, scores the few
ranges with the largest sums, whose k-th rank is a lower limit, and then reads only the blocks of ranges that
can reach it.  Ids by length make the bounds of common words differ: short documents have the large tf.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

SPAN = 1 << 10
#: A range is read where its bound reaches the limit up to this rounding of sums.
SLACK = 1e-9


def postings_by_id(doc_terms: DataFrame) -> DataFrame:
    """``term, doc, freq, count`` of a forward index with ids ``(doc, term_count, terms)``."""
    rows = doc_terms.select("doc", F.col("term_count").alias("count"), F.explode_outer("terms").alias("t"))
    return rows.where("t is not null").select(F.col("t.term").alias("term"), "doc", F.col("t.freq").alias("freq"), "count")


def pack(postings: DataFrame, span: int = SPAN) -> DataFrame:
    """Blocks of ``postings(term, doc, freq, count)``.  Grouped by term and range, so the postings of a
    term found everywhere lie in many groups of at most ``span`` rows."""
    entry = F.struct((F.col("doc") % span).cast("int").alias("off"), F.col("freq").cast("int").alias("freq"),
                     F.col("count").cast("int").alias("count"))
    grouped = postings.groupBy("term", F.floor(F.col("doc") / span).alias("range")).agg(F.sort_array(F.collect_list(entry)).alias("p"))
    tf = F.transform("p", lambda e: e["freq"].cast("double") / e["count"])
    return grouped.select("term", "range", F.size("p").alias("n"), F.array_max(tf).alias("max_tf"), F.col("p.off").alias("offs"),
                          F.col("p.freq").alias("freqs"), F.col("p.count").alias("counts"))


def unpack(blocks: DataFrame, span: int = SPAN, *extra: str) -> DataFrame:
    """``term, doc, freq, count`` (and ``extra`` columns) of blocks."""
    rows = blocks.select("term", "range", *extra, F.inline(F.arrays_zip("offs", "freqs", "counts")))
    return rows.select("term", (F.col("range") * span + F.col("offs")).alias("doc"), F.col("freqs").cast("long").alias("freq"),
                       F.col("counts").cast("long").alias("count"), *extra)


def pack_documents(doc_terms: DataFrame, span: int = SPAN) -> DataFrame:
    """Blocks of a forward index with ids ``(doc, term_count, terms)``, as ``pack(postings_by_id(doc_terms))``.  The
    ``span`` documents of a range are brought together and packed in one group, so each term is shuffled once per
    document list, not as a row, and no row is a posting."""
    rows = doc_terms.select(F.floor(F.col("doc") / span).alias("range"), (F.col("doc") % span).cast("int").alias("off"),
                            F.col("term_count").cast("int").alias("count"), "terms")
    return rows.groupBy("range").applyInArrow(_pack_range, _PACKED)


_PACKED = "term string, range long, n int, max_tf double, offs array<int>, freqs array<int>, counts array<int>"


def _pack_range(key: tuple, docs: pa.Table) -> pa.Table:
    """The blocks of one range: its postings sorted by term, then id, and cut where the term changes."""
    docs = docs.sort_by("off").combine_chunks()
    lists = docs.column("terms").combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    flat = pc.list_flatten(lists)
    words = flat.field("term").dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    of_doc = lambda name: np.repeat(np.asarray(docs.column(name)), sizes)[order].astype(np.int32)
    freqs, counts = np.asarray(flat.field("freq"))[order].astype(np.int32), of_doc("count")
    ends = pa.array(np.r_[first, len(codes)].astype(np.int32))
    listed = lambda values: pa.ListArray.from_arrays(ends, pa.array(values))
    return pa.table({
        "term": words.dictionary.take(pa.array(codes[first])), "range": pa.array(np.full(len(first), key[0].as_py()), pa.int64()),
        "n": pa.array(np.diff(np.r_[first, len(codes)]).astype(np.int32)),
        "max_tf": pa.array(np.maximum.reduceat(freqs / counts, first) if len(first) else np.zeros(0)),
        "offs": listed(of_doc("off")), "freqs": listed(freqs), "counts": listed(counts)})


# --- removed documents --------------------------------------------------------

def removal_bits(docs: DataFrame, span: int, *extra: str) -> DataFrame:
    """``range, bits ARRAY<LONG>`` (and ``extra``): a bitmap per range that holds a removed ``doc``."""
    off = F.col("doc") % span
    words = docs.groupBy(*extra, F.floor(F.col("doc") / span).alias("range"), F.floor(off / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(doc % {span} % 64 as int))")).alias("bits"))
    of_word = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    size = max(1, -(-span // 64))
    return words.groupBy(*extra, "range").agg(of_word.alias("m")).select(
        *extra, "range", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("long"))).alias("bits"))


def is_removed(bits: Column, off: Column) -> Column:
    """Whether a bitmap (null: nothing removed) holds an offset."""
    word = F.get(bits, F.floor(off / 64).cast("int"))
    return F.coalesce(F.shiftrightunsigned(word, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (off % 64).cast("int"))) != 0,
                      F.lit(False))


# --- search ----------------------------------------------------------------------

def weighted(blocks: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The blocks of the weighted terms, with ``qw``."""
    qw = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("term"))
    return blocks.where(F.col("term").isin(list(weights))).withColumn("qw", qw)


def bounds(blocks: DataFrame, keys: list[str], one_term: bool) -> DataFrame:
    """``keys, bound``: the largest rank a document of each range can have.  Reads no postings."""
    part = blocks.select(*keys, (F.col("qw") * F.col("max_tf")).alias("bound"))
    return part if one_term else part.groupBy(*keys).agg(F.sum("bound").alias("bound"))


def scores(blocks: DataFrame, keys: list[str], span: int, one_term: bool) -> DataFrame:
    """``seg.., doc, rank`` of the postings in blocks ``(.., range, bits, qw, offs, freqs, counts)``; removed
    documents are left out."""
    rows = blocks.select(*keys, "bits", "qw", F.inline(F.arrays_zip("offs", "freqs", "counts")))
    rows = rows.where(~is_removed(F.col("bits"), F.col("offs")))
    ids = [c for c in keys if c != "range"]
    part = rows.select(*ids, (F.col("range") * span + F.col("offs")).alias("doc"),
                       (F.col("qw") * F.col("freqs") / F.col("counts")).alias("rank"))
    return part if one_term else part.groupBy(*ids, "doc").agg(F.sum("rank").alias("rank"))
