"""Importance resampling towards a target distribution, with length-bucketed CRC matrices.

Texts become bags of hashed features: all runs of 1 to 3 consecutive words, each
in the bucket ``crc32(feature) mod BUCKETS``.  A bucket's gain compares its share
among the target's features with its share among the documents' (both
smoothed by one); a document's weight is the sum of its features' gains.  Adding a
Gumbel number drawn from the id and taking the highest scores samples without
replacement in proportion to the importance weights.

1. Per chunk of text the distinct features are grouped by byte length into uint8
   matrices, one column per place; the CRCs of all rows of a matrix advance
   column by column over a 256-entry table, and the buckets are scattered back to the features.
   A task adds up one array of counts; ``BUCKETS`` sums reach the driver, whatever the corpus.
2. The same scan, now with the gains (an array of ``BUCKETS`` numbers in the task), gives each
   document its weight.  No feature is ever shuffled or written.
3. The scores are range-sorted into a table, a task numbers its own rows, and the sizes of
   the partitions before it make that the rank; the first ``floor(percent * N / 100)`` are drawn.

Task memory is bounded by ``CHUNK_BYTES`` of text plus one text.

Defined results: a null or empty text has no feature and weight 0; a null id is drawn for
as the empty string; rows that repeat an id have the same number drawn and are ranked one
by one; equal scores go by id (null ids last); an empty target gives every feature its gain against 0 target features; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from . import hashing, segments

BUCKETS = 10_000
MAX_WORDS = 3           # of a feature
LEAST_WORDS = 20        # of a document that may be drawn
PERCENT = 5
SEED = 42
CHUNK_BYTES = 1 << 19
#: Reversed polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320

_WORD = segments.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def crc_table() -> np.ndarray:
    """CRC of each byte, by eight steps of the division."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(POLYNOMIAL) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_TABLE = crc_table()


def crc32_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32 of each row's bytes: rows of equal length form a matrix (a line per place), whose
    CRCs advance together, place by place."""
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), np.uint32)
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    for size, rows in zip(sizes, np.split(order, first[1:])):
        starts = offsets[rows]
        matrix = np.empty((size, len(rows)), np.uint8)
        for j in range(size):
            np.take(data, starts + j, out=matrix[j])
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in matrix:
            crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        out[rows] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature, its row, and the number of words per row."""
    data = segments.lower(data)
    starts, ends, at = segments.runs(data, offsets, _WORD)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    text, begin, end = segments.spaced_words(data, starts, ends)
    from_word, to_word = [], []
    for n in range(1, MAX_WORDS + 1):
        whole = np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:])  # all n words in one row
        from_word.append(whole)
        to_word.append(whole + n - 1)
    first, last = np.concatenate(from_word), np.concatenate(to_word)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.diff(at)
    lengths = end[last] - begin[first]
    features = segments.as_array(segments.gather(text, begin[first], lengths), lengths, pa.large_binary())
    coded = features.dictionary_encode()
    buckets = crc32_rows(*hashing.text_buffer(coded.dictionary)) % np.uint32(BUCKETS)
    return buckets[coded.indices.to_numpy()].astype(np.int64), row[first], np.diff(at)


def _count(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in hashing.chunks(batches, "text", chunk):
            total += np.bincount(feature_buckets(*hashing.text_buffer(batch.column("text")))[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features per bucket over all rows: BUCKETS sums come to the driver."""
    found = (texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(CHUNK_BYTES), "bucket long, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in found:
        counts[bucket] = n
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln)`` of each bucket's smoothed share in the target over that in the corpus."""
    ratio = (target + 1.0) * (corpus.sum() + BUCKETS) / ((corpus + 1.0) * (target.sum() + BUCKETS))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_features, weight`` per document."""
    chunk = CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashing.chunks(batches, "text", chunk):
            buckets, row, n_words = feature_buckets(*hashing.text_buffer(batch.column("text")))
            n_features = np.bincount(row, minlength=batch.num_rows)
            weight = np.zeros(batch.num_rows, np.int64)
            np.add.at(weight, row, gains[buckets])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words.astype(np.int64)), pa.array(n_features.astype(np.int64)),
                 pa.array(weight)], names=["id", "n_words", "n_features", "weight"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """``floor(1000 g)``, g a standard Gumbel number drawn from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... in the given order, without a task that sees all rows: they are
    range-sorted into a table, where a row's place in its partition and the sizes of the partitions before
    it give its rank.  Rows that the order ties are spread too, and numbered one by one."""
    part, place = F.spark_partition_id(), F.monotonically_increasing_id()
    tie = "_tie"
    ordered = rows.withColumn(tie, place).repartitionByRange(*order, F.col(tie)).sortWithinPartitions(*order, F.col(tie))
    table = materialize(ordered.drop(tie).withColumn("_part", part).withColumn("_place", place), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sizes = table.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (table.join(F.broadcast(starts), "_part")  # as many rows as partitions
            .withColumn("rank", F.col("_before") + inside + 1).drop("_part", "_place", "_before"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``id, n_words, n_features, weight, score, rank`` per document; ``rank`` is null where not drawn."""
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    weighed = weigh(docs, gains, id_col, text_col)
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "resample-scores")
    may = F.col("n_words") >= LEAST_WORDS
    drawn = scored.where(may).count() * percent // 100
    order = ranked(scored.where(may), "resample-order", F.col("score").desc(), F.col("id").asc_nulls_last())
    drawn_rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return order.withColumn("rank", drawn_rank).unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))
