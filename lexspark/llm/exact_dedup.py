"""Exact dedup with a heavy-hitter split (DataFrame functions only).

Texts are equal when they are identical after lower-casing A-Z.  The work runs
on digests (SHA-256), never on whole texts:

1. ``(id, digest)`` is written once, so every text is read and hashed once.
2. A Misra-Gries summary of the digests finds the frequent ones.  Blocks of
   ``BLOCK_ROWS`` rows are counted, cut to ``COUNTERS`` counters by subtracting
   the largest count that is cut off, and merged in a tree with the same cut.
   Every digest held by more than ``1 / (COUNTERS + 1)`` of all rows survives.
3. The candidates (at most ``COUNTERS``) are verified: their exact counts and
   largest ids come from one aggregation over the rows that hold them.  The
   verified winners are broadcast, and their rows are resolved without a shuffle.
4. All other digests go through an ordinary grouped aggregation and a join.
   None of them is frequent, and both steps combine or split a larger one.

Defined results: a null text counts as empty; empty texts are copies of one
another; a null id never wins against another id; rows that repeat an id share
one decision; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import ascii_lower, unused

COUNTERS = 1024
BLOCK_ROWS = 1 << 14
FAN_IN = 64


def _cut(counts: DataFrame) -> DataFrame:
    """Misra-Gries cut of each block of ``counts(block, key, n)``: at most COUNTERS counters stay."""
    ordered = counts.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("n", "key")), asc=False).alias("c"))
    over = F.coalesce(F.get("c", F.lit(COUNTERS)).getField("n"), F.lit(0))
    return (ordered.select("block", F.slice("c", 1, COUNTERS).alias("c"), over.alias("over"))
            .select("block", "over", F.inline("c")).select("block", "key", (F.col("n") - F.col("over")).alias("n"))
            .where("n > 0"))


def frequent_keys(keys: DataFrame, n_rows: int) -> DataFrame:
    """``key``: at most COUNTERS values, among them every one held by more than
    ``n_rows / (COUNTERS + 1)`` of the rows of ``keys(key LONG)``."""
    counts = (keys.select("key", F.shiftright(F.monotonically_increasing_id(), BLOCK_ROWS.bit_length() - 1)
                          .alias("block"))
              .groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")))
    # Rows never fill all blocks of every partition, so the tree is sized by rows and its top is one group.
    groups = max(1, n_rows // BLOCK_ROWS)
    while True:
        summary = _cut(counts)
        if groups == 0:
            return summary.select("key")
        groups = 0 if groups == 1 else -(-groups // FAN_IN)
        parent = F.pmod(F.xxhash64("block"), F.lit(max(groups, 1)))
        counts = summary.select(parent.alias("block"), "key", "n") \
                        .groupBy("block", "key").agg(F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` per row; of equal texts the largest id stays."""
    digest = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.unhex(digest).alias("digest")), "dedup-digests")
    rows = rows.withColumn("key", F.xxhash64("digest"))
    n_rows = rows.count()

    candidates = F.broadcast(frequent_keys(rows.select("key"), n_rows))  # at most COUNTERS rows
    kept_group = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    winners = materialize(rows.join(candidates, "key", "left_semi").groupBy("digest").agg(*kept_group)
                          .where("group_size > 1"), "dedup-winners")

    heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = rest.join(rest.groupBy("digest").agg(*kept_group), "digest")
    return heavy.unionByName(light).select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (rows with a null id are dropped
    when another row holds the text)."""
    key = unused(docs, "kept_id")
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("id").alias(key)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(key)), "left_semi")
