"""Mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key; each source is range-split on that key
into buckets of about ``BUCKET_ROWS`` rows, bucket sums are prefix-summed over
the (few) buckets of a source, and a running sum inside each bucket gives every
document its place on the source's word axis.  A source's budget is then cut
exactly on that axis; a budget above the source's size starts another epoch.
One shuffle of ``(id, source, size)`` rows; a hot source spreads over its buckets.

Targets: ``share`` of all words is given out by weight; a target stops at
``max_epochs`` times its source's size and the excess is reshared by weight
among the others.  That is: ``min(cap, level * weight)`` with one common level,
found by a running sum over the sources in order of ``cap / weight``.

Defined results: a null or empty text has size 0 and is taken 0 times; a null
source is a source of its own, after all others; rows that repeat an id are
separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import WORD_PATTERN, unused, word_count

BUCKET_ROWS = 4_000
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target DOUBLE`` and ``budget LONG`` to ``sources(src, source_size)``.

    One row per source and one window over all of them: it holds source names, not documents."""
    by_name = Window.orderBy("src")
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "src")
    everything = Window.partitionBy(F.lit(1))
    s = (s.withColumn("below", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0)))
          .withColumn("w_left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
          .withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share))))
    # Taking the sources in this order as capped raises the level up to the right one; past it, it falls.
    level = F.max((F.col("goal") - F.col("below")) / F.col("w_left")).over(everything)
    target = F.least(F.col("cap").cast("double"), level * F.col("w"))
    return s.select("src", "source_size", target.alias("target"), F.round(target).cast("long").alias("budget"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
        seed: int = 17) -> DataFrame:
    """``id, size, source_size, target, taken, digest`` per document; ``digest`` is a hash of id, source and text."""
    src = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("~"))  # "=" sorts before "~": null last
    # 52 random bits, exact in a double
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("?"), F.xxhash64(text_col).cast("string")))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", name, F.lit(str(seed))).cast("binary")), 1, 13), 16, 10).cast("long")
    rows = materialize(docs.select(F.col(id_col).alias("id"), src.alias("src"), word_count(F.col(text_col)).alias("size"),
                                   key.alias("key"), _digest(id_col, text_col, source_col).alias("digest")), "mix-sizes")
    per_source = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    per_source = materialize(
        targets(per_source.select("src", "source_size"), weights, share, max_epochs)
        .join(per_source.select("src", F.ceil(F.col("n") / BUCKET_ROWS).alias("n_buckets")), "src"), "mix-targets")

    bucket = F.floor(F.col("key") / F.lit(float(1 << 52)) * F.col("n_buckets"))
    placed = rows.join(per_source, "src").withColumn("bucket", bucket)
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (placed.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"))
               .select("src", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset")))
    inside = (Window.partitionBy("src", "bucket").orderBy("key", "id", "size", "digest")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    rest = F.col("budget") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return (placed.join(buckets, ["src", "bucket"])
            .select("id", "size", "source_size", "target", taken.cast("long").alias("taken"), "digest"))


def _digest(id_col: str, text_col: str, source_col: str) -> Column:
    # nulls are skipped by the hash, so they get a name
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in (id_col, source_col, text_col)])


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """The mixture itself: each document once per epoch that takes it, with all its columns.

    Documents meet their share by the hash of id, source and text; equal rows share theirs out
    one by one.  Only the document at a source's cut is taken in part: its
    first words, with the white space before them."""
    key, size, taken, epoch, place, shares = (unused(docs, c) for c in ("mix_key", "mix_size", "mix_taken", "mix_epoch",
                                                                        "mix_place", "mix_shares"))
    take = mixed.groupBy(F.col("digest").alias(key)).agg(F.max("size").alias(size), F.sort_array(F.collect_list("taken")).alias(shares)) \
                .where(F.element_at(shares, -1) > 0)
    equal = Window.partitionBy(key).orderBy(F.col(id_col))
    epochs = F.sequence(F.lit(0), F.floor((F.col(taken) - 1) / F.col(size)).cast("int"))
    words = F.least(F.col(size), F.col(taken) - F.col(epoch) * F.col(size))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD_PATTERN), F.lit(0)),
                               F.lit(1), words.cast("int")), "")
    keyed = docs.withColumn(key, _digest(id_col, text_col, source_col)).join(take, key).withColumn(place, F.row_number().over(equal))
    joined = keyed.withColumn(taken, F.get(shares, F.col(place) - 1)).where(F.col(taken) > 0).withColumn(epoch, F.explode(epochs))
    text = F.when(words == F.col(size), F.col(text_col)).otherwise(cut)
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
