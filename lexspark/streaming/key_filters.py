"""Bloom filters over the keys of stored batches (X2), as arrays built and probed by JVM expressions.

A batch keeps one filter per key bucket: ``key_bucket, n_bits, words ARRAY<LONG>``, about
``BITS_PER_KEY`` bits a key.  A new batch probes its keys against the filters, which name
the (batch, bucket) pairs that may hold one of them; only their folders are read for the exact check.
A key that is stored is always found; about one in a hundred others is looked up in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEY_BUCKETS = 16
BITS_PER_KEY = 10
PROBES = 7


def key_bucket(key: Column | str, buckets: int = KEY_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _places(key: Column | str, n_bits: Column) -> Column:
    """The bits of a key, by double hashing."""
    h, step = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key).bitwiseOR(F.lit(1))
    # 31 bits each, so that sums stay within a long
    low = lambda x: F.shiftrightunsigned(x, 33)
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.pmod(low(h) + i * low(step), n_bits))


def build(keys: DataFrame, buckets: int = KEY_BUCKETS) -> DataFrame:
    """Filters of ``keys(doc_key)``: a row per bucket that holds one."""
    keyed = keys.select(key_bucket("doc_key", buckets).alias("key_bucket"), "doc_key")
    sizes = keyed.groupBy("key_bucket").agg((F.ceil(F.count(F.lit(1)) * BITS_PER_KEY / 64) * 64).alias("n_bits"))
    bits = keyed.join(F.broadcast(sizes), "key_bucket") \
                .select("key_bucket", "n_bits", F.explode(_places("doc_key", F.col("n_bits"))).alias("place"))  # a row per bucket
    one = F.expr("shiftleft(1L, cast(place % 64 as int))")
    set_bits = bits.select("key_bucket", "n_bits", F.floor(F.col("place") / 64).cast("int").alias("word"), one.alias("bits"))
    full = F.sequence(F.lit(0), (F.col("n_bits") / 64 - 1).cast("int"))
    none_set = sizes.select("key_bucket", "n_bits", F.explode(full).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_bits.unionByName(none_set).groupBy("key_bucket", "n_bits", "word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"]  # every word is there once
    return words.groupBy("key_bucket", "n_bits").agg(in_order.alias("words"))


def may_hold(words: Column, n_bits: Column, key: Column | str) -> Column:
    """Whether a filter may hold the key."""
    hit = lambda p: F.shiftrightunsigned(F.get(words, F.floor(p / 64).cast("int")), 0).bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0
    return F.forall(_places(key, n_bits), hit)


def candidate_folders(filters: DataFrame, keys: DataFrame, buckets: int = KEY_BUCKETS) -> list[tuple[int, int]]:
    """(batch_id, key_bucket) of ``filters(batch_id, key_bucket, n_bits, words)`` that may hold one of ``keys``:
    at most a pair per stored filter."""
    keyed = keys.select(key_bucket("doc_key", buckets).alias("key_bucket"), "doc_key")
    hits = filters.join(keyed, "key_bucket").where(may_hold(F.col("words"), F.col("n_bits"), "doc_key"))
    return sorted((r[0], r[1]) for r in hits.select("batch_id", "key_bucket").distinct().collect())
