"""A stored index that stays fast while documents are added and replaced (A6, A8).

Layout below ``root``::

    segments/<name>/forward/    (doc_key, term_count, terms, _place), sorted by (term_count, doc_key)
                    offsets/    (_part, _before): dense ids of the places above
                    docs/       (doc, doc_key, term_count): the key of each dense id
                    postings/   bucket=<b>/ blocks (``operators.packed``), sorted by (term, range)
                    doc_freq/   bucket=<b>/ (term, df, max_tf)
    v.../                       a version: _manifest (its segments and sums, JSON),
                                removed/ (segment, range, bits), removed_df/ bucket=<b>/ (segment, term, df), first_keys/

A segment is never changed.  An addition writes one segment with the buckets of the
others, a bitmap per range of ids for the documents it replaces, and their document
frequencies to be taken off; N, the sums and the smallest keys are kept in the version.  Where
``FAN_IN`` segments are of like size (the same power of ``FAN_IN`` postings), they are merged into one, so
a posting is rewritten once per power and a search meets few segments.  A search
filters every segment by literal buckets and terms and reads no segment's keys but the k found.
Versions name segments, never paths: an index can be moved.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import packed, ranking
from ..operators.incremental import accepted, assert_consistent, assert_unique
from ..operators.index import Index, build_index, doc_freq_of, term_bucket
from ..operators.numbering import PLACE, numbered, placed, starts
from ..session import delete_path, materialize
from .index_store import LEAST_BUCKETS, _fs, _mark_published, _new_version, published_versions

FAN_IN = 4
FIRST_KEYS = ranking.FIRST_KEYS
#: Ranges scored first, for a lower limit of the k-th rank.
FIRST_RANGES = 8
#: Ranges, and hits that may tie with the k-th, up to which they are literals; more are joined.
LITERALS = 1000
#: Removed ranges up to which their bitmaps are broadcast, and the bytes these may take.
REMOVED_MAX_BYTES = 32 << 20

_BLOCKS = ("term string, range bigint, n int, max_tf double, offs array<int>, freqs array<int>, counts array<int>, bucket int")


@dataclass
class Segment:
    name: str
    n_docs: int
    n_tokens: int
    n_postings: int

    @property
    def tier(self) -> int:
        return int(math.log(max(self.n_postings, 1), FAN_IN) + 1e-9)


@dataclass
class TieredIndex:
    spark: SparkSession
    root: str
    version: str
    segments: list[Segment]
    key_type: str
    buckets: int
    span: int
    stemmed: bool
    removed_docs: int = 0
    removed_ranges: int = 0
    _first_keys: list = field(default_factory=list, repr=False)

    @property
    def n_docs(self) -> int:
        return sum(s.n_docs for s in self.segments) - self.removed_docs

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{path}")  # a given schema needs no job

    def _union(self, part: str, schema: str) -> DataFrame:
        parts = [self._read(f"segments/{s.name}/{part}", schema).withColumn("segment", F.lit(s.name)) for s in self.segments]
        return reduce(DataFrame.unionByName, parts)

    @property
    def blocks(self) -> DataFrame:
        return self._union("postings", _BLOCKS)

    @property
    def removed(self) -> DataFrame:
        """``segment, range, bits``: the bitmaps of removed documents."""
        return self._read(f"{self.version}/removed", "segment string, range bigint, bits array<bigint>")

    def without_removed(self, rows: DataFrame) -> DataFrame:
        """``rows(segment, range, ..)`` with the ``bits`` of their range."""
        if not self.removed_ranges:
            return rows.withColumn("bits", F.lit(None).cast("array<bigint>"))
        removed = self.removed
        if self.removed_ranges * (self.span // 8 + 64) <= REMOVED_MAX_BYTES:
            removed = F.broadcast(removed)
        return rows.join(removed, ["segment", "range"], "left")

    @property
    def documents(self) -> DataFrame:
        """``doc_key, term_count, segment, doc`` of the documents that are not removed."""
        docs = self._union("docs", f"doc bigint, doc_key {self.key_type}, term_count bigint")
        docs = self.without_removed(docs.withColumn("range", F.floor(F.col("doc") / self.span)))
        return docs.where(~packed.is_removed(F.col("bits"), F.col("doc") % self.span)).select("doc_key", "term_count", "segment", "doc")

    @property
    def forward(self) -> DataFrame:
        """``doc_key, term_count, terms, segment, doc`` of the documents that are not removed."""
        return self._forward(self.segments)

    def _forward(self, segments: list[Segment]) -> DataFrame:
        schema = f"doc_key {self.key_type}, term_count bigint, terms array<struct<term:string,freq:bigint>>, {PLACE} bigint"
        rows = [numbered(self._read(f"segments/{s.name}/forward", schema), "doc",
                         self._read(f"segments/{s.name}/offsets", "_part bigint, _before bigint")).withColumn("segment", F.lit(s.name))
                for s in segments]
        rows = self.without_removed(reduce(DataFrame.unionByName, rows).withColumn("range", F.floor(F.col("doc") / self.span)))
        return rows.where(~packed.is_removed(F.col("bits"), F.col("doc") % self.span)).drop("bits", "range")

    @property
    def doc_freq(self) -> DataFrame:
        """``term, df`` without the removed documents."""
        return self._term_counts().groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _term_counts(self) -> DataFrame:
        """``bucket, term, df``: a row per segment that holds the term, and what its removed documents take off."""
        added = self._union("doc_freq", "term string, df bigint, max_tf double, bucket int").select("bucket", "term", "df")
        if not self.removed_docs:
            return added
        off = self._read(f"{self.version}/removed_df", "segment string, term string, df bigint, bucket int")
        return added.unionByName(off.select("bucket", "term", (-F.col("df")).alias("df")))

    def postings(self) -> DataFrame:
        """``doc_key, term, freq, term_count``: the blocks decoded, with the keys joined."""
        rows = self.without_removed(self.blocks)
        rows = packed.unpack(rows, self.span, "segment", "bits")
        rows = rows.where(~packed.is_removed(F.col("bits"), F.col("doc") % self.span)).drop("bits")
        keys = self._union("docs", f"doc bigint, doc_key {self.key_type}").select("segment", "doc", "doc_key")
        return rows.join(keys, ["segment", "doc"]).select("doc_key", "term", "freq", F.col("count").alias("term_count"))

    def as_index(self) -> Index:
        """The index in the form every other operator takes."""
        forward = self.forward.select("doc_key", "term_count", "terms")
        return Index(documents=self.documents.select("doc_key", "term_count"), postings=self.postings(), doc_freq=self.doc_freq,
                     stemmed=self.stemmed, doc_terms=forward, _n_docs=self.n_docs, _first_keys=self._first_keys)


# --- writing ---------------------------------------------------------------------

def _write_segment(spark: SparkSession, root: str, doc_terms: DataFrame, buckets: int, span: int) -> Segment:
    name = f"s{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    path = f"{root}/segments/{name}"
    placed(doc_terms.select("doc_key", "term_count", "terms"), F.col("term_count"), F.col("doc_key")).write.parquet(f"{path}/forward")
    forward = spark.read.parquet(f"{path}/forward")
    starts(forward).coalesce(1).write.parquet(f"{path}/offsets")
    forward = numbered(forward, "doc", spark.read.parquet(f"{path}/offsets"))
    forward.select("doc", "doc_key", "term_count").write.parquet(f"{path}/docs")
    blocks = packed.pack_documents(forward, span).withColumn("bucket", term_bucket("term", buckets))
    (blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "range")
     .write.partitionBy("bucket").parquet(f"{path}/postings"))
    stored = spark.read.schema(_BLOCKS).parquet(f"{path}/postings")
    (stored.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"))
     .hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/doc_freq"))
    n_docs, n_tokens = spark.read.parquet(f"{path}/docs").agg(F.count(F.lit(1)), F.coalesce(F.sum("term_count"), F.lit(0))).first()
    return Segment(name, n_docs, n_tokens, stored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _publish(index: TieredIndex, removed: DataFrame | None, removed_df: DataFrame | None) -> str:
    """Write the version named in ``index``; the marker comes last."""
    spark, target = index.spark, f"{index.root}/{index.version}"
    if removed is not None:
        removed.write.parquet(f"{target}/removed")
        removed_df.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{target}/removed_df")
        index.removed_ranges = spark.read.parquet(f"{target}/removed").count()
    spark.createDataFrame([(k,) for k in index._first_keys], f"doc_key {index.key_type}").coalesce(1).write.parquet(f"{target}/first_keys")
    manifest = {c: getattr(index, c) for c in ("key_type", "buckets", "span", "stemmed", "removed_docs", "removed_ranges")}
    manifest["segments"] = [vars(s) for s in index.segments]
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{target}/_manifest")
    _mark_published(spark, target)
    return target


def create(index: Index, root: str, buckets: int = LEAST_BUCKETS, span: int = packed.SPAN) -> str:
    """Publish a built index below ``root`` as one segment.  Returns the version folder."""
    spark, root = index.documents.sparkSession, root.rstrip("/")
    assert_unique(index.documents)
    segment = _write_segment(spark, root, index.doc_terms, buckets, span)
    key_type = index.documents.schema["doc_key"].dataType.simpleString()
    tiered = TieredIndex(spark, root, _version(root), [segment], key_type, buckets, span, index.stemmed)
    tiered._first_keys = _smallest(tiered._union("docs", f"doc bigint, doc_key {key_type}"))
    return _publish(tiered, None, None)


def _version(root: str) -> str:
    return _new_version(root).rsplit("/", 1)[-1]


def _smallest(keys: DataFrame) -> list:
    return [r[0] for r in keys.select("doc_key").orderBy("doc_key").limit(FIRST_KEYS).collect()]


def load(spark: SparkSession, root: str, version: str | None = None, verify: bool = False) -> TieredIndex:
    """The newest published version below ``root``, or the one named; ``verify`` checks that it is consistent."""
    root = root.rstrip("/")
    if version is None:
        versions = published_versions(spark, root)
        if not versions:
            raise FileNotFoundError(f"no published index below {root}")
        version = versions[-1].rsplit("/", 1)[-1]
    m = json.loads(spark.read.text(f"{root}/{version}/_manifest").first()[0])
    segments = [Segment(**s) for s in m.pop("segments")]
    first = spark.read.schema(f"doc_key {m['key_type']}").parquet(f"{root}/{version}/first_keys")
    index = TieredIndex(spark, root, version, segments, _first_keys=sorted(r[0] for r in first.collect()), **m)
    if verify:
        assert_consistent(index.as_index())
    return index


def _merged_first_keys(old: list, old_all: bool, gone: set, new: list, new_all: bool) -> tuple[list, bool]:
    """The smallest keys of both lists without those gone, as far as they are certain: nothing is known beyond the
    last key of a list that does not hold all.  The flag: all keys are listed."""
    ends = [keys[-1] for keys, every in ((old, old_all), (new, new_all)) if keys and not every]
    both = sorted({k for k in old if k not in gone} | set(new))
    sure = [k for k in both if all(k <= end for end in ends)]
    return sure[:FIRST_KEYS], old_all and new_all and len(both) <= FIRST_KEYS


def append(spark: SparkSession, root: str, new_docs: DataFrame, policy: str = "error", merge: bool = True) -> str:
    """Add a batch ``(doc_key, text)`` to the newest version, by a policy of ``incremental.accepted``.  The cost
    follows the batch and what it replaces, but for the check of its keys.  Returns the version folder."""
    base = load(spark, root)
    fresh, replaced = accepted(base, new_docs, policy)
    fresh = materialize(build_index(fresh, stem=base.stemmed).doc_terms, "tiered-batch")
    gone = None
    if policy == "replace":  # read before anything is written: what they take off
        rows = base.forward.join(replaced, "doc_key", "left_semi")
        gone = materialize(rows.select("segment", "doc", "doc_key", "terms"), "tiered-replaced")
    segment = _write_segment(spark, base.root, fresh, base.buckets, base.span)
    index = TieredIndex(spark, base.root, _version(base.root), [*base.segments, segment], base.key_type, base.buckets,
                        base.span, base.stemmed, base.removed_docs)
    keys, every = base._first_keys, len(base._first_keys) == base.n_docs
    added = _smallest(fresh)
    gone_keys: set = set()
    removed = base.removed if base.removed_ranges else None
    removed_df = base._read(f"{base.version}/removed_df", "segment string, term string, df bigint, bucket int") \
        if base.removed_docs else None
    if gone is not None:
        count = gone.count()
        index.removed_docs += count
        gone_keys = {r[0] for r in gone.where(F.col("doc_key").isin(keys[:FIRST_KEYS])).select("doc_key").collect()} if keys else set()
        if count:
            removed, removed_df = _with_removed(index, removed, removed_df, gone)
    index._first_keys, every = _merged_first_keys(keys, every, gone_keys, added, len(added) == segment.n_docs)
    if not every and len(index._first_keys) < FIRST_KEYS // 2:
        index._first_keys = _smallest(base.documents.join(replaced, "doc_key", "left_anti").select("doc_key")
                                      .unionByName(fresh.select("doc_key")))
    target = _publish(index, removed, removed_df)
    return compact(spark, root) if merge and _like_sized(index.segments) else target


def _with_removed(index: TieredIndex, removed: DataFrame | None, removed_df: DataFrame | None,
                  gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bitmaps and document frequencies to take off, with those of ``gone(segment, doc, terms)`` added."""
    ids = gone.select("segment", "doc")
    if removed is not None:
        offs = F.sequence(F.lit(0), F.lit(index.span - 1))
        held = removed.select("segment", "range", F.explode(F.filter(offs, lambda o: packed.is_removed(F.col("bits"), o))).alias("off"))
        ids = ids.unionByName(held.select("segment", (F.col("range") * index.span + F.col("off")).alias("doc")))
    terms = gone.select("segment", F.explode_outer("terms").alias("t")).where("t is not null")
    off = terms.select("segment", F.col("t.term").alias("term"), F.lit(1).cast("long").alias("df"))
    if removed_df is not None:
        off = off.unionByName(removed_df.select("segment", "term", "df"))
    off = off.groupBy("segment", "term").agg(F.sum("df").alias("df")).withColumn("bucket", term_bucket("term", index.buckets))
    return packed.removal_bits(ids, index.span, "segment"), off


def _like_sized(segments: list[Segment]) -> list[Segment]:
    """The segments of the smallest tier that holds FAN_IN or more."""
    tiers: dict[int, list[Segment]] = {}
    for s in segments:
        tiers.setdefault(s.tier, []).append(s)
    full = [t for t, held in tiers.items() if len(held) >= FAN_IN]
    return tiers[min(full)] if full else []


def compact(spark: SparkSession, root: str, everything: bool = False) -> str:
    """Merge segments of like size (or all) into one, without their removed documents, until no tier is full.
    Each step publishes a version; readers of older ones are not disturbed.  Returns the newest."""
    while True:
        base = load(spark, root)
        chosen = base.segments if everything else _like_sized(base.segments)
        if not chosen:
            return f"{base.root}/{base.version}"
        names = [s.name for s in chosen]
        merged = _write_segment(spark, base.root, base._forward(chosen), base.buckets, base.span)
        kept = [s for s in base.segments if s.name not in names]
        index = TieredIndex(spark, base.root, _version(base.root), [*kept, merged], base.key_type, base.buckets, base.span,
                            base.stemmed, _first_keys=base._first_keys)
        index.removed_docs = sum(s.n_docs for s in index.segments) - base.n_docs
        removed = removed_df = None
        if index.removed_docs:
            removed = base.removed.where(~F.col("segment").isin(names))
            removed_df = base._read(f"{base.version}/removed_df", "segment string, term string, df bigint, bucket int") \
                .where(~F.col("segment").isin(names))
        target = _publish(index, removed, removed_df)
        if everything:
            return target


def _pins(root: str) -> str:
    return f"{root.rstrip('/')}/pins"


def pin(spark: SparkSession, root: str, version: str, reader: str) -> None:
    """Keep a version (folder name) for a reader, who may hold one pin; ``unpin`` gives it up."""
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{_pins(root)}/{reader}")


def unpin(spark: SparkSession, root: str, reader: str) -> None:
    delete_path(spark, f"{_pins(root)}/{reader}")


def pinned(spark: SparkSession, root: str) -> set[str]:
    fs, path = _fs(spark, _pins(root))
    if not fs.exists(path):
        return set()
    readers = [f.getPath().getName() for f in fs.listStatus(path)]
    return {spark.read.text(f"{_pins(root)}/{r}").first()[0] for r in readers}


def remove_unused(spark: SparkSession, root: str) -> list[str]:
    """Delete the versions that are neither the newest nor pinned, and then the segments that no version left
    names.  Returns what was removed."""
    root = root.rstrip("/")
    versions = [v.rsplit("/", 1)[-1] for v in published_versions(spark, root)]
    keep = {versions[-1]} | pinned(spark, root) if versions else set()
    kept = [v for v in versions if v in keep]
    gone = [f"{root}/{v}" for v in versions if v not in keep] + [f"{root}/segments/{s}" for s in unused_segments(spark, root, kept)]
    for path in gone:
        delete_path(spark, path)
    return gone


class Latest:
    """The newest version for a reader that asks again and again (a query stream at each batch): the version in use is
    pinned under the reader's name, and loaded anew only when there is a newer one."""

    def __init__(self, spark: SparkSession, root: str, reader: str):
        self.spark, self.root, self.reader = spark, root, reader
        self._version, self._index = None, None

    def __call__(self) -> Index:
        newest = published_versions(self.spark, self.root)[-1].rsplit("/", 1)[-1]
        if newest != self._version:
            pin(self.spark, self.root, newest, self.reader)
            self._version, self._index = newest, load(self.spark, self.root, newest).as_index()
        return self._index


def unused_segments(spark: SparkSession, root: str, keep: list[str]) -> list[str]:
    """Names of segments that no version of ``keep`` (folder names) uses: they may be deleted once no reader
    holds another version."""
    used = {s.name for version in keep for s in load(spark, root, version).segments}
    fs, path = _fs(spark, f"{root.rstrip('/')}/segments")
    return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(path)) if n not in used)


# --- search ------------------------------------------------------------------------

def _weights(index: TieredIndex, counts: dict[str, int]) -> tuple[dict[str, float], DataFrame | None]:
    """Weight of each scoring term, and its blocks; a row per term and segment comes to the driver."""
    terms = sorted(counts)
    literals = F.array(*map(F.lit, terms))
    numbers = sorted(set(ranking._one_row(index).select(F.transform(literals, lambda t: term_bucket(t, index.buckets))).collect()[0][0]))
    of_terms = F.col("bucket").isin(numbers) & F.col("term").isin(terms)
    df: dict[str, int] = {}
    for term, n in index._term_counts().where(of_terms).select("term", "df").collect():
        df[term] = df.get(term, 0) + n
    n_docs = index.n_docs
    weights = {t: counts[t] * math.log10(n_docs / n) for t, n in df.items() if 0 < n < n_docs}
    if not weights:
        return {}, None
    blocks = index.blocks.where(of_terms & F.col("term").isin(list(weights)))
    return weights, packed.weighted(blocks, weights)


def _of_ranges(rows: DataFrame, pairs: list[tuple[str, int]]) -> DataFrame:
    """The rows of the given (segment, range) pairs, as literal filters."""
    ranges: dict[str, list[int]] = {}
    for segment, number in pairs:
        ranges.setdefault(segment, []).append(number)
    if not ranges:
        return rows.where(F.lit(False))
    return rows.where(reduce(lambda a, b: a | b, [(F.col("segment") == s) & F.col("range").isin(n) for s, n in ranges.items()]))


def able_ranges(index: TieredIndex, blocks: DataFrame, one_term: bool, limit: float) -> DataFrame:
    """``segment, range, bound`` of the ranges that may hold a rank of ``limit`` or more."""
    bounds = packed.bounds(blocks, ["segment", "range"], one_term)
    return bounds.where(F.col("bound") >= limit - packed.SLACK * max(1.0, limit))


def lower_limit(index: TieredIndex, blocks: DataFrame, one_term: bool, k: int) -> float:
    """A rank that the k-th best document reaches at least: the k-th best in the most promising ranges."""
    n_first = FIRST_RANGES + -(-k // index.span)
    bounds = packed.bounds(blocks, ["segment", "range"], one_term)
    best = bounds.orderBy(F.desc("bound")).limit(n_first)
    if one_term:  # a block is a range: no second read of the bounds
        first = blocks.withColumn("bound", F.col("qw") * F.col("max_tf")).orderBy(F.desc("bound")).limit(n_first)
    else:
        first = _of_ranges(blocks, [(r["segment"], r["range"]) for r in best.collect()])
    scored = packed.scores(index.without_removed(first), ["segment", "range"], index.span, one_term)
    ranks = [r[0] for r in scored.select("rank").orderBy(F.desc("rank")).limit(k).collect()]
    return ranks[-1] if len(ranks) == k else 0.0


def able_blocks(index: TieredIndex, blocks: DataFrame, one_term: bool, limit: float) -> DataFrame:
    """The blocks of ``able_ranges``: few ranges as literals that reach the scan, more by a join."""
    if limit <= 0:
        return blocks
    if one_term:
        return blocks.where(F.col("qw") * F.col("max_tf") >= limit - packed.SLACK * max(1.0, limit))
    able = able_ranges(index, blocks, one_term, limit)
    pairs = [(r["segment"], r["range"]) for r in able.limit(LITERALS + 1).collect()]
    if len(pairs) <= LITERALS:
        return _of_ranges(blocks, pairs)
    return blocks.join(able.select("segment", "range"), ["segment", "range"], "left_semi")


def search(index: TieredIndex, query: str, k: int = ranking.TOP_K) -> DataFrame:
    """Top k for one free-text query: (rn, doc_key, rank), as ``ranking.search``; k rows come to the driver."""
    counts = ranking.query_terms(index, query)
    weights, blocks = _weights(index, counts) if counts else ({}, None)
    hits = []
    if weights:
        one = len(weights) == 1
        able = able_blocks(index, blocks, one, lower_limit(index, blocks, one, k))
        scored = packed.scores(index.without_removed(able), ["segment", "range"], index.span, one)
        scored = scored.where("rank > 0").withColumn("order", F.round("rank", ranking.ORDER_DECIMALS)) \
                       .withColumn("shown", F.round("rank", ranking.RANK_DECIMALS))
        best = scored.orderBy(F.desc("order")).limit(k + LITERALS).collect()
        last = best[min(k, len(best)) - 1]["order"] if best else 0.0
        if len(best) == k + LITERALS and best[-1]["order"] == last:  # more ties with the k-th than literals: joined
            tied = scored.where(F.col("order") >= last)
            keys = index._union("docs", f"doc bigint, doc_key {index.key_type}")
            found = tied.join(keys, ["segment", "doc"]).orderBy(F.desc("order"), "doc_key").limit(k).collect()
            hits = [(r["doc_key"], r["shown"]) for r in found]
        else:
            rank = {(r["segment"], r["doc"]): (r["order"], r["shown"]) for r in best if r["order"] >= last}
            found = sorted((-rank[s, d][0], key, rank[s, d][1]) for s, d, key in _keys(index, list(rank)))
            hits = [(key, shown) for _, key, shown in found[:k]]
    return ranking.listed(index, hits, k)


def _keys(index: TieredIndex, ids: list[tuple[str, int]]) -> list[tuple]:
    """``segment, doc, doc_key`` of a few documents: their ids are literals, and docs are sorted by id."""
    wanted: dict[str, list[int]] = {}
    for segment, doc in ids:
        wanted.setdefault(segment, []).append(doc)
    parts = [index._read(f"segments/{s}/docs", f"doc bigint, doc_key {index.key_type}").where(F.col("doc").isin(docs))
             .select(F.lit(s).alias("segment"), "doc", "doc_key") for s, docs in wanted.items()]
    return [tuple(r) for r in reduce(DataFrame.unionByName, parts).collect()] if parts else []
