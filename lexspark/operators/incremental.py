"""Adding documents to an index without rebuilding it (A5-A9).

All operators are set-based: a batch of new documents is indexed on its own
(a *delta* index) and combined with the base by unions and per-term sums, so
the cost grows with the batch, not with the corpus (except for the key checks,
which are joins on the document key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .index import Index, build_index

POLICIES = ("error", "replace", "ignore")


def duplicate_keys(docs: DataFrame, key: str = "doc_key") -> DataFrame:
    """Keys that occur more than once: (key, copies) (A7).  A partial count per key
    before the shuffle keeps hot keys cheap."""
    return (docs.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1))


def assert_unique(docs: DataFrame, key: str = "doc_key") -> None:
    dup = duplicate_keys(docs, key).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate document key {dup[0][0]!r} ({dup[0][1]} copies)")


def duplicate_postings(postings: DataFrame) -> DataFrame:
    """``doc_key, term, copies`` of postings that occur more than once (A7: unique (term, document))."""
    return postings.groupBy("doc_key", "term").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def wrong_terms(index: Index) -> DataFrame:
    """``term, copies, df, counted`` of terms that occur more than once in ``doc_freq``, or whose df is not the number of
    their postings (A7: unique term).  Counts per term on both sides, so hot terms are summed before the shuffle."""
    stated = index.doc_freq.select("term", "df", F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("counted"))
    found = index.postings.select("term", F.lit(0).cast("long").alias("df"), F.lit(0).cast("long").alias("copies"),
                                  F.lit(1).cast("long").alias("counted"))
    sums = stated.unionByName(found).groupBy("term").agg(*[F.sum(c).alias(c) for c in ("copies", "df", "counted")])
    return sums.where("copies <> 1 or df <> counted")


def assert_consistent(index: Index) -> None:
    """Fail on an index that is damaged or was added to twice: repeated keys, postings or terms, wrong document
    frequencies, or postings without their document."""
    assert_unique(index.documents)
    for rows, what in ((duplicate_postings(index.postings), "repeated posting"), (wrong_terms(index), "wrong document frequency"),
                       (orphan_postings(index.postings, index.documents), "posting without a document")):
        bad = rows.limit(1).collect()
        if bad:
            raise ValueError(f"{what}: {bad[0].asDict()}")


def orphan_postings(postings: DataFrame, documents: DataFrame) -> DataFrame:
    """Postings whose document is missing (A9): a left-anti join on the key."""
    return postings.join(documents.select("doc_key"), "doc_key", "left_anti")


def surrogate_ids(docs: DataFrame, key: str = "doc_key") -> DataFrame:
    """(key, doc_id) with ``doc_id = xxhash64(key)`` (A5): no global numbering, so
    no single task.  ``check_surrogate_ids`` proves there is no collision."""
    return docs.select(F.col(key).alias("doc_key"), F.xxhash64(F.col(key)).alias("doc_id"))


def surrogate_collisions(ids: DataFrame) -> DataFrame:
    """Ids shared by different keys: (doc_id, keys)."""
    return (ids.groupBy("doc_id").agg(F.countDistinct("doc_key").alias("keys"))
            .where(F.col("keys") > 1))


def check_surrogate_ids(ids: DataFrame) -> None:
    bad = surrogate_collisions(ids).limit(1).collect()
    if bad:
        raise ValueError(f"surrogate id collision on {bad[0][0]}")


POSTING_COLUMNS = ("doc_key", "term", "freq", "term_count")


def _union_terms(base: Index, delta: Index) -> DataFrame | None:
    if base.doc_terms is None or delta.doc_terms is None:
        return None
    return base.doc_terms.unionByName(delta.doc_terms)


def merge_indexes(base: Index, delta: Index, check: bool = True) -> Index:
    """Union of two indexes over disjoint keys (A6): document frequencies add up.  ``check``
    fails on a key that both hold.  The result has no buckets, whatever its parts have."""
    if check:
        shared = base.documents.join(delta.documents.select("doc_key"), "doc_key", "left_semi").limit(1).collect()
        if shared:
            raise ValueError(f"document key {shared[0][0]!r} is in both indexes")
    documents = base.documents.unionByName(delta.documents)
    postings = base.postings.select(*POSTING_COLUMNS).unionByName(delta.postings.select(*POSTING_COLUMNS))
    doc_freq = (base.doc_freq.select("term", "df").unionByName(delta.doc_freq.select("term", "df"))
                .groupBy("term").agg(F.sum("df").alias("df")))
    n = None
    if base._n_docs is not None and delta._n_docs is not None:
        n = base._n_docs + delta._n_docs
    return Index(documents=documents, postings=postings, doc_freq=doc_freq, stemmed=base.stemmed, _n_docs=n,
                 doc_terms=_union_terms(base, delta))


def without_documents(index: Index, keys: DataFrame) -> Index:
    """``index`` without the documents of ``keys(doc_key)``; only the document frequencies of
    their terms change: ``df = base - removed``."""
    drop = lambda df: df.join(keys, "doc_key", "left_anti")
    removed = (index.postings.join(keys, "doc_key", "left_semi")
               .groupBy("term").agg((-F.count(F.lit(1))).alias("df")))
    doc_freq = (index.doc_freq.select("term", "df").unionByName(removed)
                .groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") > 0))
    return Index(documents=drop(index.documents), postings=drop(index.postings.select(*POSTING_COLUMNS)),
                 doc_freq=doc_freq, stemmed=index.stemmed,
                 doc_terms=None if index.doc_terms is None else drop(index.doc_terms))


def accepted(base: Index, new_docs: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
    """The documents of a batch to index and the stored keys they replace, by the policy:

    ``error``: fail if a key exists (in the base or twice in the batch);
    ``ignore``: keep the stored document, drop the new one;
    ``replace``: the new text wins."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    assert_unique(new_docs)
    existing = new_docs.select("doc_key").join(base.documents.select("doc_key"), "doc_key", "left_semi")
    if policy == "error":
        clash = existing.limit(1).collect()
        if clash:
            raise ValueError(f"document key {clash[0][0]!r} is already indexed")
    if policy == "ignore":
        new_docs = new_docs.join(existing, "doc_key", "left_anti")
    return new_docs, existing if policy == "replace" else existing.where(F.lit(False))


def add_documents(base: Index, new_docs: DataFrame, policy: str = "error") -> Index:
    """Insert a batch ``(doc_key, text)`` into ``base`` (A6-A8); see ``accepted`` for the policies.
    ``base`` may be built, loaded or read from a stream."""
    fresh, replaced = accepted(base, new_docs, policy)
    delta = build_index(fresh, stem=base.stemmed)
    kept = without_documents(base, replaced) if policy == "replace" else base
    return merge_indexes(kept, delta, check=False)
