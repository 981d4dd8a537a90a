"""The index as Parquet tables (K2) and versioned publishing (K3).

Layout below ``path``::

    documents/      (doc_key, term_count)
    doc_terms/      (doc_key, term_count, terms)   forward index for batch scoring
    postings/       bucket=<b>/  (term, doc_key, freq, term_count), sorted by term, doc_key
    doc_freq/       bucket=<b>/  (term, df)
    corpus_stats/   (stat, value)
    first_keys/     the FIRST_KEYS smallest document keys (zero-fill of short result lists)

``bucket = pmod(xxhash64(term), buckets)``; unless given, there is a bucket per
``BUCKET_POSTINGS`` postings.  A search of few terms filters on literal buckets
and terms: other folders are not listed, and inside a folder the sort on ``term``
lets Parquet min/max statistics skip row groups.  A search of many terms joins on
(bucket, term), where dynamic partition pruning skips folders.  Postings are rebalanced on the bucket before the write (AQE splits
oversized partitions, so a term found in a third of all documents still spreads
over many tasks and files) and each task writes to few buckets.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.incremental import accepted, merge_indexes, without_documents
from ..operators.index import Index, build_index, from_forward, term_bucket
from ..operators.ranking import FIRST_KEYS

BUCKET_POSTINGS = 4_000_000
LEAST_BUCKETS, MOST_BUCKETS = 8, 100_000
PUBLISHED_MARKER = "_published"


def bucket_count(index: Index) -> int:
    return int(min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-index.n_postings // BUCKET_POSTINGS))))


def clustered_postings(index: Index, buckets: int) -> DataFrame:
    """Postings with ``bucket``, clustered by bucket and sorted by (term, doc_key).

    One exchange, a ``REBALANCE`` on the bucket: no sampling pass over the input,
    AQE splits a partition that grows past the advisory size (a bucket holding a
    term found in a third of all documents becomes many tasks and files) and
    merges small ones.  Each task then writes few bucket folders."""
    p = index.postings.withColumn("bucket", term_bucket("term", buckets))
    p = p.hint("rebalance", "bucket")
    return p.sortWithinPartitions("bucket", "term", "doc_key").select("bucket", "term", "doc_key", "freq", "term_count")


def write_index(index: Index, path: str, buckets: int | None = None, mode: str = "errorifexists") -> int:
    """Write the tables: the forward index first, so that documents are analyzed once, and
    everything else from the table just written.  Returns the number of buckets."""
    path = path.rstrip("/")
    spark = index.documents.sparkSession
    if index.doc_terms is not None:
        index.doc_terms.write.mode(mode).parquet(f"{path}/doc_terms")
        index = from_forward(spark.read.parquet(f"{path}/doc_terms"), index.stemmed)
    buckets = buckets or bucket_count(index)
    index.documents.write.mode(mode).parquet(f"{path}/documents")
    clustered_postings(index, buckets).write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    (index.doc_freq.select("term", "df")
     .withColumn("bucket", term_bucket("term", buckets))
     .hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
     .write.mode(mode).partitionBy("bucket").parquet(f"{path}/doc_freq"))
    written = replace(index, documents=spark.read.parquet(f"{path}/documents"),
                      doc_freq=spark.read.parquet(f"{path}/doc_freq"))
    written.corpus_stats().coalesce(1).write.mode(mode).parquet(f"{path}/corpus_stats")
    # the smallest keys, for zero-filled top-k lists without scanning every key
    (written.documents.select("doc_key").orderBy("doc_key").limit(FIRST_KEYS)
     .coalesce(1).write.mode(mode).parquet(f"{path}/first_keys"))
    return buckets


def load_index(spark: SparkSession, path: str, stemmed: bool = True, n_docs_from_stats: bool = True) -> Index:
    path = path.rstrip("/")
    documents = spark.read.parquet(f"{path}/documents")
    postings = spark.read.parquet(f"{path}/postings")
    doc_freq = spark.read.parquet(f"{path}/doc_freq")
    doc_terms = spark.read.parquet(f"{path}/doc_terms") if _exists(spark, f"{path}/doc_terms") else None
    buckets = None
    n_docs = n_postings = None
    if n_docs_from_stats:
        stats = {r["stat"]: int(r["value"]) for r in spark.read.parquet(f"{path}/corpus_stats").collect()}
        n_docs, n_postings = stats.get("n_docs", 0), stats.get("n_postings", 0)
    meta = _read_meta(spark, path)
    if "base" in meta:
        return _load_appended(spark, path, meta)
    if meta:
        buckets = int(meta.get("buckets", 0)) or None
        stemmed = meta.get("stemmed", "true") == "true"
    first = None
    if _exists(spark, f"{path}/first_keys"):
        first = sorted(r[0] for r in spark.read.parquet(f"{path}/first_keys").collect())  # <= FIRST_KEYS rows
    return Index(documents=documents, postings=postings, doc_freq=doc_freq, stemmed=stemmed,
                 buckets=buckets, doc_terms=doc_terms, _n_docs=n_docs, _n_postings=n_postings, _first_keys=first)


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    rows = [(k, str(v)) for k, v in meta.items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/_meta")


def _read_meta(spark: SparkSession, path: str) -> dict:
    if not _exists(spark, f"{path}/_meta"):
        return {}
    return {r["key"]: r["value"] for r in spark.read.json(f"{path}/_meta").collect()}


def save_index(index: Index, path: str, buckets: int | None = None, mode: str = "errorifexists") -> None:
    """``write_index`` plus the metadata ``load_index`` reads (buckets, stemming)."""
    buckets = write_index(index, path, buckets, mode)
    _write_meta(index.documents.sparkSession, path.rstrip("/"),
                {"buckets": buckets, "stemmed": "true" if index.stemmed else "false"})


# --- versioned publishing (K3) ------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _new_version(root: str) -> str:
    return f"{root.rstrip('/')}/v{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"


def _mark_published(spark: SparkSession, target: str) -> str:
    spark.createDataFrame([(target.rsplit("/", 1)[-1],)], "version string").coalesce(1).write.mode(
        "errorifexists").text(f"{target}/{PUBLISHED_MARKER}")
    return target


def publish_index(index: Index, root: str, buckets: int | None = None) -> str:
    """Full rebuild into a fresh version folder; the marker is written last, so a
    reader never sees a half-written index and the previous version stays
    readable until then.  Returns the version folder."""
    target = _new_version(root)
    save_index(index, target, buckets)
    return _mark_published(index.documents.sparkSession, target)


def append_documents(spark: SparkSession, root: str, new_docs: DataFrame, policy: str = "error") -> str:
    """Add a batch ``(doc_key, text)`` to the newest published index: a new version that holds
    the batch's own index, the keys it replaces and the name of the version it adds to.  The
    files of that version are not rewritten.  Returns the version folder."""
    versions = published_versions(spark, root)
    base = load_published(spark, root)
    fresh, replaced = accepted(base, new_docs, policy)
    target = _new_version(root)
    delta = build_index(fresh, stem=base.stemmed)
    write_index(delta, target, base.buckets)
    replaced.write.parquet(f"{target}/replaced")
    _write_meta(spark, target, {"base": versions[-1], "stemmed": "true" if base.stemmed else "false"})
    return _mark_published(spark, target)


def _load_appended(spark: SparkSession, path: str, meta: dict) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    delta = Index(documents=read("documents"), postings=read("postings"), doc_freq=read("doc_freq"),
                  stemmed=meta.get("stemmed", "true") == "true", doc_terms=read("doc_terms"))
    kept = without_documents(load_index(spark, meta["base"]), read("replaced"))
    return merge_indexes(kept, delta, check=False)


def compact(spark: SparkSession, root: str, buckets: int | None = None) -> str:
    """Publish the newest version, with all it adds to, as one full index."""
    return publish_index(load_published(spark, root), root, buckets)


def published_versions(spark: SparkSession, root: str) -> list[str]:
    """Complete versions, oldest first (listing is metadata only)."""
    root = root.rstrip("/")
    if not _exists(spark, root):
        return []
    fs, p = _fs(spark, root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    return [f"{root}/{n}" for n in names
            if n.startswith("v") and _exists(spark, f"{root}/{n}/{PUBLISHED_MARKER}/_SUCCESS")]


def load_published(spark: SparkSession, root: str) -> Index:
    versions = published_versions(spark, root)
    if not versions:
        raise FileNotFoundError(f"no published index below {root}")
    return load_index(spark, versions[-1])
