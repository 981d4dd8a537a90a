"""Index a stream of documents (X1) with unique keys across batches (X2).

Each micro-batch is indexed on its own (a delta index) and written below ``<out>``
as ``documents/batch_id=<n>/``, ``doc_terms/batch_id=<n>/`` (the forward index, of which postings are
projections) and, where it replaces stored documents, ``replaced/batch_id=<n>/``, each with overwrite, so a
batch retried after a failure replaces its own output (idempotent).  Streams begun before there was
``doc_terms`` hold ``postings/batch_id=<n>/`` for their first batches; they are read as well.  ``complete/batch_id=<n>/`` is
written last; readers use complete batches only, so a half-written batch is never seen.

Policies for a key that an earlier batch wrote: ``ignore`` drops the new document,
``replace`` lets the new text win.  A key repeated inside a batch keeps one copy.
The keys of a batch lie in key buckets with a Bloom filter each (``key_filters``): a later batch reads only
the folders that may hold one of its keys.

Document frequencies are summed at read time (``read_stream_index``), the same as
a full build; publishing that index compacts the batches.  With ``events`` each batch also publishes what
it adds to and takes off each term, and ``doc_freq_stream`` keeps the frequencies as the state of a
streaming aggregation: a batch then costs the terms it changes, not a recount.

Whether terms are stemmed is stored next to the batches (``_meta``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index, build_index, doc_freq_of, forward_index, from_forward
from ..operators.sizing import broadcast_if_small
from ..session import delete_path, materialize, scratch_path, scratch_scope
from ..sinks.index_store import _exists, _fs, _read_meta, _write_meta
from . import key_filters


def earlier_rows(spark: SparkSession, out: str, batch_id: int, batch_keys: DataFrame) -> DataFrame | None:
    """``doc_key, batch_id`` of this batch's keys in earlier batches.

    The filters name the folders that may hold a key; those are read (literal partition filters) and
    semi-joined against the batch's keys, so other stored keys are never scanned."""
    if not _exists(spark, f"{out}/documents"):
        return None
    if not _exists(spark, f"{out}/key_filters"):  # written before there were filters: every key is scanned
        stored = spark.read.parquet(f"{out}/documents").where(F.col("batch_id") < batch_id)
        stored = stored.select("doc_key", F.col("batch_id").cast("long").alias("batch_id"))
        return stored.join(broadcast_if_small(batch_keys), "doc_key", "left_semi")
    filters = spark.read.parquet(f"{out}/key_filters").where(F.col("batch_id") < batch_id)
    folders = key_filters.candidate_folders(filters, batch_keys)
    if not folders:
        return None
    by_batch: dict[int, list[int]] = {}
    for batch, bucket in folders:
        by_batch.setdefault(batch, []).append(bucket)
    wanted = reduce(lambda a, b: a | b, [(F.col("batch_id") == n) & F.col("key_bucket").isin(b) for n, b in by_batch.items()])
    stored = spark.read.parquet(f"{out}/documents").where(wanted).select("doc_key", F.col("batch_id").cast("long").alias("batch_id"))
    return stored.join(broadcast_if_small(batch_keys), "doc_key", "left_semi")


STREAM_POLICIES = ("ignore", "replace")


def index_batch(batch: DataFrame, batch_id: int, out: str, stem: bool = True, policy: str = "ignore",
                events: bool = False) -> None:
    """Index one micro-batch ``(doc_key, text)`` into ``out`` (idempotent)."""
    if policy not in STREAM_POLICIES:
        raise ValueError(f"policy must be one of {STREAM_POLICIES}")
    spark = batch.sparkSession
    with scratch_scope(spark):
        # a key repeated inside the batch keeps one copy, chosen deterministically
        # (smallest text) so that a retried batch writes the same rows
        docs = batch.groupBy("doc_key").agg(F.min("text").alias("text"))
        forward = f"{out}/doc_terms/batch_id={batch_id}"
        build_index(docs, stem=stem).doc_terms.write.mode("overwrite").parquet(forward)
        delta = from_forward(spark.read.parquet(forward), stem)
        if _exists(spark, f"{out}/postings/batch_id={batch_id}"):  # left by a failed batch that kept postings
            delete_path(spark, f"{out}/postings/batch_id={batch_id}")
        known = earlier_rows(spark, out, batch_id, delta.documents.select("doc_key"))
        if known is not None:
            known = materialize(known.groupBy("doc_key").agg(F.max("batch_id").alias("batch_id")), f"stream-known-{batch_id}")
        if known is not None and policy == "ignore" and not known.isEmpty():
            fresh = delta.doc_terms.join(broadcast_if_small(known.select("doc_key")), "doc_key", "left_anti")
            materialize(fresh, f"stream-batch-{batch_id}").write.mode("overwrite").parquet(forward)
            delta = from_forward(spark.read.parquet(forward), stem)
        elif known is not None and policy == "replace":
            known.select("doc_key").write.mode("overwrite").parquet(f"{out}/replaced/batch_id={batch_id}")
        keyed = delta.documents.withColumn("key_bucket", key_filters.key_bucket("doc_key"))
        keyed.repartition("key_bucket").write.mode("overwrite").partitionBy("key_bucket").parquet(f"{out}/documents/batch_id={batch_id}")
        key_filters.build(delta.documents.select("doc_key")).write.mode("overwrite").parquet(f"{out}/key_filters/batch_id={batch_id}")
        if events:
            _publish_events(spark, out, batch_id, delta.doc_freq, known if policy == "replace" else None)
        spark.range(1).write.mode("overwrite").parquet(f"{out}/complete/batch_id={batch_id}")


def _postings(spark: SparkSession, out: str, rows_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The postings of the rows that ``rows_of`` takes from what the batches stored: documents are chosen first, a row each."""
    found = []
    if _exists(spark, f"{out}/doc_terms"):
        found.append(from_forward(rows_of(spark.read.parquet(f"{out}/doc_terms")), False).postings)
    if _exists(spark, f"{out}/postings"):
        found.append(rows_of(spark.read.parquet(f"{out}/postings")).select("doc_key", "term", "freq", "term_count"))
    return reduce(DataFrame.unionByName, found)


def _publish_events(spark: SparkSession, out: str, batch_id: int, added: DataFrame, replaced: DataFrame | None) -> None:
    """``term, delta`` of a batch below ``df_events``: what it adds, less the terms of the documents it replaces.  The
    folder appears by one rename and is never written again, so a retried batch does not count twice."""
    final = f"{out}/df_events/batch_id={batch_id}"
    if _exists(spark, final):
        return
    events = added.select("term", F.col("df").cast("long").alias("delta"))
    if replaced is not None:
        batches = [r[0] for r in replaced.select("batch_id").distinct().collect()]  # at most the batches of the stream
        def rows_of(stored: DataFrame) -> DataFrame:
            stored = stored.where(F.col("batch_id").isin(batches)).withColumn("batch_id", F.col("batch_id").cast("long"))
            return stored.join(replaced, ["doc_key", "batch_id"], "left_semi")
        old = _postings(spark, out, rows_of)
        events = events.unionByName(old.groupBy("term").agg((-F.count(F.lit(1))).alias("delta")))
    events = events.groupBy("term").agg(F.sum("delta").alias("delta")).where("delta <> 0")
    staged = scratch_path(spark, f"df-events-{batch_id}")
    events.write.parquet(staged)
    fs, target = _fs(spark, final)
    fs.mkdirs(target.getParent())
    if not fs.rename(_fs(spark, staged)[1], target):
        delete_path(spark, staged)
        raise RuntimeError(f"{final} could not be published")


def doc_freq_stream(spark: SparkSession, out: str, state: str, checkpoint: str) -> StreamingQuery:
    """Start the stream that keeps document frequencies as state: the events of new batches are summed per term in
    the state store, and the terms that changed are written to ``state`` (idempotent per epoch).  It may be stopped and
    started again at any time."""
    events = spark.readStream.schema("term string, delta long, batch_id int").parquet(f"{out.rstrip('/')}/df_events")

    def write(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state.rstrip('/')}/epoch={epoch}")
    return (events.groupBy("term").agg(F.sum("delta").alias("df")).writeStream.outputMode("update")
            .foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_doc_freq(spark: SparkSession, state: str) -> DataFrame:
    """``term, df``: the newest value of each term written by ``doc_freq_stream``."""
    rows = spark.read.parquet(state.rstrip("/"))
    return rows.groupBy("term").agg(F.max_by("df", "epoch").alias("df")).where("df > 0")


def index_stream(docs: DataFrame, out: str, checkpoint: str, stem: bool = True, policy: str = "ignore",
                 available_now: bool = True, processing_time: str | None = None, events: bool = False) -> StreamingQuery:
    """Start the indexing stream over a streaming DataFrame ``(doc_key, text)``."""
    out, spark = out.rstrip("/"), docs.sparkSession
    if not _read_meta(spark, out):
        _write_meta(spark, out, {"stemmed": "true" if stem else "false"})
    writer = (docs.writeStream
              .foreachBatch(lambda df, batch_id: index_batch(df, batch_id, out, stem, policy, events))
              .option("checkpointLocation", checkpoint))
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def complete_batches(spark: SparkSession, out: str) -> list[int]:
    """Ids of the batches that were written to their end."""
    return sorted(r[0] for r in spark.read.parquet(f"{out.rstrip('/')}/complete").select("batch_id").distinct().collect())


def read_stream_index(spark: SparkSession, out: str, stemmed: bool | None = None) -> Index:
    """The index written by ``index_stream``: union of all complete batches without the documents
    that later ones replaced, df summed.  ``stemmed`` is read from what the stream stored, where it did."""
    out = out.rstrip("/")
    stored = _read_meta(spark, out).get("stemmed")
    stemmed = stored == "true" if stored else True if stemmed is None else stemmed
    batches = complete_batches(spark, out)
    replaced = None
    if _exists(spark, f"{out}/replaced"):
        replaced = (spark.read.parquet(f"{out}/replaced").where(F.col("batch_id").isin(batches))
                    .groupBy("doc_key").agg(F.max("batch_id").alias("since")))

    def current(df: DataFrame) -> DataFrame:
        df = df.where(F.col("batch_id").isin(batches))
        if replaced is not None:
            df = df.join(replaced, "doc_key", "left").where(F.col("since").isNull() | (F.col("batch_id") >= F.col("since")))
            df = df.drop("since")
        return df.drop("batch_id", "key_bucket")

    documents, postings = current(spark.read.parquet(f"{out}/documents")), _postings(spark, out, current)
    doc_terms = (forward_index(documents, postings) if _exists(spark, f"{out}/postings")
                 else current(spark.read.parquet(f"{out}/doc_terms")))
    return Index(documents=documents, postings=postings, doc_freq=doc_freq_of(postings), stemmed=stemmed, doc_terms=doc_terms)
