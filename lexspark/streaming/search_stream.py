"""Answer a stream of queries against a static index (Q9).

Every micro-batch of ``(query_id, text)`` runs the batch search
(``operators.ranking.search_many``) and writes its top-k rows to
``<out>/batch_id=<n>/`` with overwrite (idempotent on retry).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..session import scratch_scope
from ..operators.ranking import TOP_K, first_keys, search_many


def search_batch(index: Index, batch: DataFrame, batch_id: int, out: str, k: int = TOP_K,
                 fill_keys: list | None = None) -> None:
    with scratch_scope(batch.sparkSession):
        result = search_many(index, batch, k=k, fill_keys=fill_keys)
        result.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def search_stream(index: Index | Callable[[], Index], queries: DataFrame, out: str, checkpoint: str, k: int = TOP_K,
                  available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Start answering a stream of queries.  ``index`` may be a function that gives the index to use (for example
    ``tiered_store.Latest``): it is asked at each batch, so the stream moves on to a newer version at a batch border."""
    out = out.rstrip("/")
    if callable(index):
        answer = lambda df, batch_id: search_batch(index(), df, batch_id, out, k)
    else:
        keys = first_keys(index, k)  # the static index: zero-fill keys once
        answer = lambda df, batch_id: search_batch(index, df, batch_id, out, k, keys)
    writer = (queries.writeStream
              .foreachBatch(answer)
              .option("checkpointLocation", checkpoint))
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out.rstrip("/")).drop("batch_id")
