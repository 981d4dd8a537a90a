"""Document sources from tables: any (key, text) pair becomes a corpus."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give per-row heavy work (regex over whole texts) at least the cluster's
    parallelism.  A big source already has many splits and is left untouched
    (no shuffle); only a source with fewer splits than cores is spread
    round-robin.  A plan that joins or groups is left to adaptive execution:
    asking for its number of partitions would run it.
    """
    if df.isStreaming:
        return df  # a stream's micro-batches are planned per batch
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if re.search(r"^\W*(Join|Aggregate|Repartition|Sort|Window|Distinct|GlobalLimit|FlatMapGroups)", plan, re.M):
        return df
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def from_table(df: DataFrame, key: str | Column, text: str | Column,
               extra: list[str] | None = None, spread_input: bool = True) -> DataFrame:
    """Documents ``(doc_key, text)`` from any table; ``key`` must be unique.

    The key keeps its type (``doc_id BIGINT``, a path STRING, ...).  Only the two
    columns (and ``extra``) are selected, so Parquet reads nothing else.
    """
    k = F.col(key) if isinstance(key, str) else key
    t = F.col(text) if isinstance(text, str) else text
    cols = [k.alias("doc_key"), t.cast("string").alias("text")] + [F.col(c) for c in (extra or [])]
    out = df.select(*cols)
    return spread(out) if spread_input else out


def scope(df: DataFrame, column: str, values: list) -> DataFrame:
    """Index only the chosen sources (S2): a plain filter that Catalyst pushes
    into the Parquet scan."""
    return df.where(F.col(column).isin(list(values)))


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
