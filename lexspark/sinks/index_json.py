"""The index as JSON (K1).

Written as JSON lines, one object per document and one per term, so the write
is spread over all tasks::

    docs/  {"path": "<key>", "count": <tokens>, "tf": {"<term>": <freq>, ...}}
    df/    {"term": "<term>", "df": <documents>}

or as one object ``{"docs": {path: {"tf": {...}, "count": n}}, "df": {...}}``, in ordered
fragments: the files of the folder, joined in the order of their names (``hadoop fs -getmerge``),
are the object.  ``sources.index_json`` reads both, the object also while it is in fragments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.index import Index, forward_index
from ..session import materialize


def _forward(index: Index) -> DataFrame:
    return index.doc_terms if index.doc_terms is not None else forward_index(index.documents, index.postings)


def document_objects(index: Index) -> DataFrame:
    """(path, count, tf) per document, empty documents with an empty map: a projection of
    the forward index, which has one row per document."""
    return _forward(index).select(F.col("doc_key").cast("string").alias("path"), F.col("term_count").alias("count"),
                                  F.map_from_entries("terms").alias("tf"))


def write_json_index(index: Index, path: str, mode: str = "errorifexists") -> None:
    path = path.rstrip("/")
    document_objects(index).write.mode(mode).json(f"{path}/docs")
    index.doc_freq.select("term", "df").write.mode(mode).json(f"{path}/df")


def _entry(key: Column, value: Column) -> Column:
    """``"key":value`` as text."""
    alone = F.to_json(F.create_map(key, value))
    return F.substring(alone, F.lit(2), F.length(alone) - 2)


def object_lines(index: Index) -> DataFrame:
    """The lines of the one-object form, which in the order of the partitions are the object: its sections lie one after
    the other, and only the first entry of each has no comma before it.  Nothing is sorted or shuffled."""
    docs = document_objects(index).select(F.col("path").alias("key"), _entry(F.col("path"), F.struct("tf", "count")).alias("entry"))
    terms = materialize(index.doc_freq.select("term", "df"), "json-terms")
    terms = terms.select(F.col("term").alias("key"), _entry(F.col("term"), F.col("df")).alias("entry"))
    spark = index.doc_freq.sparkSession
    line = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    lines = line('{"docs":{')
    for entries, after in ((docs, '},"df":{'), (terms, "}}")):
        first = entries.agg(F.min("key")).first()[0]  # one key to the driver
        others = entries.where(F.col("key") != F.lit(first)).select(F.concat(F.lit(","), "entry").alias("value"))
        # copies of the first key, if it is not distinct, are one line
        lead = entries.where(F.col("key") == F.lit(first)).agg(F.array_join(F.collect_list("entry"), ",").alias("value"))
        lines = lines.union(lead).union(others).union(line(after))
    return lines


def write_json_object_index(index: Index, path: str, mode: str = "errorifexists") -> None:
    """The one-object form as ordered fragments, one per task.  Keys are distinct, not null."""
    object_lines(index).write.mode(mode).text(path)


def legacy_objects(index: Index) -> DataFrame:
    """One ``{path: {term: freq}}`` object per document (the legacy layout; ``{}`` for an empty
    document), as JSON text lines in column ``value``."""
    tf = F.map_from_entries("terms")
    return _forward(index).select(F.to_json(F.create_map(F.col("doc_key").cast("string"), tf)).alias("value"))


def write_legacy_index(index: Index, path: str, mode: str = "errorifexists") -> None:
    legacy_objects(index).write.mode(mode).text(path)
