"""Stemming inside the row.

The stemmer is a Python function.  ``stem_forward`` runs over Arrow batches of the
forward index: the distinct words of a batch are stemmed once (a worker remembers
``MEMO_WORDS`` of them), mapped back by code, and terms of one document that share a
stem are summed in the row.  No dictionary table, no join and no shuffle.
``stem_vocabulary`` is the dictionary itself, for those who want to see it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.analyze import is_word
from ..functions.stem import stem


@F.pandas_udf(T.StringType())
def stem_words(words: pd.Series) -> pd.Series:
    """Arrow-batched stemmer over a column of distinct words."""
    return words.map(stem)


def stem_vocabulary(terms: DataFrame, column: str = "term") -> DataFrame:
    """Dictionary ``(raw, stem)`` for the distinct words of ``terms[column]``.

    Numbers and symbols are never stemmed and words shorter than three characters
    keep their form, so neither enters the dictionary.  A left join with
    ``coalesce`` maps every word missing from it to itself.  (No filter on the
    UDF result here: the optimizer would push it below the ``distinct`` and run
    the UDF once per row; ``changed_only`` filters a materialized dictionary.)
    """
    words = (terms.select(F.col(column).alias("raw"))
             .where(is_word("raw") & (F.length("raw") >= 3))
             .distinct())
    return words.select("raw", stem_words("raw").alias("stem"))


def changed_only(vocabulary: DataFrame) -> DataFrame:
    """Entries whose stem differs from the word (apply to a stored dictionary)."""
    return vocabulary.where(F.col("stem") != F.col("raw"))


MEMO_WORDS = 200_000
_remembered = lru_cache(maxsize=MEMO_WORDS)(stem)


def stem_term(term: str) -> str:
    """The stem of a word; numbers, symbols and words shorter than three characters stay."""
    return term if len(term) < 3 or term[0].isnumeric() else _remembered(term)


@F.pandas_udf(T.StringType())
def stem_column(terms: pd.Series) -> pd.Series:
    """Terms to stems, row by row (for the few terms of queries)."""
    return terms.map(stem_term, na_action="ignore")


#: Documents of an Arrow batch that are stemmed at a time.
SLICE_DOCS = 256


def _stem_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, SLICE_DOCS) for b in batches for at in range(0, b.num_rows, SLICE_DOCS)):
        lists = batch.column("terms")
        flat = pc.list_flatten(lists)
        words = flat.field("term").dictionary_encode()
        stems = [stem_term(w) for w in words.dictionary.to_pylist()]
        names = sorted(set(stems))  # codes in the order of the strings
        code = {w: i for i, w in enumerate(names)}
        codes = np.array([code[w] for w in stems], np.int64)[words.indices.to_numpy(zero_copy_only=False)] \
            if len(flat) else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        pairs, place = np.unique(rows * max(len(names), 1) + codes, return_inverse=True)
        freq = np.zeros(len(pairs), np.int64)
        np.add.at(freq, place, flat.field("freq").to_numpy(zero_copy_only=False))
        row, term = np.divmod(pairs, max(len(names), 1))
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        entries = pa.StructArray.from_arrays(
            [pa.array(names, pa.string()).take(pa.array(term)), pa.array(freq)], names=["term", "freq"])
        yield pa.RecordBatch.from_arrays([batch.column("doc_key"), batch.column("term_count"),
                                          pa.ListArray.from_arrays(pa.array(offsets), entries)],
                                         names=["doc_key", "term_count", "terms"])


def stem_forward(doc_terms: DataFrame) -> DataFrame:
    """``doc_terms(doc_key, term_count, terms)`` with stems for words, each once per document, sorted."""
    key_type = doc_terms.schema["doc_key"].dataType.simpleString()
    return doc_terms.select("doc_key", "term_count", "terms").mapInArrow(
        _stem_batches, f"doc_key {key_type}, term_count bigint, terms array<struct<term:string,freq:bigint>>")
