"""The term index: documents, postings, document frequencies, corpus size.

Layout (the normalized star of the relational index, as Spark tables):

  documents (doc_key, term_count BIGINT)            one row per document, empty ones too
  postings  (doc_key, term, freq BIGINT, term_count BIGINT)
                                                     one row per distinct term of a
                                                     document; the document length is
                                                     stored in every posting so ranking
                                                     needs no join with ``documents``
  doc_freq  (term, df BIGINT)                        documents containing the term
  n_docs                                             corpus size, empty documents included

Plan of ``build_index``: tokenize each document and count its terms inside the row
(``operators.counting``, in Arrow batches), explode to postings.  No shuffle
is needed for term frequencies or lengths; ``doc_freq`` is a partial
(map-side) count per term followed by one small shuffle.  Stemming
(``operators.stemming``) renames the distinct terms of a batch before they are counted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.analyze import explode_rows
from ..session import delete_path, scratch_path
from .counting import count_terms
from .stemming import changed_only, stem_term, stem_vocabulary


@dataclass
class Index:
    documents: DataFrame
    postings: DataFrame
    doc_freq: DataFrame
    stemmed: bool = True
    buckets: int | None = None          # set for a stored index partitioned by term bucket
    doc_terms: DataFrame | None = field(default=None, repr=False)   # forward index, one row per document
    _n_docs: int | None = field(default=None, repr=False)
    _n_postings: int | None = field(default=None, repr=False)
    _first_keys: list | None = field(default=None, repr=False)   # smallest keys, stored with the index
    _scratch: list = field(default_factory=list, repr=False)   # folders that ``release`` deletes

    @property
    def n_docs(self) -> int:
        """Corpus size N (one number to the driver)."""
        if self._n_docs is None:
            self._n_docs = self.documents.count()
        return self._n_docs

    @property
    def n_postings(self) -> int:
        """Postings of the corpus (one number to the driver)."""
        if self._n_postings is None:
            total = (self.doc_terms.agg(F.sum(F.size("terms"))) if self.doc_terms is not None
                     else self.postings.agg(F.count(F.lit(1))))
            self._n_postings = total.first()[0] or 0
        return self._n_postings

    def corpus_stats(self) -> DataFrame:
        """(stat, value) rows: n_docs, n_tokens (documents), n_terms, n_postings (A4)."""
        def long_form(df: DataFrame, pairs: dict) -> DataFrame:
            agg = df.agg(*[expr.alias(name) for name, expr in pairs.items()])
            rows = F.array(*[F.struct(F.lit(name).alias("stat"), F.col(name).cast("bigint").alias("value"))
                             for name in pairs])
            return agg.select(F.inline(rows))

        docs = long_form(self.documents, {"n_docs": F.count(F.lit(1)),
                                          "n_tokens": F.coalesce(F.sum("term_count"), F.lit(0))})
        terms = long_form(self.doc_freq, {"n_terms": F.count(F.lit(1)),
                                          "n_postings": F.coalesce(F.sum("df"), F.lit(0))})
        return docs.unionByName(terms)

    def release(self) -> None:
        """Delete the scratch tables of an index built with ``cache``; it is of no use afterwards."""
        for path in self._scratch:
            delete_path(self.documents.sparkSession, path)
        self._scratch.clear()


def explode_postings(analyzed: DataFrame) -> DataFrame:
    rows = explode_rows(analyzed.select("doc_key", "term_count", "term_counts"), "term_counts")
    return rows.select("doc_key", F.col("p.term").alias("term"), F.col("p.freq").alias("freq"), "term_count")


def doc_freq_of(postings: DataFrame) -> DataFrame:
    """Documents per term (A3): postings are distinct per (doc, term), so a count."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_bucket(term: Column | str, buckets: int) -> Column:
    """Stable hash bucket of a term (partition column of a stored index)."""
    t = F.col(term) if isinstance(term, str) else term
    return F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int")


def materialized_vocabulary(postings: DataFrame) -> DataFrame:
    """The stem dictionary written once as Parquet in the shared checkpoint folder
    (computed once, survives executor loss, and its size is known before the join)."""
    spark = postings.sparkSession
    path = scratch_path(spark, "stem-vocabulary")
    stem_vocabulary(postings, "term").write.parquet(path)
    return changed_only(spark.read.parquet(path))


def from_forward(doc_terms: DataFrame, stemmed: bool) -> Index:
    """The index of a forward index: documents and postings are projections of its rows."""
    postings = explode_postings(doc_terms.withColumnRenamed("terms", "term_counts"))
    return Index(documents=doc_terms.select("doc_key", "term_count"), postings=postings,
                 doc_freq=doc_freq_of(postings), stemmed=stemmed, doc_terms=doc_terms)


def build_index(docs: DataFrame, stem: bool = True, cache: bool = False) -> Index:
    """Index ``docs(doc_key, text)``.  ``stem=False`` keeps raw (case-folded) terms.

    Nothing runs yet; ``save_index`` analyzes the documents once.  An index that is used
    several times without being saved is built with ``cache``: its forward index is
    written to the shared scratch folder (``release`` deletes it) and read from there."""
    doc_terms = count_terms(docs, stem_term if stem else None)
    if not cache:
        return from_forward(doc_terms, stem)
    path = scratch_path(docs.sparkSession, "forward-index")
    doc_terms.write.parquet(path)
    index = from_forward(docs.sparkSession.read.parquet(path), stem)
    index._scratch.append(path)
    return index


def forward_index(documents: DataFrame, postings: DataFrame) -> DataFrame:
    """``doc_terms(doc_key, term_count, terms ARRAY<STRUCT<term, freq>>)`` from postings:
    one shuffle on the key; each group is one document's distinct terms."""
    grouped = postings.groupBy("doc_key").agg(
        F.array_sort(F.collect_list(F.struct("term", "freq"))).alias("terms"))
    return (documents.join(grouped, "doc_key", "left")
            .select("doc_key", "term_count",
                    F.coalesce("terms", F.array().cast("array<struct<term:string,freq:bigint>>")).alias("terms")))


def term_freq(index: Index) -> DataFrame:
    """(doc_key, term, freq) (A1)."""
    return index.postings.select("doc_key", "term", "freq")


def doc_length(index: Index) -> DataFrame:
    """(doc_key, term_count) (A2), empty documents with 0."""
    return index.documents
