"""Registered queries: each ``(spark, sf_dir) -> DataFrame`` runs over whole tables.

Column names equal those of ``plans.oracle``; ranks are rounded to
``RANK_DECIMALS`` in both.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.analyze import explode_rows, token_array, token_kind
from ..operators import incremental as inc
from ..operators import index as ix
from ..operators import ranking as rk
from ..operators.sizing import broadcast_if_small
from ..session import materialize, scratch_path
from ..sinks import index_json, results
from ..sinks import index_store as store
from ..sinks import tiered_store as tiered
from ..sources.files import indexable, read_folder, reason_class
from ..sources.files import skip_accounting as files_skip_accounting
from ..sources.index_json import legacy_index, read_json_index, read_json_object_index
from ..sources.markup import pages_as_documents, xml_documents
from ..sources.tables import from_table, read_table, scope, spread
from ..streaming import index_stream, search_stream
from . import params as P
from . import standins


# --- helpers ----------------------------------------------------------------

def documents_index(spark: SparkSession, sf_dir: str, stem: bool = False) -> ix.Index:
    docs = from_table(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return ix.build_index(docs, stem=stem, cache=True)


def _as_doc_id(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("doc_key", "doc_id")


def _bigint_rn(df: DataFrame) -> DataFrame:
    return df.withColumn("rn", F.col("rn").cast("bigint"))


def _single(index: ix.Index, text: str) -> DataFrame:
    return _bigint_rn(_as_doc_id(rk.search(index, text)))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- analyzer and index ------------------------------------------------------

def tokenize_documents(spark, sf_dir):
    """(doc_id, pos, token): case-folded tokens in text order, 1-based positions."""
    docs = from_table(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    toks = explode_rows(docs.select("doc_key", token_array("text").alias("tokens")), "tokens", "token", "pos")
    return toks.select(F.col("doc_key").alias("doc_id"), (F.col("pos") + 1).cast("bigint").alias("pos"), "token")


def token_kinds(spark, sf_dir):
    """(kind, tokens, terms) for numbers, words and symbols."""
    docs = from_table(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    toks = explode_rows(docs.select(token_array("text").alias("tokens")), "tokens", "term")
    return (toks.groupBy(token_kind("term").alias("kind"))
            .agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("term").alias("terms")))


def term_freq(spark, sf_dir):
    return _as_doc_id(ix.term_freq(documents_index(spark, sf_dir)))


def doc_length(spark, sf_dir):
    return _as_doc_id(ix.doc_length(documents_index(spark, sf_dir)))


def doc_freq(spark, sf_dir):
    return documents_index(spark, sf_dir).doc_freq


def corpus_stats(spark, sf_dir):
    return documents_index(spark, sf_dir).corpus_stats()


def idf(spark, sf_dir):
    t = rk.idf_table(documents_index(spark, sf_dir))
    return t.withColumn("idf", F.round("idf", rk.RANK_DECIMALS))


def tfidf_weights(spark, sf_dir):
    w = rk.tfidf_weights(documents_index(spark, sf_dir))
    for c in ("tf", "idf", "tfidf"):
        w = w.withColumn(c, F.round(c, rk.RANK_DECIMALS))
    return _as_doc_id(w)


# --- ranking ----------------------------------------------------------------

def search_top20(spark, sf_dir):
    return _single(documents_index(spark, sf_dir), P.QUERY_TOP20)


def rank_all(spark, sf_dir):
    return _as_doc_id(rk.rank_all(documents_index(spark, sf_dir), P.QUERY_TOP20))


def search_repeated_and_symbols(spark, sf_dir):
    return _single(documents_index(spark, sf_dir), P.QUERY_REPEATS)


def search_no_match(spark, sf_dir):
    return _single(documents_index(spark, sf_dir), P.QUERY_NO_MATCH)


def search_many(spark, sf_dir):
    """Hits only (rank > 0), top 20 per benchmark query."""
    out = rk.search_many(documents_index(spark, sf_dir), _benchmark(spark, sf_dir), fill=False)
    return _bigint_rn(_as_doc_id(out))


def search_many_zero_fill(spark, sf_dir):
    out = rk.search_many(documents_index(spark, sf_dir), _benchmark(spark, sf_dir))
    return _bigint_rn(_as_doc_id(out))


def search_conversations(spark, sf_dir):
    """User turns as queries; the query key is the pair (conv_id, turn)."""
    return _conversations(spark, sf_dir, "auto")


def _conversations(spark, sf_dir, plan):
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    queries = conv.select(F.struct("conv_id", "turn").alias("query_id"), "text")
    out = rk.search_many(documents_index(spark, sf_dir), queries, plan=plan)
    return _bigint_rn(out.select(F.col("query_id.conv_id").alias("conv_id"), F.col("query_id.turn").alias("turn"),
                                 "rn", F.col("doc_key").alias("doc_id"), "rank"))


def search_many_by_documents(spark, sf_dir):
    """``search_many_zero_fill`` by the plan that scores the forward index, at any size."""
    out = rk.search_many(documents_index(spark, sf_dir), _benchmark(spark, sf_dir), plan="documents")
    return _bigint_rn(_as_doc_id(out))


def search_many_by_terms(spark, sf_dir):
    """``search_many_zero_fill`` by the plan that joins postings, at any size."""
    out = rk.search_many(documents_index(spark, sf_dir), _benchmark(spark, sf_dir), plan="terms")
    return _bigint_rn(_as_doc_id(out))


def search_conversations_by_documents(spark, sf_dir):
    return _conversations(spark, sf_dir, "documents")


def search_scoped(spark, sf_dir):
    docs = scope(read_table(spark, sf_dir, "documents"), "source", P.SCOPED_SOURCES)
    index = ix.build_index(from_table(docs, "doc_id", "text"), stem=False)
    return _bigint_rn(_as_doc_id(rk.search_many(index, _benchmark(spark, sf_dir))))


def search_result_json(spark, sf_dir):
    top = rk.search_many(documents_index(spark, sf_dir), _benchmark(spark, sf_dir))
    return results.result_json(top)


def search_result_lines(spark, sf_dir):
    top = rk.search_many(documents_index(spark, sf_dir), _benchmark(spark, sf_dir))
    return _bigint_rn(results.result_lines(top))


# --- HTML pages ---------------------------------------------------------------

def html_text(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return pages_as_documents(pages).select(F.col("doc_key").alias("page_id"), "text")


def _pages_index(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    docs = from_table(pages_as_documents(pages), "doc_key", "text")
    return ix.build_index(docs, stem=False, cache=True)


def pages_doc_freq(spark, sf_dir):
    return _pages_index(spark, sf_dir).doc_freq


def pages_search(spark, sf_dir):
    out = rk.search(_pages_index(spark, sf_dir), P.QUERY_PAGES)
    return _bigint_rn(out.withColumnRenamed("doc_key", "page_id"))


# --- stemming ---------------------------------------------------------------

def stem_vocabulary(spark, sf_dir):
    """(raw, stem): every distinct word of the corpus whose stem differs."""
    idx = documents_index(spark, sf_dir, stem=False)
    return ix.materialized_vocabulary(idx.postings)


def stem_doc_freq(spark, sf_dir):
    """Document frequencies of a stemmed index."""
    return documents_index(spark, sf_dir, stem=True).doc_freq


def search_stemmed(spark, sf_dir):
    return _single(documents_index(spark, sf_dir, stem=True), P.QUERY_STEMMED)


def search_many_stemmed(spark, sf_dir):
    out = rk.search_many(documents_index(spark, sf_dir, stem=True), _benchmark(spark, sf_dir))
    return _bigint_rn(_as_doc_id(out))


# --- storage ------------------------------------------------------------------

def index_roundtrip_parquet(spark, sf_dir):
    """Write the index as partitioned Parquet, load it, return its postings."""
    path = scratch_path(spark, "index-parquet")
    store.save_index(documents_index(spark, sf_dir), path, buckets=P.BUCKETS)
    loaded = store.load_index(spark, path)
    return _as_doc_id(loaded.postings.select("doc_key", "term", "freq", "term_count"))


def _stored(spark, sf_dir):
    path = scratch_path(spark, "index-stored")
    docs = from_table(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    index = ix.build_index(docs, stem=False)
    store.save_index(index, path, buckets=P.BUCKETS)
    return store.load_index(spark, path)


def search_stored(spark, sf_dir):
    """One literal query on the stored index."""
    return _single(_stored(spark, sf_dir), P.QUERY_TOP20)


def search_many_stored(spark, sf_dir):
    """The benchmark queries on the stored index."""
    return _bigint_rn(_as_doc_id(rk.search_many(_stored(spark, sf_dir), _benchmark(spark, sf_dir))))


def index_roundtrip_json(spark, sf_dir):
    path = scratch_path(spark, "index-json")
    index_json.write_json_index(documents_index(spark, sf_dir), path)
    loaded = read_json_index(spark, path, stemmed=False)
    return loaded.postings.select(F.col("doc_key").cast("bigint").alias("doc_id"), "term", "freq", "term_count")


def index_roundtrip_json_object(spark, sf_dir):
    """The index written as one JSON object in ordered fragments, read back by byte ranges."""
    path = scratch_path(spark, "index-json-object")
    index_json.write_json_object_index(documents_index(spark, sf_dir), path)
    loaded = read_json_object_index(spark, path, stemmed=False)
    return loaded.postings.select(F.col("doc_key").cast("bigint").alias("doc_id"), "term", "freq", "term_count")


def legacy_import(spark, sf_dir):
    """Postings written in the legacy ``{path: {term: freq}}`` layout, imported back."""
    path = scratch_path(spark, "index-legacy")
    index_json.write_legacy_index(documents_index(spark, sf_dir), path)
    imported = legacy_index(spark, path)
    return imported.postings.select(F.col("doc_key").cast("bigint").alias("doc_id"), "term", "freq", "term_count")


def published_index(spark, sf_dir):
    """Publish two versions; the reader sees the newest complete one."""
    root = scratch_path(spark, "published")
    docs = read_table(spark, sf_dir, "documents")
    old = ix.build_index(from_table(scope(docs, "source", P.SCOPED_SOURCES), "doc_id", "text"), stem=False)
    store.publish_index(old, root, buckets=P.BUCKETS)
    store.publish_index(documents_index(spark, sf_dir), root, buckets=P.BUCKETS)
    return store.load_published(spark, root).doc_freq.select("term", "df")


def surrogate_ids(spark, sf_dir):
    """(n_keys, n_ids, collisions) of xxhash64 surrogate ids over document keys."""
    docs = from_table(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    ids = inc.surrogate_ids(docs)
    coll = inc.surrogate_collisions(ids)
    return ids.agg(F.countDistinct("doc_key").alias("n_keys"), F.countDistinct("doc_id").alias("n_ids")) \
        .withColumn("collisions", F.lit(coll.count()).cast("bigint"))


# --- incremental ------------------------------------------------------------------

def _later():
    """Documents of the later batch; one without a source is in the first."""
    return F.coalesce(F.col("source") >= P.DELTA_FROM_SOURCE, F.lit(False))


def merge_doc_freq(spark, sf_dir):
    """Index the documents in two batches and merge: equals a full build."""
    docs = read_table(spark, sf_dir, "documents")
    later = _later()
    base = ix.build_index(from_table(docs.where(~later), "doc_id", "text"), stem=False)
    delta = ix.build_index(from_table(docs.where(later), "doc_id", "text"), stem=False)
    return inc.merge_indexes(base, delta).doc_freq


def replace_document(spark, sf_dir):
    """Benchmark texts replace the documents with the same key (policy replace)."""
    base = documents_index(spark, sf_dir)
    new = from_table(read_table(spark, sf_dir, "benchmark"), "item_id", "text")
    return inc.add_documents(base, new, policy="replace").doc_freq


def _append(spark, sf_dir, base, new, policy):
    root = scratch_path(spark, "appended")
    index = ix.build_index(base, stem=False)
    store.publish_index(index, root, buckets=P.BUCKETS)
    store.append_documents(spark, root, new, policy)
    return store.load_published(spark, root)


def add_to_stored_index(spark, sf_dir):
    """The later sources are appended to a published index of the others: its postings."""
    docs = read_table(spark, sf_dir, "documents")
    later = _later()
    index = _append(spark, sf_dir, from_table(docs.where(~later), "doc_id", "text"),
                    from_table(docs.where(later), "doc_id", "text"), "error")
    return _as_doc_id(index.postings.select("doc_key", "term", "freq", "term_count"))


def replace_in_stored_index(spark, sf_dir):
    """Benchmark texts replace documents of a published index: its document frequencies."""
    index = _append(spark, sf_dir, from_table(read_table(spark, sf_dir, "documents"), "doc_id", "text"),
                    from_table(read_table(spark, sf_dir, "benchmark"), "item_id", "text"), "replace")
    return index.doc_freq.select("term", "df")


# --- packed postings and the tiered store -----------------------------------------

def _packed(spark, sf_dir):
    root = scratch_path(spark, "packed")
    tiered.create(documents_index(spark, sf_dir), root, buckets=P.BUCKETS, span=P.SPAN)
    return tiered.load(spark, root)


def packed_postings(spark, sf_dir):
    """The postings packed into blocks over dense ids, decoded again."""
    return _as_doc_id(_packed(spark, sf_dir).postings())


def dense_ids(spark, sf_dir):
    """(doc_id, number): the documents numbered 0, 1, 2... by length, then key."""
    index = _packed(spark, sf_dir)
    return _as_doc_id(index.documents.select("doc_key", F.col("doc").alias("number")))


def search_block_max(spark, sf_dir):
    """The top 20 of a query of common and rare words, from the blocks that can reach them."""
    return _bigint_rn(_as_doc_id(tiered.search(_packed(spark, sf_dir), P.QUERY_TOP20)))


def _tiered(spark, sf_dir):
    """An index of the documents, the later sources added in five batches."""
    docs = read_table(spark, sf_dir, "documents").withColumn("batch", F.when(_later(), F.pmod(F.xxhash64("doc_id"), F.lit(5))))
    of_batch = lambda test: from_table(docs.where(test), "doc_id", "text")
    root = scratch_path(spark, "tiered")
    tiered.create(ix.build_index(of_batch("batch is null"), stem=False), root, buckets=P.BUCKETS, span=P.SPAN)
    for n in range(5):
        tiered.append(spark, root, of_batch(F.col("batch") == n), "error")
    return root


def tiered_index_search(spark, sf_dir):
    """Top 20 from the index after five additions."""
    return _bigint_rn(_as_doc_id(tiered.search(tiered.load(spark, _tiered(spark, sf_dir)), P.QUERY_TOP20)))


def tiered_replace(spark, sf_dir):
    """Benchmark texts replace documents of the index: its document frequencies without the removed ones."""
    root = scratch_path(spark, "tiered")
    tiered.create(documents_index(spark, sf_dir), root, buckets=P.BUCKETS, span=P.SPAN)
    tiered.append(spark, root, from_table(read_table(spark, sf_dir, "benchmark"), "item_id", "text"), "replace")
    return tiered.load(spark, root).doc_freq


def rank_all_ordered(spark, sf_dir):
    """Every document in order of rank, with its position."""
    return _as_doc_id(rk.rank_all_ordered(documents_index(spark, sf_dir), P.QUERY_TOP20))


def duplicate_keys(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    batch = docs.unionByName(docs.where(F.col("source") == P.DUPLICATED_SOURCE))
    return inc.duplicate_keys(batch.select("doc_id"), "doc_id")


def _doubled(spark, sf_dir):
    """An index whose postings of one source were written twice."""
    index = documents_index(spark, sf_dir)
    again = from_table(scope(read_table(spark, sf_dir, "documents"), "source", [P.DUPLICATED_SOURCE]), "doc_id", "text")
    # the documents are chosen, a row each, before their postings are exploded: no posting is shuffled
    keys = broadcast_if_small(materialize(again.select("doc_key"), "doubled-keys"))
    twice = ix.from_forward(index.doc_terms.join(keys, "doc_key", "left_semi"), index.stemmed).postings
    return dataclasses.replace(index, postings=index.postings.unionByName(twice), _scratch=[])


def duplicate_postings(spark, sf_dir):
    """(doc_id, term, copies) of the postings that are there twice."""
    return _as_doc_id(inc.duplicate_postings(_doubled(spark, sf_dir).postings))


def wrong_terms(spark, sf_dir):
    """(term, copies, df, counted) of the terms whose df is not the number of their postings."""
    return inc.wrong_terms(_doubled(spark, sf_dir))


def orphan_postings(spark, sf_dir):
    """Postings whose document row is missing: (doc_id, postings, tokens)."""
    docs = read_table(spark, sf_dir, "documents")
    index = documents_index(spark, sf_dir)
    kept = from_table(docs.where(F.col("source") != P.ORPHANED_SOURCE), "doc_id", "text", spread_input=False)
    orphans = inc.orphan_postings(index.postings, kept.select("doc_key"))
    return (orphans.groupBy(F.col("doc_key").alias("doc_id"))
            .agg(F.count(F.lit(1)).alias("postings"), F.sum("freq").alias("tokens")))


# --- streams ------------------------------------------------------------------

def _doc_stream(spark, src):
    schema = "doc_id bigint, text string"
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
            .select(F.col("doc_id").alias("doc_key"), "text"))


def stream_doc_freq(spark, sf_dir):
    """Documents arrive as a file stream (several micro-batches)."""
    src = scratch_path(spark, "stream-docs")
    standins.write_stream_source(read_table(spark, sf_dir, "documents").select("doc_id", "text"), src,
                                 P.STREAM_FILES, "doc_id")
    out = scratch_path(spark, "stream-index")
    q = index_stream.index_stream(_doc_stream(spark, src), out, scratch_path(spark, "stream-ckpt"), stem=False)
    q.awaitTermination()
    return index_stream.read_stream_index(spark, out, stemmed=False).doc_freq


def stream_unique_keys(spark, sf_dir):
    """The documents of one source arrive twice, in a later file: keys stay unique."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    src = scratch_path(spark, "stream-dups")
    standins.write_stream_source(docs.select("doc_id", "text"), f"{src}/a", P.STREAM_FILES, "doc_id")
    # one file, written by one task that gets only these rows: a coalesce(1) would scan the whole table in it
    docs.where(F.col("source") == P.DUPLICATED_SOURCE).select("doc_id", "text") \
        .repartition(1).write.parquet(f"{src}/b")
    out = scratch_path(spark, "stream-index")
    stream = (spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src)
              .select(F.col("doc_id").alias("doc_key"), "text"))
    q = index_stream.index_stream(stream, out, scratch_path(spark, "stream-ckpt"), stem=False)
    q.awaitTermination()
    return index_stream.read_stream_index(spark, out).documents.select(F.col("doc_key").alias("doc_id"))


def stream_replace(spark, sf_dir):
    """Benchmark texts arrive after the documents and replace those of the same key."""
    src = scratch_path(spark, "stream-replace")
    standins.write_stream_source(read_table(spark, sf_dir, "documents").select("doc_id", "text"), f"{src}/a",
                                 P.STREAM_FILES, "doc_id")
    read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text") \
        .coalesce(1).write.parquet(f"{src}/b")
    out = scratch_path(spark, "stream-index")
    stream = (spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src)
              .select(F.col("doc_id").alias("doc_key"), "text"))
    q = index_stream.index_stream(stream, out, scratch_path(spark, "stream-ckpt"), stem=False, policy="replace")
    q.awaitTermination()
    return index_stream.read_stream_index(spark, out, stemmed=False).doc_freq


def stream_state_doc_freq(spark, sf_dir):
    """Documents, then benchmark texts that replace some, arrive as a stream; the document frequencies are
    the state of a second stream, which is stopped and started again from its checkpoint in between."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    src, out, state = (scratch_path(spark, f"stream-state-{n}") for n in ("docs", "index", "df"))
    ckpt, df_ckpt = scratch_path(spark, "stream-ckpt"), scratch_path(spark, "stream-ckpt")
    stream = lambda: (spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1)
                      .option("recursiveFileLookup", "true").parquet(src).select(F.col("doc_id").alias("doc_key"), "text"))

    def run():
        index_stream.index_stream(stream(), out, ckpt, stem=False, policy="replace", events=True).awaitTermination()
        index_stream.doc_freq_stream(spark, out, state, df_ckpt).awaitTermination()

    standins.write_stream_source(docs, f"{src}/a", P.STREAM_FILES, "doc_id")
    run()
    read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text").coalesce(1).write.parquet(f"{src}/b")
    run()
    return index_stream.read_doc_freq(spark, state)


def stream_stemmed_doc_freq(spark, sf_dir):
    """Documents arrive as a stream and are indexed by stems."""
    src = scratch_path(spark, "stream-docs")
    standins.write_stream_source(read_table(spark, sf_dir, "documents").select("doc_id", "text"), src,
                                 P.STREAM_FILES, "doc_id")
    out = scratch_path(spark, "stream-index")
    index_stream.index_stream(_doc_stream(spark, src), out, scratch_path(spark, "stream-ckpt")).awaitTermination()
    index = index_stream.read_stream_index(spark, out)
    return index.doc_freq.select("term", "df")


def stream_search(spark, sf_dir):
    """Benchmark queries arrive as a stream against a static index."""
    src = scratch_path(spark, "stream-queries")
    standins.write_stream_source(_benchmark(spark, sf_dir), src, P.STREAM_FILES, "query_id")
    queries = (spark.readStream.schema("query_id bigint, text string").option("maxFilesPerTrigger", 1)
               .parquet(src))
    out = scratch_path(spark, "stream-results")
    q = search_stream.search_stream(documents_index(spark, sf_dir), queries, out, scratch_path(spark, "stream-ckpt"))
    q.awaitTermination()
    return _bigint_rn(_as_doc_id(search_stream.read_results(spark, out)))


def stream_search_refresh(spark, sf_dir):
    """Benchmark queries arrive as a stream, some before and the others after the later sources were added to
    the index: the stream moves on to the new version at the batch border."""
    docs, queries = read_table(spark, sf_dir, "documents"), _benchmark(spark, sf_dir)
    root, src, out, ckpt = (scratch_path(spark, f"refresh-{n}") for n in ("index", "queries", "results", "ckpt"))
    early = F.coalesce(F.col("text") < "M", F.lit(False))
    index = ix.build_index(from_table(docs.where(~_later()), "doc_id", "text"), stem=False)
    tiered.create(index, root, buckets=P.BUCKETS, span=P.SPAN)
    latest = tiered.Latest(spark, root, "query-stream")

    def answer(some):
        some.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("query_id bigint, text string").parquet(src)
        search_stream.search_stream(latest, stream, out, ckpt).awaitTermination()
    answer(queries.where(early))
    tiered.append(spark, root, from_table(docs.where(_later()), "doc_id", "text"), "error")
    answer(queries.where(~early))
    return _bigint_rn(_as_doc_id(search_stream.read_results(spark, out)))


# --- files and XML ------------------------------------------------------------------

def xml_text(spark, sf_dir):
    """Each document wrapped as one XML element, then parsed back to text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", standins.as_xml(F.col("text")).alias("xml"))
    parsed = xml_documents(spread(docs), "doc_id", "xml")
    return parsed.select(F.col("doc_key").alias("doc_id"), "text", "status")


def _folder(spark, sf_dir):
    root = scratch_path(spark, "folder")
    files = standins.document_files(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages"))
    standins.write_files(spread(files), root)
    return read_folder(spark, root)


def folder_index(spark, sf_dir):
    """Index a folder of .txt/.md/.xml/.TXT/.xhtml files: term frequencies by file id."""
    extracted = _folder(spark, sf_dir)
    index = ix.build_index(from_table(indexable(extracted), "doc_key", "text"), stem=False)
    return index.postings.select(standins.id_from_path(F.col("doc_key")).alias("doc_id"), "term", "freq")


def skip_accounting(spark, sf_dir):
    """(status, error, files): parser messages are shown by their class."""
    files = _folder(spark, sf_dir)
    return files_skip_accounting(files.withColumn("error", reason_class(F.col("error"))))


def query_rejects(spark, sf_dir):
    """User turns arrive as bytes in ISO-8859-1: bodies that are not valid UTF-8 are
    rejected with a message, the others are searched.  (status, queries)."""
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    # (characters outside Latin-1 become "?" in this stand-in)
    bodies = conv.select(F.struct("conv_id", "turn").alias("query_id"),
                         F.encode(F.col("text"), "ISO-8859-1").alias("body"))
    good, rejects = rk.split_query_bodies(bodies)
    top = rk.search_many(documents_index(spark, sf_dir), good)  # every valid query gets its ranked list
    answered = top.select("query_id").distinct().withColumn("status", F.lit("answered"))
    return (answered.unionByName(rejects.select("query_id", F.lit("rejected").alias("status")))
            .groupBy("status").agg(F.count(F.lit(1)).alias("queries")))


CORE_QUERIES = {
    "tokenize_documents": tokenize_documents,
    "token_kinds": token_kinds,
    "term_freq": term_freq,
    "doc_length": doc_length,
    "doc_freq": doc_freq,
    "corpus_stats": corpus_stats,
    "idf": idf,
    "tfidf_weights": tfidf_weights,
    "search_top20": search_top20,
    "rank_all": rank_all,
    "search_repeated_and_symbols": search_repeated_and_symbols,
    "search_no_match": search_no_match,
    "search_many": search_many,
    "search_many_zero_fill": search_many_zero_fill,
    "search_conversations": search_conversations,
    "search_many_by_documents": search_many_by_documents,
    "search_many_by_terms": search_many_by_terms,
    "search_conversations_by_documents": search_conversations_by_documents,
    "search_scoped": search_scoped,
    "search_result_json": search_result_json,
    "search_result_lines": search_result_lines,
    "html_text": html_text,
    "pages_doc_freq": pages_doc_freq,
    "pages_search": pages_search,
}

MORE_QUERIES = {
    "index_roundtrip_parquet": index_roundtrip_parquet,
    "index_roundtrip_json": index_roundtrip_json,
    "index_roundtrip_json_object": index_roundtrip_json_object,
    "legacy_import": legacy_import,
    "published_index": published_index,
    "search_stored": search_stored,
    "search_many_stored": search_many_stored,
    "add_to_stored_index": add_to_stored_index,
    "replace_in_stored_index": replace_in_stored_index,
    "packed_postings": packed_postings,
    "dense_ids": dense_ids,
    "search_block_max": search_block_max,
    "tiered_index_search": tiered_index_search,
    "tiered_replace": tiered_replace,
    "rank_all_ordered": rank_all_ordered,
    "surrogate_ids": surrogate_ids,
    "merge_doc_freq": merge_doc_freq,
    "replace_document": replace_document,
    "duplicate_keys": duplicate_keys,
    "orphan_postings": orphan_postings,
    "stream_doc_freq": stream_doc_freq,
    "stream_unique_keys": stream_unique_keys,
    "stream_replace": stream_replace,
    "stream_state_doc_freq": stream_state_doc_freq,
    "stream_stemmed_doc_freq": stream_stemmed_doc_freq,
    "stream_search": stream_search,
    "stream_search_refresh": stream_search_refresh,
    "duplicate_postings": duplicate_postings,
    "wrong_terms": wrong_terms,
    "xml_text": xml_text,
    "folder_index": folder_index,
    "skip_accounting": skip_accounting,
    "query_rejects": query_rejects,
    "stem_vocabulary": stem_vocabulary,
    "stem_doc_freq": stem_doc_freq,
    "search_stemmed": search_stemmed,
    "search_many_stemmed": search_many_stemmed,
}

ALL_QUERIES = {**CORE_QUERIES, **MORE_QUERIES}
