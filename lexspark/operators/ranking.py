"""TF-IDF ranking of documents for one query, a table of queries or a stream.

  tf(t, d)  = freq(t, d) / term_count(d)          (0 for an empty document)
  idf(t)    = log10(N / df(t))
  rank(q, d) = sum over the tokens of q, repeats included, of tf * idf

Every document is ranked (zero included); results are ordered by rank
descending, then by document key ascending.  Ranks are compared at
``ORDER_DECIMALS`` so that equal scores tie deterministically whatever the order
of the sum, and shown at ``RANK_DECIMALS``; a document is a hit when its
unrounded rank is above 0.

Plan: queries are analyzed in their rows and pre-aggregated to
``(query_id, term, w)``; they meet ``doc_freq`` first (terms absent from the
corpus and terms in every document, idf = 0, are dropped there), then one of two
exact plans runs.  By terms: the postings of the remaining terms are joined with
the weights, summed per (query, document) with a map-side partial aggregate, and
ranked by a window with a group limit.  By documents: the forward index is scored
where it lies with a local top-k (``operators.scoring``), in blocks of queries.
The second is taken when the first would touch more postings than the index has,
a rule that is the same at every size.  A few literal terms are pushed into the scans as
``bucket IN (..) AND term IN (..)``.  Documents with rank 0 fill short lists from
the k smallest document keys, so no query x document product is ever built.
"""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.analyze import explode_rows, term_counts, token_array
from ..session import materialize
from . import scoring
from .index import Index, term_bucket
from .numbering import in_order
from .sizing import broadcast_if_small
from .stemming import stem_column, stem_term

RANK_DECIMALS = 6
ORDER_DECIMALS = 12
TOP_K = 20
# Distinct query terms up to which scans get literal term filters.
LITERAL_TERMS = 500
PLANS = ("auto", "terms", "documents")


def analyze_queries(queries: DataFrame, key: str | Column = "query_id", text: str = "text",
                    stem: bool = True) -> DataFrame:
    """``(query_id, term, w)``: each distinct query term with its repeat count.

    The same analyzer as for documents; for a stemmed index the distinct words of
    each query are stemmed too.
    """
    k = F.col(key) if isinstance(key, str) else key
    q = queries.select(k.alias("query_id"), token_array(text).alias("__tokens"))
    q = term_counts(q, "__tokens").drop("__tokens")
    qt = (explode_rows(q, "term_counts")
          .select("query_id", F.col("p.term").alias("term"), F.col("p.freq").alias("w")))
    if stem:
        qt = (qt.withColumn("term", stem_column("term"))
              .groupBy("query_id", "term").agg(F.sum("w").alias("w")))
    return qt


def idf_column(n_docs: int, df: Column | str = "df") -> Column:
    d = F.col(df) if isinstance(df, str) else df
    return F.log10(F.lit(float(n_docs)) / d)


def tf_column(freq: Column | str = "freq", term_count: Column | str = "term_count") -> Column:
    f = F.col(freq) if isinstance(freq, str) else freq
    n = F.col(term_count) if isinstance(term_count, str) else term_count
    return F.coalesce(F.try_divide(f.cast("double"), n.cast("double")), F.lit(0.0))


def idf_table(index: Index) -> DataFrame:
    """(term, df, idf) (Q2)."""
    return index.doc_freq.select("term", "df", idf_column(index.n_docs).alias("idf"))


def tfidf_weights(index: Index) -> DataFrame:
    """(doc_key, term, freq, tf, idf, tfidf) for every posting (Q1-Q3).

    A join on ``term``: Spark broadcasts the vocabulary where its finished stage is
    small, and splits the partitions of hot terms otherwise."""
    n = index.n_docs
    p = index.postings.join(index.doc_freq.select("term", idf_column(n).alias("idf")), "term")
    return p.select("doc_key", "term", "freq", tf_column().alias("tf"), "idf",
                    (tf_column() * F.col("idf")).alias("tfidf"))


def _one_row(index: Index) -> DataFrame:
    """A one-row table; expressions of constants over it are folded without a job."""
    return index.documents.sparkSession.createDataFrame(pa.table({"one": [1]}))  # an Arrow table stays local


def pruned(index: Index, terms: list[str] | None) -> Index:
    """The index with its postings and doc_freq limited to the given terms (None: as it is)."""
    if terms is None:
        return index
    keep = F.col("term").isin(terms)
    if index.buckets:
        literals = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
        numbers = sorted(set(_one_row(index).select(
            F.transform(literals, lambda t: term_bucket(t, index.buckets))).collect()[0][0]))
        keep = F.col("bucket").isin(numbers) & keep
    return replace(index, postings=index.postings.where(keep), doc_freq=index.doc_freq.where(keep), _scratch=[])


def weighted_query_terms(index: Index, qterms: DataFrame) -> DataFrame:
    """(query_id, [bucket,] term, df, qw = w * idf) for terms with 0 < idf."""
    n = index.n_docs
    keys = ["term"]
    if index.buckets:
        qterms = qterms.withColumn("bucket", term_bucket("term", index.buckets))
        keys = ["bucket", "term"]
    # w > 0 always holds; stated as a filter it lets dynamic partition pruning
    # use this side to skip doc_freq buckets (it needs a selective predicate)
    joined = index.doc_freq.join(qterms.where(F.col("w") > 0), keys)
    return (joined.where(F.col("df") < F.lit(n))
            .select("query_id", *keys, "df", (F.col("w").cast("double") * idf_column(n)).alias("qw")))


def score(index: Index, qterms: DataFrame | None = None, wq: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_key, rank) for documents with at least one scoring term (Q3, Q4):
    the postings of the query terms joined with the query weights and summed per
    (query, document), not rounded.  ``wq`` is a written table and broadcast if small."""
    if wq is None:
        wq = materialize(weighted_query_terms(index, qterms), "query-weights")
    # qw > 0 always holds after the idf = 0 pruning; see weighted_query_terms
    wq = broadcast_if_small(wq).drop("df").where(F.col("qw") > 0)
    keys = ["bucket", "term"] if index.buckets else ["term"]
    hits = index.postings.join(wq, keys)
    contrib = F.col("qw") * tf_column()
    return hits.groupBy("query_id", "doc_key").agg(F.sum(contrib).alias("rank"))


def top_k_hits(index: Index, qterms: DataFrame, k: int = TOP_K, plan: str = "auto") -> DataFrame:
    """(query_id, rn, doc_key, rank) of the hits, the k best per query.

    ``auto`` scores by documents when the queries would touch more postings by
    terms than the index holds; both plans give the same rows."""
    if plan not in PLANS:
        raise ValueError(f"plan must be one of {PLANS}")
    # the query side is read several times: computed once
    qt = broadcast_if_small(materialize(qterms, "query-terms"))
    names = [r[0] for r in qt.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
    index = pruned(index, names if len(names) <= LITERAL_TERMS else None)
    wq = materialize(weighted_query_terms(index, qt), "query-weights")
    rows, contributions = wq.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    by_documents = index.doc_terms is not None and (
        plan == "documents" or plan == "auto" and contributions > index.n_postings)
    if not by_documents:
        return top_k(score(index, wq=wq), k)
    found = None
    queries = wq.groupBy("query_id").agg(F.collect_list(F.struct("term", "qw")).alias("weights"))
    queries = materialize(queries.withColumn("query_idx", F.monotonically_increasing_id()), "query-rows")
    short, others = scoring.by_length(index.doc_terms, index.n_docs)
    blocks = max(1, -(-rows // scoring.MAX_WEIGHTS))
    for block in range(blocks):
        of_block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        part = scoring.score_top_candidates(short, others, of_block, k)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    return top_k(score(index, wq=wq) if found is None else found, k)


def top_k(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, rn, doc_key, rank): the k best hits per query by rank desc, key asc (Q6-Q8)."""
    w = Window.partitionBy("query_id").orderBy(F.round("rank", ORDER_DECIMALS).desc(), F.col("doc_key").asc())
    return (scores.where(F.col("rank") > 0).withColumn("rn", F.row_number().over(w))
            .where(F.col("rn") <= k)
            .select("query_id", "rn", "doc_key", F.round("rank", RANK_DECIMALS).alias("rank")))


def first_keys(index: Index, k: int = TOP_K) -> list:
    """The k smallest document keys: k rows to the driver.  A stored index keeps
    them (``FIRST_KEYS`` of them), so a search does not scan every key; otherwise
    a top-k over the keys (TakeOrderedAndProject)."""
    if index._first_keys is not None and (k <= len(index._first_keys) or index.n_docs <= len(index._first_keys)):
        return index._first_keys[:k]
    return [r[0] for r in index.documents.select("doc_key").orderBy("doc_key").limit(k).collect()]


# Smallest document keys stored with an index for zero-fill (top-k up to this k).
FIRST_KEYS = 1000


def zero_fill(top: DataFrame, query_ids: DataFrame, fill_keys: list, k: int = TOP_K) -> DataFrame:
    """Complete every query's list to k with rank-0 documents, smallest keys first (Q5).

    Exact because ranks are never negative: at most k - m fillers are needed for m
    hits, and the k smallest keys hold at least that many non-hits.  Hits are
    gathered per query (at most k rows each) and merged inside the row.
    """
    hits = (top.groupBy("query_id")
            .agg(F.array_sort(F.collect_list(F.struct("rn", "doc_key", "rank"))).alias("hits")))
    qids = query_ids.select("query_id").distinct()
    rows = qids.join(hits, "query_id", "left")
    key_type = top.schema["doc_key"].dataType.simpleString()
    fill = F.array(*[F.lit(x) for x in fill_keys]).cast(f"array<{key_type}>") if fill_keys \
        else F.array().cast(f"array<{key_type}>")
    entry = "struct<doc_key:%s,rank:double>" % key_type
    hit_arr = F.coalesce(F.col("hits"), F.array().cast(f"array<struct<rn:int,doc_key:{key_type},rank:double>>"))
    rows = rows.withColumn("__hits", hit_arr)
    fillers = F.filter(fill, lambda key: ~F.exists(F.col("__hits"), lambda h: h["doc_key"] == key))
    merged = F.slice(F.concat(
        F.transform(F.col("__hits"), lambda h: F.struct(h["doc_key"].alias("doc_key"), h["rank"].alias("rank"))).cast(f"array<{entry}>"),
        F.transform(fillers, lambda key: F.struct(key.alias("doc_key"), F.lit(0.0).alias("rank"))).cast(f"array<{entry}>")),
        1, k)
    out = explode_rows(rows.select("query_id", merged.alias("merged")), "merged", "e", "pos")
    return out.select("query_id", (F.col("pos") + 1).alias("rn"), F.col("e.doc_key").alias("doc_key"),
                      F.col("e.rank").alias("rank"))


def search_many(index: Index, queries: DataFrame, key: str | Column = "query_id", text: str = "text",
                k: int = TOP_K, fill: bool = True, fill_keys: list | None = None,
                plan: str = "auto") -> DataFrame:
    """Top k documents per query for a table of queries (Q8):
    (query_id, rn, doc_key, rank)."""
    qterms = analyze_queries(queries, key, text, stem=index.stemmed)
    top = top_k_hits(index, qterms, k, plan)
    if not fill:
        return top
    qids = queries.select((F.col(key) if isinstance(key, str) else key).alias("query_id"))
    return zero_fill(top, qids, fill_keys if fill_keys is not None else first_keys(index, k), k)


def query_terms(index: Index, query: str) -> dict[str, int]:
    """Terms of a literal query with their repeat counts (constants: no job runs)."""
    row = _one_row(index).select(token_array(F.lit(query)).alias("t")).collect()[0]
    counts: dict[str, int] = {}
    for token in row["t"]:
        term = stem_term(token) if index.stemmed else token
        counts[term] = counts.get(term, 0) + 1
    return counts


def score_literal(index: Index, query: str) -> DataFrame | None:
    """(doc_key, rank) of one literal query, None if it has no scoring term: its terms are
    literals in both scans, their weights (a number per term) literals in the sum."""
    counts = query_terms(index, query)
    if not counts:
        return None
    index = pruned(index, sorted(counts))
    n = index.n_docs
    weights = {r["term"]: r["qw"] * counts[r["term"]] for r in index.doc_freq.where(F.col("df") < n).select(
        "term", idf_column(n).alias("qw")).collect()}
    if not weights:
        return None
    qw = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("term"))
    hits = index.postings.where(F.col("term").isin(list(weights)))
    return hits.groupBy("doc_key").agg(F.sum(qw * tf_column()).alias("rank"))


def search(index: Index, query: str, k: int = TOP_K) -> DataFrame:
    """Top k for one free-text query (Q7): (rn, doc_key, rank).  The k rows come to the driver."""
    scores = score_literal(index, query)
    hits = [] if scores is None else [
        (r["doc_key"], r["shown"]) for r in scores.where(F.col("rank") > 0)
        .orderBy(F.round("rank", ORDER_DECIMALS).desc(), "doc_key").limit(k)
        .select("doc_key", F.round("rank", RANK_DECIMALS).alias("shown")).collect()]
    return listed(index, hits, k)


def listed(index: Index, hits: list[tuple], k: int) -> DataFrame:
    """(rn, doc_key, rank) of the ``(key, rank)`` hits, filled up to k with the smallest keys at rank 0.
    Numbers and strings become a local table, whose rows need no job."""
    found = {key for key, _ in hits}
    fill = [] if len(hits) >= k else [(key, 0.0) for key in first_keys(index, k) if key not in found]
    rows = [(n + 1, key, rank) for n, (key, rank) in enumerate((hits + fill)[:k])]
    if rows and (all(isinstance(key, int) for _, key, _ in rows) or all(isinstance(key, str) for _, key, _ in rows)):
        key_type = index.documents.schema["doc_key"].dataType
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.float64())]
        local = index.documents.sparkSession.createDataFrame(pa.table(columns, names=["rn", "doc_key", "rank"]))
        return local.select("rn", F.col("doc_key").cast(key_type).alias("doc_key"), "rank")
    return index.documents.sparkSession.createDataFrame(rows, T.StructType(
        [T.StructField("rn", T.IntegerType()), T.StructField("doc_key", index.documents.schema["doc_key"].dataType),
         T.StructField("rank", T.DoubleType())]))


def rank_all(index: Index, query: str) -> DataFrame:
    """Every document with its rank for one query, zero included (Q5 full form):
    (doc_key, rank).  Sort it with ``orderBy(desc('rank'), 'doc_key')``."""
    scores = score_literal(index, query)
    if scores is None:
        return index.documents.select("doc_key", F.lit(0.0).alias("rank"))
    return (index.documents.select("doc_key").join(scores, "doc_key", "left")
            .select("doc_key", F.round(F.coalesce(F.col("rank"), F.lit(0.0)), RANK_DECIMALS).alias("rank")))


def rank_all_ordered(index: Index, query: str) -> DataFrame:
    """Every document in order (Q5, Q6 full form): (rn, doc_key, rank), by rank descending, then key.  Positions come
    from a range sort and prefix sums over its partitions, never from one window over all rows."""
    scores = score_literal(index, query)
    rows = index.documents.select("doc_key")
    rows = rows.withColumn("rank", F.lit(0.0)) if scores is None else rows.join(scores, "doc_key", "left")
    rows = rows.select("doc_key", F.round(F.coalesce("rank", F.lit(0.0)), ORDER_DECIMALS).alias("order"),
                       F.round(F.coalesce("rank", F.lit(0.0)), RANK_DECIMALS).alias("rank"))
    return in_order(rows, "rn", F.col("order").desc(), F.col("doc_key")).select("rn", "doc_key", "rank")


# Fixed value: the message for a query body that is not UTF-8.
REJECT_MESSAGE = "Body must be a valid UTF-8 string"


def split_query_bodies(bodies: DataFrame, key: str = "query_id", body: str = "body"):
    """(queries, rejects) from raw query bodies (Q10): valid UTF-8 is decoded to
    ``text``; the rest, null bodies included, becomes ``(query_id, message)`` and is not searched."""
    valid = F.coalesce(F.is_valid_utf8(F.col(body)), F.lit(False))
    good = bodies.where(valid).select(F.col(key).alias("query_id"), F.decode(F.col(body), "UTF-8").alias("text"))
    rejects = bodies.where(~valid).select(F.col(key).alias("query_id"), F.lit(REJECT_MESSAGE).alias("message"))
    return good, rejects
