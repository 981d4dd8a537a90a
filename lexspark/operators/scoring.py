"""Batch scoring by documents with a local top-k per task.

Exhaustive TF-IDF over common terms makes (query, document) contributions
grow as ``sum over terms of df(t) x queries(t)``; shuffling them into a
``(query, doc)`` aggregate is the cost that dominates large query batches.
Here the forward index ``doc_terms`` (one row per document with its terms) is
scanned where it lies, each task accumulates the scores of its own documents
for all queries (numpy, Arrow batches), and keeps only each query's best k
documents.  Only those rows are shuffled to the final per-query top-k window,
so the shuffle is at most about ``k x queries x tasks`` rows, whatever the
corpus size.

Exactness: ranks are compared after rounding to ``ORDER_DECIMALS`` with the
document key as tie-break.  Rounding is monotonic, so every document of the
task's rounded top-k has an unrounded score of at least the k-th best score of
any subset of the task's documents minus one rounding step.  Each pruning
(per chunk, then of the running candidates) keeps everything above that bound,
a superset; Spark rounds and ranks the survivors.

The query weights reach the tasks as a broadcast of about ``MAX_WEIGHTS`` rows;
callers cut larger batches into blocks of queries, one pass over the forward
index each.  A chunk of documents is bounded in score cells and in contributions; terms that most of its documents
and many queries hold are multiplied as dense matrices, and only scores that reach a query's k-th best so far are kept.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import materialize

# Rows of (query, term, weight) shipped to the tasks at most.
MAX_WEIGHTS = 1_000_000
# Cells of the dense (queries x documents) score block of one chunk.
DENSE_CELLS = 4_000_000
# (query, document, term) contributions of one chunk, unless one document has more.
CHUNK_CONTRIBUTIONS = 2_000_000
# Terms held by most queries that may be scored as dense rows, and the number of cells per contribution up to which
# a dense row is the cheaper way.
COMMON_TERMS = 256
DENSE_SHARE = 100
# Documents of an Arrow batch that are decoded at a time.
SLICE_DOCS = 1024
# Documents that are bounded together, and clusters and rounds of the k-means that brings like ones together.
BOUND_DOCS = 16
CLUSTERS = 32
CLUSTER_ROUNDS = 3
# Postings of query terms whose documents are put in order together.
GROUP_POSTINGS = 1_500_000
# Queries that are scored with a chunk at a time.
SCORED_QUERIES = 1024
# New candidates of a task that are kept before the first pruning.
PENDING = 200_000
# Below any score, above 0.
TINY = 1e-30
# The shortest documents are scored first: this part of all, in bounds, by so many tasks.
PROBE_PART = 25
PROBE_LEAST, PROBE_MOST = 1_000, 20_000
PROBE_TASKS = 6
# Unrounded scores within this distance of the k-th best are kept.
MARGIN = 2e-12


def pack_weights(rows: list, key_index: dict) -> dict:
    """CSR layout of the query weights grouped by term."""
    rows = sorted(rows, key=lambda r: r[1])
    terms, offsets, qidx, qw = [], [0], [], []
    for qid, term, weight in rows:
        if not terms or terms[-1] != term:
            if terms:
                offsets.append(len(qidx))
            terms.append(term)
        qidx.append(key_index[qid])
        qw.append(weight)
    offsets.append(len(qidx))
    return {"terms": terms, "offsets": np.asarray(offsets, dtype=np.int64),
            "qidx": np.asarray(qidx, dtype=np.int64), "qw": np.asarray(qw, dtype=np.float64),
            "nq": len(key_index), "numbers": np.arange(len(key_index))}


def common_terms(w: dict, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """(place, weights): the row of each term in the dense ``weights`` (terms x queries) of the terms that most
    queries hold, -1 for the others."""
    held = np.diff(w["offsets"])
    common = np.sort(np.argsort(-held, kind="stable")[:COMMON_TERMS])
    place = np.full(len(held), -1, np.int64)
    place[common] = np.arange(len(common))
    dense = np.zeros((len(common), w["nq"]), kind)
    for row, code in enumerate(common):
        lo, hi = w["offsets"][code], w["offsets"][code + 1]
        np.add.at(dense[row], w["qidx"][lo:hi], w["qw"][lo:hi])  # a query given twice counts twice
    return place, dense


def _chunk_scores(doc_rows, codes, tf, w, common, nd):
    """(queries x documents) scores of one chunk, None if no term meets a query.  Terms that many of its documents and
    many queries hold are summed as a product of dense matrices, the others posting by posting."""
    offsets, qidx, qw, nq = w["offsets"], w["qidx"], w["qw"], w["nq"]
    place, weights = common
    cnt = offsets[codes + 1] - offsets[codes]
    if int(cnt.sum()) == 0:
        return None
    rows = place[codes]
    here = np.bincount(rows[rows >= 0], weights=cnt[rows >= 0], minlength=len(weights))
    dense = np.flatnonzero(here * DENSE_SHARE >= nq * nd)
    scores = np.zeros((nq, nd))
    if len(dense):
        line = np.full(len(weights) + 1, -1, np.int64)  # the last one is for the terms that are not common
        line[dense] = np.arange(len(dense))
        of = line[rows]
        part = of >= 0
        freqs = np.zeros((len(dense), nd))
        np.add.at(freqs, (of[part], doc_rows[part]), tf[part])
        np.matmul(weights[dense].T, freqs, out=scores)
        doc_rows, codes, tf, cnt = doc_rows[~part], codes[~part], tf[~part], cnt[~part]
    ends = np.cumsum(cnt)
    for lo, n in chunk_bounds(cnt, len(cnt)):  # parts of bounded size, as a chunk may hold many contributions
        c = cnt[lo:lo + n]
        total = int(c.sum())
        pos = np.repeat(offsets[codes[lo:lo + n]] - (ends[lo:lo + n] - ends[lo] + c[0] - c), c) + np.arange(total)
        cells = qidx[pos] * nd + np.repeat(doc_rows[lo:lo + n], c)
        np.add.at(scores.reshape(-1), cells, qw[pos] * np.repeat(tf[lo:lo + n], c))
    return scores


def _chunk_top_k(doc_rows, codes, tf, w, common, k, nd, least):
    """(query_idx, doc_row, score) of the documents of one chunk that may be among the best of a query.  ``least``: the
    k-th best score so far of each query, None at first."""
    scores = _chunk_scores(doc_rows, codes, tf, w, common, nd)
    if scores is None:
        return None
    if least is None and nd > k:
        least = np.partition(scores, nd - k, axis=1)[:, nd - k]
    keep = scores > 0
    if least is not None:
        keep &= scores >= (least - MARGIN)[:, None]
    qi, di = np.nonzero(keep)
    return qi, di, scores[qi, di]


def kth_best(q: np.ndarray, s: np.ndarray, k: int, nq: int) -> np.ndarray:
    """The k-th best score of each query, 0 where it has fewer than k."""
    order = np.lexsort((-s, q))
    first = np.searchsorted(q[order], np.arange(nq + 1))
    full = np.diff(first) >= k
    out = np.zeros(nq)
    out[full] = s[order][first[:-1][full] + k - 1]
    return out


def prune_top_k(q: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Indices of the rows to keep: per query, every score within ``MARGIN`` of
    the query's k-th best (vectorized: one sort by query, then score)."""
    if len(q) == 0:
        return np.arange(0)
    order = np.lexsort((-s, q))
    qs, ss = q[order], s[order]
    starts = np.flatnonzero(np.r_[True, qs[1:] != qs[:-1]])
    sizes = np.diff(np.r_[starts, len(qs)])
    kth = np.where(sizes >= k, ss[starts + np.minimum(sizes, k) - 1], -np.inf)
    group = np.repeat(np.arange(len(starts)), sizes)
    return order[ss >= kth[group] - MARGIN]


def chunk_bounds(per_doc: np.ndarray, chunk_docs: int) -> list[tuple[int, int]]:
    """(first document, documents) of consecutive chunks: at most ``chunk_docs`` documents and, where
    there are several, ``CHUNK_CONTRIBUTIONS`` contributions."""
    total = np.concatenate([[0.0], np.cumsum(per_doc)])
    out, first, n = [], 0, len(per_doc)
    while first < n:
        fits = int(np.searchsorted(total, total[first] + CHUNK_CONTRIBUTIONS, side="right")) - 1 - first
        nd = max(1, min(chunk_docs, fits, n - first))
        out.append((first, nd))
        first += nd
    return out


def coded_slices(batches: Iterator, vocab) -> Iterator[tuple]:
    """(keys, documents, rows, codes, tf, term counts) of the batches of a forward index, a slice of documents at a
    time: the postings of the terms of ``vocab``, in the order of the documents."""
    for batch in (batch.slice(at, SLICE_DOCS) for batch in batches for at in range(0, batch.num_rows, SLICE_DOCS)):
        n = batch.num_rows
        term_count = batch.column("term_count").to_numpy(zero_copy_only=False).astype(np.float64)
        lists = batch.column("terms")
        parents = np.repeat(np.arange(n), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        flat = pc.list_flatten(lists)
        codes_all = pc.index_in(flat.field("term"), value_set=vocab)
        valid = np.asarray(codes_all.is_valid())
        if not valid.any():
            continue
        codes = np.asarray(codes_all.filter(pa.array(valid))).astype(np.int64)
        freq = np.asarray(flat.field("freq").filter(pa.array(valid))).astype(np.float64)
        rows = parents[valid]
        yield batch.column("doc_key"), n, rows, codes, freq / term_count[rows], term_count


class Best:
    """The running candidates of a task: what may be among the k best of a query.  They are pruned when as many again
    have come in, so that no chunk costs a sort of all of them."""

    def __init__(self, k: int, nq: int, least: np.ndarray | None):
        self.k, self.nq, self.least = k, nq, least  # least: the k-th best score so far of each query, None at first
        self.q, self.s, self.keys = np.arange(0, dtype=np.int64), np.arange(0, dtype=np.float64), None
        self.came: list[tuple] = []
        self.rows = 0

    def add(self, q: np.ndarray, s: np.ndarray, keys) -> None:
        if len(q):
            self.came.append((q.astype(np.int64), s, keys))
            self.rows += len(q)
        if self.least is None or self.rows > max(len(self.q), PENDING):
            self.prune()

    def prune(self) -> None:
        if self.came:
            q = np.concatenate([self.q, *(c[0] for c in self.came)])
            s = np.concatenate([self.s, *(c[1] for c in self.came)])
            keys = pa.concat_arrays([c[2] for c in self.came] if self.keys is None else [self.keys, *(c[2] for c in self.came)])
            idx = prune_top_k(q, s, self.k)
            self.q, self.s, self.keys = q[idx], s[idx], keys.take(pa.array(idx))
            self.came, self.rows = [], 0
        kth = kth_best(self.q, self.s, self.k, self.nq)
        self.least = kth if self.least is None else np.maximum(self.least, kth)

    def batches(self, numbers: np.ndarray) -> Iterator:
        self.prune()
        if self.keys is not None:
            keep = np.flatnonzero(self.s >= self.least[self.q] - MARGIN)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[self.q[keep]]), self.keys.take(pa.array(keep)), pa.array(self.s[keep])],
                names=["query_idx", "doc_key", "score"])


def local_top_k(weights_bc, k: int):
    """The ``mapInArrow`` function over ``doc_terms`` batches: one running top-k
    per query for the whole task, emitted once at its end."""

    def run(batches: Iterator) -> Iterator:
        w = weights_bc.value
        nq = max(w["nq"], 1)
        common, best = common_terms(w), Best(k, nq, None)
        chunk_docs = max(1, DENSE_CELLS // nq)
        for keys, n, rows, codes, tf, _ in coded_slices(batches, pa.array(w["terms"], type=pa.string())):
            # rows arrive in document order, so chunks are contiguous slices
            for first in range(0, n, chunk_docs):
                nd = min(chunk_docs, n - first)
                lo, hi = np.searchsorted(rows, [first, first + nd])
                if lo == hi:
                    continue
                res = _chunk_top_k(rows[lo:hi] - first, codes[lo:hi], tf[lo:hi], w, common, k, nd, best.least)
                if res is not None:
                    qi, di, sc = res
                    best.add(qi, sc, keys.take(pa.array(di + first)))
        yield from best.batches(w["numbers"])

    return run


class Queries:
    """The weights of a block by query: (offsets, codes, weights) of all terms and of the rare ones, and the common ones
    as dense rows (queries x common terms) of 4-byte floats."""

    def __init__(self, w: dict):
        place, dense = common_terms(w, np.float32)
        self.place, self.dense = place, np.ascontiguousarray(dense.T)
        order = np.argsort(w["qidx"], kind="stable")
        codes = np.repeat(np.arange(len(w["terms"])), np.diff(w["offsets"]))[order]
        qidx, qw = w["qidx"][order], w["qw"][order]
        ends = lambda q: np.r_[0, np.cumsum(np.bincount(q, minlength=w["nq"]))]
        self.all = ends(qidx), codes, qw
        rare = place[codes] < 0
        self.rare = ends(qidx[rare]), codes[rare], qw[rare].astype(np.float32)
        self.by_term = w["offsets"], w["qidx"], w["qw"].astype(np.float32)
        # sums of 4-byte floats: the error of each term and of each sum is below 2 ** -23 of the whole
        self.slack = 1 - (np.diff(self.all[0]) + 8) * 2.0 ** -22


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] of them), first[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def alike(rows: np.ndarray, codes: np.ndarray, tf: np.ndarray, place: np.ndarray, n_common: int, term_count: np.ndarray) -> np.ndarray:
    """An order of documents in which those with like frequencies of the common terms and like lengths are neighbours
    (a few rounds of k-means): the maxima of a chunk are then close to its documents.  Any order gives the same rows."""
    n = len(term_count)
    flat = np.zeros((n, max(n_common, 1)), np.float32)
    at = place[codes]
    flat[rows[at >= 0], at[at >= 0]] = np.sqrt(tf[at >= 0])
    centres = flat[np.random.default_rng(0).choice(n, min(n, CLUSTERS), replace=False)]
    for _ in range(CLUSTER_ROUNDS):
        nearest = np.argmax(flat @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)
        for c in range(len(centres)):
            of = nearest == c
            if of.any():
                centres[c] = flat[of].mean(0)
    return np.lexsort((term_count, nearest))


def reaching(weights_bc, k: int):
    """The ``mapInArrow`` function over ``doc_terms`` batches that finds the documents which reach ``least``, the k-th
    best score of each query among other documents.

    A chunk of ``BOUND_DOCS`` documents is bounded first: a query weighs the greatest frequency of each of its terms in the
    chunk.  Only queries whose bound reaches their k-th best score so far are scored with the documents of the chunk."""

    def run(batches: Iterator) -> Iterator:
        w = weights_bc.value
        best, queries = Best(k, max(w["nq"], 1), w["least"]), Queries(w)
        group, size = [], 0
        for part in coded_slices(batches, pa.array(w["terms"], type=pa.string())):
            group.append(part)
            size += len(part[3])
            if size >= GROUP_POSTINGS:
                _group_reaching(group, queries, best)
                group, size = [], 0
        if group:
            _group_reaching(group, queries, best)
        yield from best.batches(w["numbers"])

    return run


def _group_reaching(group: list, queries: Queries, best: Best) -> None:
    """Adds the documents of a group of slices that reach the k-th best score of a query to ``best``."""
    place, dense = queries.place, queries.dense
    base = np.cumsum([0] + [g[1] for g in group])
    keys = pa.concat_arrays([g[0] for g in group])
    rows = np.concatenate([g[2] + b for g, b in zip(group, base)])
    codes, tf, term_count = (np.concatenate([g[i] for g in group]) for i in (3, 4, 5))
    order = alike(rows, codes, tf, place, dense.shape[1], term_count)
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    at = at[rows]  # the place of each posting's document in that order
    sort = np.argsort(at // BOUND_DOCS * len(place) + codes)
    codes, tf, at = codes[sort], tf[sort], at[sort]
    chunk = at // BOUND_DOCS
    first = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (codes[1:] != codes[:-1])])
    of_chunk, of_code, most = chunk[first], codes[first], np.maximum.reduceat(tf, first).astype(np.float32)
    ends = np.r_[first, len(tf)]  # of the postings of each (chunk, term)
    n_chunks, line = int(of_chunk[-1]) + 1, np.full(len(place), -1, np.int64)
    step = max(1, DENSE_CELLS // max(len(dense), 1))
    for lo in range(0, n_chunks, step):
        n = min(step, n_chunks - lo)
        terms = np.searchsorted(of_chunk, np.arange(lo, lo + n + 1))
        a, b = terms[0], terms[-1]
        bound = _bounds(of_chunk[a:b] - lo, of_code[a:b], most[a:b], n, queries)
        for c in range(n):
            floor = np.maximum((best.least - MARGIN) * queries.slack, TINY).astype(np.float32) if c % 64 == 0 else floor
            found = np.flatnonzero(bound[c] >= floor)
            if not len(found):
                continue
            t0, t1, begin = terms[c], terms[c + 1], (lo + c) * BOUND_DOCS
            freqs = np.zeros((t1 - t0, BOUND_DOCS), np.float32)
            in_chunk = slice(ends[t0], ends[t1])
            freqs[np.repeat(np.arange(t1 - t0), np.diff(ends[t0:t1 + 1])), at[in_chunk] - begin] = tf[in_chunk]
            line[of_code[t0:t1]] = np.arange(t1 - t0)
            seen = place[of_code[t0:t1]]
            common = np.zeros((dense.shape[1], BOUND_DOCS), np.float32)
            common[seen[seen >= 0]] = freqs[seen >= 0]
            for q0 in range(0, len(found), SCORED_QUERIES):
                qs = found[q0:q0 + SCORED_QUERIES]
                near = np.matmul(dense[qs], common)
                _add_rare(near, qs, queries.rare, line, freqs)
                qi, di = np.nonzero(near >= floor[qs][:, None])
                if len(qi):
                    s = _exact(qs[qi], di, queries.all, line, ends[t0:t1 + 1], at, tf, begin)
                    keep = np.flatnonzero(s >= best.least[qs[qi]] - MARGIN)
                    best.add(qs[qi[keep]], s[keep], keys.take(pa.array(order[begin + di[keep]])))
            line[of_code[t0:t1]] = -1
    best.prune()


def _bounds(chunks: np.ndarray, codes: np.ndarray, most: np.ndarray, n: int, queries: Queries) -> np.ndarray:
    """(chunks x queries) sums of the weights of a query times the greatest frequencies in a chunk."""
    offsets, qidx, qw = queries.by_term
    rows = queries.place[codes]
    part = rows >= 0
    freqs = np.zeros((n, queries.dense.shape[1]), np.float32)
    freqs[chunks[part], rows[part]] = most[part]
    bound = np.matmul(freqs, queries.dense.T)
    chunks, codes, most = chunks[~part], codes[~part], most[~part]
    cnt = offsets[codes + 1] - offsets[codes]
    flat = bound.reshape(-1)
    for lo, m in chunk_bounds(cnt, len(cnt)):
        c = cnt[lo:lo + m]
        pos = ranges(offsets[codes[lo:lo + m]], c)
        np.add.at(flat, np.repeat(chunks[lo:lo + m] * bound.shape[1], c) + qidx[pos], np.repeat(most[lo:lo + m], c) * qw[pos])
    return bound


def _add_rare(scores: np.ndarray, qs: np.ndarray, rare: tuple, line: np.ndarray, freqs: np.ndarray) -> None:
    """Adds the rare terms of the queries ``qs`` to their scores (queries x documents of a chunk)."""
    offsets, codes, qw = rare
    sizes = offsets[qs + 1] - offsets[qs]
    pos = ranges(offsets[qs], sizes)
    at = line[codes[pos]]
    here = np.flatnonzero(at >= 0)
    if len(here):
        of = np.repeat(np.arange(len(qs)), sizes)[here]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        scores[of[starts]] += np.add.reduceat(freqs[at[here]] * qw[pos[here]][:, None], starts, axis=0)


def _exact(qs: np.ndarray, docs: np.ndarray, weights: tuple, line: np.ndarray, ends: np.ndarray, at: np.ndarray, tf: np.ndarray,
           begin: int) -> np.ndarray:
    """The scores of pairs of a query and a document of a chunk, in 8-byte floats."""
    offsets, codes, qw = weights
    freqs = np.zeros((len(ends) - 1, BOUND_DOCS))
    freqs[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), at[ends[0]:ends[-1]] - begin] = tf[ends[0]:ends[-1]]
    sizes = offsets[qs + 1] - offsets[qs]
    pos = ranges(offsets[qs], sizes)
    row = line[codes[pos]]
    here = np.flatnonzero(row >= 0)
    of = np.repeat(np.arange(len(qs)), sizes)[here]
    return np.bincount(of, weights=freqs[row[here], docs[of]] * qw[pos[here]], minlength=len(qs))


def by_length(doc_terms: DataFrame, n_docs: int) -> tuple[DataFrame, DataFrame | None]:
    """(short, others): the shortest documents, which have the greatest frequencies and so the best scores of most queries,
    and the rest; None if there are too few documents to tell apart.  Where very many are of the same length, a part of
    them by hash."""
    probe = min(max(n_docs // PROBE_PART, PROBE_LEAST), PROBE_MOST)
    if n_docs <= 2 * probe:
        return doc_terms, None
    lengths = doc_terms.select("term_count").where(F.col("term_count") > 0)
    longest = lengths.agg(F.percentile_approx("term_count", probe / n_docs)).first()[0]
    short = F.coalesce(F.col("term_count") <= F.lit(longest), F.lit(False))
    found = doc_terms.where(short).count()
    if found > 2 * probe:
        short &= F.pmod(F.xxhash64("doc_key"), F.lit(1 << 20)) < int(probe / found * (1 << 20))
    return materialize(doc_terms.where(short), "short-documents").coalesce(PROBE_TASKS), doc_terms.where(~short)


def pack_queries(queries: pa.Table) -> dict:
    """``pack_weights`` of a table (query_idx, weights ARRAY<STRUCT<term, qw>>); ``numbers`` are its query_idx."""
    queries = queries.sort_by("query_idx").combine_chunks()
    lists = queries.column("weights")
    flat = pc.list_flatten(lists).combine_chunks()
    names = flat.field("term").dictionary_encode()
    codes = names.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    qidx = np.repeat(np.arange(len(queries)), pc.list_value_length(lists).to_numpy())
    return {"terms": names.dictionary.to_pylist(), "offsets": np.r_[0, np.cumsum(np.bincount(codes))].astype(np.int64),
            "qidx": qidx[order].astype(np.int64), "qw": flat.field("qw").to_numpy()[order], "nq": len(queries),
            "numbers": queries.column("query_idx").to_numpy()}


def score_top_candidates(short: DataFrame, others: DataFrame | None, queries: DataFrame, k: int) -> DataFrame | None:
    """(query_id, doc_key, rank) holding every query's top k (and near ties), written as a
    table so that the weights leave the executors; None without queries.

    ``queries``: the rows (query_idx, query_id, weights ARRAY<STRUCT<term, qw>>) of a block.  All are scored with the
    ``short`` documents first; with the ``others`` only those that can reach their k-th best of these."""
    spark = short.sparkSession
    w = pack_queries(queries.select("query_idx", "weights").toArrow())
    if not w["nq"]:
        return None
    key_type = short.schema["doc_key"].dataType
    out_schema = T.StructType([T.StructField("query_idx", T.LongType()),
                               T.StructField("doc_key", key_type),
                               T.StructField("score", T.DoubleType())])

    def found(documents: DataFrame, kernel, weights: dict) -> DataFrame:
        sent = spark.sparkContext.broadcast(weights)
        rows = materialize(documents.select("doc_key", "term_count", "terms").mapInArrow(kernel(sent, k), out_schema),
                           "query-candidates")
        sent.unpersist()
        return rows

    local = found(short, local_top_k, w)
    if others is not None:
        best = Window.partitionBy("query_idx").orderBy(F.desc("score"))
        kth = local.withColumn("rn", F.row_number().over(best)).where(F.col("rn") == k)
        kth = materialize(kth.select("query_idx", F.col("score").alias("least")), "query-least")
        rows = kth.toArrow()
        least = np.zeros(w["nq"])
        least[np.searchsorted(w["numbers"], rows.column("query_idx").to_numpy())] = rows.column("least").to_numpy()
        reached = found(others, reaching, {**w, "least": least})
        local = (local.join(F.broadcast(kth), "query_idx", "left")  # a number for each query of the block
                 .where(F.col("least").isNull() | (F.col("score") >= F.col("least") - MARGIN)).drop("least").unionByName(reached))
    ids = queries.select("query_idx", "query_id")
    return local.join(F.broadcast(ids), "query_idx").select("query_id", "doc_key", F.col("score").alias("rank"))
