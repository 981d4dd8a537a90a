"""Ranking: FIXTURES.md hand-worked ranks, zero-fill, ties, and a brute-force
check of the stemmed batch search against a pure-Python implementation."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF001, docs_df
from lexspark.operators import index as ix
from lexspark.operators import ranking as rk
from lexspark.operators import scoring


@pytest.fixture(scope="module")
def tiny(spark):
    docs = docs_df(spark, [("d1", "a b a"), ("d2", "b c"), ("d3", "")])
    return ix.build_index(docs, stem=False)


def test_idf(tiny):
    got = {r.term: (r.df, round(r.idf, 6)) for r in rk.idf_table(tiny).collect()}
    assert got == {"a": (1, 0.477121), "b": (2, 0.176091), "c": (1, 0.477121)}
    assert tiny.n_docs == 3


@pytest.mark.parametrize("query,expected", [
    ("a", {"d1": 0.318081, "d2": 0.0, "d3": 0.0}),
    ("b", {"d1": 0.058697, "d2": 0.088046, "d3": 0.0}),
    ("a a b", {"d1": 0.694859, "d2": 0.088046, "d3": 0.0}),
    ("zzz", {"d1": 0.0, "d2": 0.0, "d3": 0.0}),
    ("", {"d1": 0.0, "d2": 0.0, "d3": 0.0}),
])
def test_rank_all(tiny, query, expected):
    got = {r.doc_key: r.rank for r in rk.rank_all(tiny, query).collect()}
    assert got == pytest.approx(expected, abs=1e-6)


def test_top_k_order_and_zero_fill(tiny):
    rows = [tuple(r) for r in rk.search(tiny, "b").collect()]
    assert rows == [(1, "d2", 0.088046), (2, "d1", 0.058697), (3, "d3", 0.0)]
    # fewer documents than k, unknown words only: every document with rank 0, by key
    rows = [tuple(r) for r in rk.search(tiny, "zzz").collect()]
    assert rows == [(1, "d1", 0.0), (2, "d2", 0.0), (3, "d3", 0.0)]


def test_ties_break_on_key(spark):
    docs = docs_df(spark, [("k3", "x y"), ("k1", "x y"), ("k2", "y y"), ("k4", "q")])
    idx = ix.build_index(docs, stem=False)
    rows = [r.doc_key for r in rk.search(idx, "x").collect()]
    assert rows == ["k1", "k3", "k2", "k4"]


def test_term_in_every_document_scores_zero(spark):
    docs = docs_df(spark, [("1", "the cat"), ("2", "the dog")])
    idx = ix.build_index(docs, stem=False)
    got = {r.doc_key: r.rank for r in rk.rank_all(idx, "the").collect()}
    assert got == {"1": 0.0, "2": 0.0}


def test_batch_equals_single(spark, tiny):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a a b"), (4, "")], "query_id int, text string")
    batch = {(r.query_id, r.rn): (r.doc_key, r.rank) for r in rk.search_many(tiny, queries).collect()}
    for qid, text in [(1, "a"), (2, "b"), (3, "a a b"), (4, "")]:
        for r in rk.search(tiny, text).collect():
            assert batch[(qid, r.rn)] == (r.doc_key, r.rank)


# --- brute force (pure Python, independent of the Spark plan) -------------------

def python_tokens(text):
    import regex
    from lexspark.functions.analyze import ASCII_LOWER, ASCII_UPPER
    folded = (text or "").translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))
    return regex.findall(r"\p{N}+|\p{Alphabetic}[\p{Alphabetic}\p{N}]*|[^\p{White_Space}]", folded)


def python_search(docs, queries, stem_words, k=20):
    from lexspark.functions.stem import stem

    def analyze(text):
        out = []
        for t in python_tokens(text):
            out.append(stem(t) if stem_words and t[0].isalpha() else t)
        return out

    tfs = {key: Counter(analyze(text)) for key, text in docs}
    lengths = {key: sum(c.values()) for key, c in tfs.items()}
    df = Counter(t for c in tfs.values() for t in c)
    n = len(tfs)
    result = {}
    for qid, text in queries:
        q = analyze(text)
        ranks = []
        for key, c in tfs.items():
            r = sum(c[t] / lengths[key] * math.log10(n / df[t]) for t in q if df.get(t)) if lengths[key] else 0.0
            ranks.append((round(r, 12), key))
        ranks.sort(key=lambda x: (-x[0], x[1]))
        result[qid] = [(round(r, 6), key) for r, key in ranks[:k]]
    return result


@pytest.mark.parametrize("stem_words", [False, True])
def test_search_many_matches_brute_force(spark, stem_words):
    documents = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text")
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    queries = [(r.item_id, r.text) for r in bench.collect()]
    expected = python_search(docs, queries, stem_words)
    idx = ix.build_index(documents.select(F.col("doc_id").alias("doc_key"), "text"), stem=stem_words)
    got = {}
    for r in rk.search_many(idx, bench.withColumnRenamed("item_id", "query_id")).collect():
        got.setdefault(r.query_id, []).append((r.rn, r.rank, r.doc_key))
    assert set(got) == set(expected)
    mismatches = 0
    for qid, rows in expected.items():
        mine = [(rank, key) for _, rank, key in sorted(got[qid])]
        for (er, ek), (gr, gk) in zip(rows, mine):
            if ek != gk or abs(er - gr) > 1e-6:
                mismatches += 1
        assert len(mine) == len(rows)
    assert mismatches == 0


@pytest.mark.parametrize("stem_words", [False, True])
def test_document_path_equals_term_path(spark, monkeypatch, stem_words):
    """Both exact plans of the batch search give the same rows."""
    documents = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("doc_key"), "text")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    idx = ix.build_index(documents, stem=stem_words)
    by_terms = {tuple(r) for r in rk.search_many(idx, bench, plan="terms").collect()}
    by_docs = {tuple(r) for r in rk.search_many(idx, bench, plan="documents").collect()}
    # several blocks of queries give the rows of one
    monkeypatch.setattr(scoring, "MAX_WEIGHTS", 50)
    assert {tuple(r) for r in rk.search_many(idx, bench, plan="documents").collect()} == by_docs
    assert len(by_terms) == 20 * bench.count()
    assert by_docs == by_terms


def test_result_formats_escape_keys(spark):
    import json

    from lexspark.sinks import results
    docs = docs_df(spark, [('a "quoted" path', "x y"), ("back\\slash", "y"), ("plain", "z")])
    idx = ix.build_index(docs, stem=False)
    q = spark.createDataFrame([(1, "x")], "query_id int, text string")
    top = rk.search_many(idx, q)
    got = json.loads(results.result_json(top).first()["result"])
    assert got[0] == ['a "quoted" path', 0.238561]
    assert [k for k, _ in got] == ['a "quoted" path', "back\\slash", "plain"]
    lines = [r.line for r in results.result_lines(top).orderBy("rn").collect()]
    assert lines[0] == 'a "quoted" path 0.238561'


def test_tiny_ranks_are_hits(spark):
    """A document of many tokens has ranks below the shown decimals; it is still a hit."""
    docs = docs_df(spark, [("long", "needle " + "hay " * 3_000_000), ("other", "straw"), ("third", "hay")])
    idx = ix.build_index(docs, stem=False)
    q = spark.createDataFrame([(1, "needle")], "query_id int, text string")
    for plan in ("terms", "documents"):
        assert [r.doc_key for r in rk.search_many(idx, q, fill=False, plan=plan).collect()] == ["long"]


def test_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(scoring, "CHUNK_CONTRIBUTIONS", 10)
    cost = np.array([3, 3, 3, 3, 40, 0, 0, 0, 5, 6])
    chunks = scoring.chunk_bounds(cost, 3)
    assert sum(n for _, n in chunks) == len(cost) and [f for f, _ in chunks] == list(np.cumsum([0] + [n for _, n in chunks])[:-1])
    assert all(n <= 3 and (n == 1 or cost[f:f + n].sum() <= 10) for f, n in chunks)


def test_common_terms_score_as_the_others(monkeypatch):
    """Dense rows, postings one by one and mixtures of both give the same scores; a query given twice counts twice."""
    rng = np.random.default_rng(3)
    rows = [(q, f"t{t}", 0.1 + t) for q in range(9) for t in range(12) if rng.random() < 0.5] + [(4, "t3", 2.0), (4, "t3", 2.0)]
    w = scoring.pack_weights(rows, {q: q for q in range(9)})
    docs, codes = np.nonzero(rng.random((30, len(w["terms"]))) < 0.6)
    tf = rng.random(len(docs))
    expected = np.zeros((9, 30))
    for q, term, weight in rows:
        of = codes == w["terms"].index(term)
        expected[q, docs[of]] += weight * tf[of]
    for share, common, part in ((0, 256, 10), (2, 256, 10), (10 ** 9, 256, 10), (10 ** 9, 3, 7)):
        monkeypatch.setattr(scoring, "DENSE_SHARE", share)
        monkeypatch.setattr(scoring, "COMMON_TERMS", common)
        monkeypatch.setattr(scoring, "CHUNK_CONTRIBUTIONS", part)
        got = scoring._chunk_scores(docs, codes, tf, w, scoring.common_terms(w), 30)
        assert np.allclose(got, expected, rtol=0, atol=1e-13)


def test_later_chunks_keep_what_reaches_the_best_so_far(monkeypatch):
    w = scoring.pack_weights([(0, "a", 1.0), (1, "b", 2.0)], {0: 0, 1: 1})
    monkeypatch.setattr(scoring, "SLICE_DOCS", 7)
    rng = np.random.default_rng(5)
    freq = rng.integers(1, 50, (100, 2))
    terms = [[{"term": "a", "freq": int(a)}, {"term": "b", "freq": int(b)}, {"term": "z", "freq": 1}] for a, b in freq]
    batch = pa.RecordBatch.from_pydict({"doc_key": list(range(100)), "term_count": [100] * 100, "terms": terms})

    class Sent:
        value = w
    found = [r for out in scoring.local_top_k(Sent, 5)(iter([batch])) for r in out.to_pylist()]
    for q in (0, 1):
        best = np.sort(freq[:, q])[::-1][4]
        assert {r["doc_key"] for r in found if r["query_idx"] == q} == set(np.flatnonzero(freq[:, q] >= best))


def test_null_and_invalid_bodies_are_rejected(spark):
    rows = [(1, b"ok"), (2, b"\xff"), (3, None)]
    good, rejects = rk.split_query_bodies(spark.createDataFrame(rows, "query_id int, body binary"))
    assert [r.query_id for r in good.collect()] == [1]
    assert sorted(r.query_id for r in rejects.collect()) == [2, 3]


def test_auto_plan_compares_with_the_index(spark, monkeypatch):
    documents = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("doc_key"), "text")
    idx = ix.build_index(documents, stem=False)
    used = []
    real = scoring.score_top_candidates
    monkeypatch.setattr(scoring, "score_top_candidates", lambda *a: used.append(1) or real(*a))
    ask = lambda n: spark.range(n).selectExpr("id as query_id", "'the of and de la' as text")
    rk.search_many(idx, ask(1)).collect()
    assert not used
    rk.search_many(idx, ask(2000)).collect()
    assert used
