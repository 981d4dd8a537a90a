"""Packed postings, block-maximum pruning, dense numbers and the tiered store."""

import dataclasses
import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import docs_df
from lexspark.operators import incremental as inc
from lexspark.operators import index as ix
from lexspark.operators import numbering, packed
from lexspark.operators import ranking as rk
from lexspark.session import materialize, scratch_path
from lexspark.sinks import tiered_store as ts

QUERIES = ("the", "the w3 w3 and", "", "rare zzz the")


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(20)]
    texts = [" ".join(rng.choice(["the", "and", "of", *vocabulary]) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    texts[3] += " rare ."
    return [(i * 3, t) for i, t in enumerate(texts)]


def build(spark, rows, key_type="long"):
    return ix.build_index(docs_df(spark, rows, key_type), stem=False, cache=True)


def listing(df):
    return [tuple(r) for r in df.collect()]


def tables(index):
    return ({tuple(r) for r in index.postings.select("doc_key", "term", "freq", "term_count").collect()},
            {tuple(r) for r in index.doc_freq.select("term", "df").collect()},
            {tuple(r) for r in index.documents.select("doc_key", "term_count").collect()}, index.n_docs)


def same_as_full(spark, root, rows, key_type="long"):
    got, want = ts.load(spark, root), build(spark, rows, key_type)
    assert tables(got.as_index()) == tables(want)
    for q in QUERIES:
        assert listing(ts.search(got, q, 12)) == listing(rk.search(want, q, 12)), q
    many = docs_df(spark, [(str(i), q) for i, q in enumerate(QUERIES)]).withColumnRenamed("doc_key", "query_id")
    assert set(listing(rk.search_many(got.as_index(), many, k=12))) == set(listing(rk.search_many(want, many, k=12)))


def jobs_of(spark, action):
    sc, group = spark.sparkContext, f"jobs-{time.time()}"
    sc.setJobGroup(group, "")
    try:
        action()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_numbers_are_dense_and_in_order(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") % 13).alias("a"), F.xxhash64("id").alias("b"))
    got = numbering.in_order(rows, "n", F.col("a").desc(), F.col("b")).collect()
    ordered = sorted(got, key=lambda r: r.n)
    assert [r.n for r in ordered] == list(range(1, 5001))
    assert [(-r.a, r.b) for r in ordered] == sorted((-r.a, r.b) for r in got)
    plan = numbering.placed(rows, F.col("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    ties = numbering.in_order(spark.range(300).select(F.lit(1).alias("a")), "n", F.col("a")).collect()
    assert sorted(r.n for r in ties) == list(range(1, 301))
    assert numbering.in_order(rows.limit(0), "n", F.col("a")).collect() == []


def test_rank_all_ordered(spark):
    index = build(spark, corpus(80))
    for q in ("the w3", "zzz"):
        got = {r.rn: (r.doc_key, r.rank) for r in rk.rank_all_ordered(index, q).collect()}
        assert [(n, *got[n]) for n in sorted(got)] == listing(rk.search(index, q, 80))


def test_blocks_decode_to_the_postings(spark):
    index = build(spark, corpus(150))
    ids = numbering.in_order(index.doc_terms, "doc", F.col("doc_key"))
    postings = packed.postings_by_id(ids)
    for span in (1, 8, 1000):
        blocks = packed.pack(postings, span)
        assert set(listing(packed.unpack(blocks, span))) == set(listing(postings))
        assert blocks.where("n > " + str(span)).count() == 0
        wrong = blocks.where("n <> size(offs) or abs(max_tf - array_max(transform(arrays_zip(freqs, counts), x -> x.freqs / x.counts))) > 0")
        assert wrong.count() == 0


def test_documents_are_packed_like_their_postings(spark):
    index = build(spark, corpus(150) + [(9001, ""), (9002, None)])
    ids = numbering.in_order(index.doc_terms, "doc", F.col("doc_key"))
    as_text = lambda blocks: sorted(str(r) for r in blocks.collect())
    for span in (1, 8, 1000):
        blocks, whole = packed.pack(packed.postings_by_id(ids), span), packed.pack_documents(ids, span)
        assert whole.dtypes == blocks.dtypes and as_text(whole) == as_text(blocks)
    assert "FlatMapGroupsInArrow" in packed.pack_documents(ids, 8)._jdf.queryExecution().executedPlan().toString()


def test_bitmaps_of_removed_documents(spark):
    gone = [0, 1, 63, 64, 65, 129, 200, 1023, 1024]
    docs = spark.createDataFrame([(d,) for d in gone], "doc long")
    for span in (10, 64, 100, 1024):
        bits = packed.removal_bits(docs, span)
        every = spark.range(1500).select(F.col("id").alias("doc"), F.floor(F.col("id") / span).alias("range"))
        found = every.join(bits, "range", "left").where(packed.is_removed(F.col("bits"), F.col("doc") % span))
        assert sorted(r.doc for r in found.collect()) == gone


@pytest.mark.parametrize("policy", ["replace", "ignore"])
def test_additions_equal_a_full_build(spark, policy):
    root = scratch_path(spark, "t-tiered")
    rows = corpus(120)
    want = dict(rows[:60])
    ts.create(build(spark, rows[:60]), root, buckets=3, span=8)
    rng = random.Random(4)
    for n in range(5 if policy == "replace" else 2):
        batch = dict(rows[60 + 12 * n:72 + 12 * n])
        batch.update({k: f"again {n} the w3" for k in rng.sample(sorted(want), 6)})
        ts.append(spark, root, docs_df(spark, list(batch.items()), "long"), policy)
        want = {**want, **batch} if policy == "replace" else {**batch, **want}
    index = ts.load(spark, root)
    assert len(index.segments) < 6 and (index.removed_docs > 0) == (policy == "replace")
    same_as_full(spark, root, list(want.items()))
    assert index._first_keys == sorted(want)
    if policy == "ignore":
        return
    ts.compact(spark, root, everything=True)
    assert len(ts.load(spark, root).segments) == 1 and ts.load(spark, root).removed_docs == 0
    same_as_full(spark, root, list(want.items()))
    newest = ts.published_versions(spark, root)[-1].rsplit("/", 1)[-1]
    left = ts.unused_segments(spark, root, [newest])
    assert left and index.segments[0].name in left and ts.load(spark, root).segments[0].name not in left
    assert tables(ts.load(spark, root, index.version).as_index()) == tables(build(spark, list(want.items())))  # old versions stay


def test_one_word_after_five_additions(spark, monkeypatch):
    root = scratch_path(spark, "t-tiered-jobs")
    rows = corpus(90)
    ts.create(build(spark, rows[:40]), root, buckets=8, span=8)
    for n in range(5):
        more = rows[40 + 10 * n:50 + 10 * n] + [(0, f"the new {n}")]
        ts.append(spark, root, docs_df(spark, more, "long"), "replace")
    index = ts.load(spark, root)
    assert index.removed_docs
    assert jobs_of(spark, lambda: ts.search(index, "the").collect()) <= 6
    plan = ts._weights(index, {"the": 1})[1]._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len(scans) == len(index.segments) and all("bucket#" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans)


def test_common_words_read_few_blocks(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["the"] * (1 + i % 3) + [f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 200))])) for i in range(1200)]
    root = scratch_path(spark, "t-block-max")
    ts.create(build(spark, rows + [(9999, "no such word")]), root, buckets=4, span=16)
    index, full = ts.load(spark, root), build(spark, rows + [(9999, "no such word")])
    for q in ("the", "the w1", "the w1 w2 the"):
        weights, blocks = ts._weights(index, rk.query_terms(index, q))
        one = len(weights) == 1
        limit = ts.lower_limit(index, blocks, one, 10)
        read, every = (b.select("segment", "range").distinct().count() for b in (ts.able_blocks(index, blocks, one, limit), blocks))
        assert read * 3 < every, (q, read, every)
        assert listing(ts.search(index, q, 10)) == listing(rk.search(full, q, 10))


def test_more_ties_than_literals_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(ts, "LITERALS", 5)
    rows = [(i, "same words the") for i in range(200)] + [(500, "other"), (501, "the the the w"), (502, "")]
    root = scratch_path(spark, "t-ties")
    ts.create(build(spark, rows), root, buckets=2, span=4)
    same_as_full(spark, root, rows)


def test_keys_policies_and_odd_tables(spark):
    root = scratch_path(spark, "t-tiered-odd")
    base = [("b", "x y"), ("a", ""), ("c", "x")]
    ts.create(build(spark, base, "string"), root, buckets=2)
    with pytest.raises(ValueError, match="already indexed"):
        ts.append(spark, root, docs_df(spark, [("a", "new")]))
    with pytest.raises(ValueError, match="duplicate"):
        ts.append(spark, root, docs_df(spark, [("d", "new"), ("d", "newer")]), "replace")
    ts.append(spark, root, docs_df(spark, []), "replace")
    same_as_full(spark, root, base, "string")
    ts.append(spark, root, docs_df(spark, [("a", "x x the"), ("é", "")]), "replace")
    same_as_full(spark, root, [("b", "x y"), ("a", "x x the"), ("c", "x"), ("é", "")], "string")
    empty = scratch_path(spark, "t-tiered-empty")
    ts.create(build(spark, [], "string"), empty, buckets=2)
    assert listing(ts.search(ts.load(spark, empty), "x")) == []
    ts.append(spark, empty, docs_df(spark, base))
    same_as_full(spark, empty, base, "string")


def test_smallest_keys_stay_certain(monkeypatch):
    monkeypatch.setattr(ts, "FIRST_KEYS", 4)
    merged = ts._merged_first_keys
    assert merged([1, 2, 3], True, set(), [0, 9], True) == ([0, 1, 2, 3], False)
    assert merged([1, 2, 3, 4], False, {2}, [0, 2, 9], True) == ([0, 1, 2, 3], False)
    assert merged([1, 2, 3, 4], False, set(), [5, 6, 7, 8], False) == ([1, 2, 3, 4], False)
    assert merged([1, 9, 10, 11], False, {1, 9}, [2, 3, 4, 5], False) == ([2, 3, 4, 5], False)
    assert merged([5, 6], True, set(), [1], True) == ([1, 5, 6], True)


def test_pins_keep_versions_and_the_rest_goes(spark):
    root = scratch_path(spark, "t-pins")
    rows = corpus(40)
    ts.create(build(spark, rows[:10]), root, buckets=2, span=8)
    latest = ts.Latest(spark, root, "reader")
    first = latest()
    assert latest() is first and first.n_docs == 10
    held = ts.published_versions(spark, root)[0].rsplit("/", 1)[-1]
    for n in range(1, 4):
        ts.append(spark, root, docs_df(spark, rows[10 * n:10 * n + 10], "long"))
    ts.compact(spark, root, everything=True)
    gone = ts.remove_unused(spark, root)
    left = [v.rsplit("/", 1)[-1] for v in ts.published_versions(spark, root)]
    assert gone and held in left and len(left) == 2
    assert tables(first) == tables(build(spark, rows[:10]))  # what the reader holds is whole
    same_as_full(spark, root, rows)
    assert latest().n_docs == 40  # moves on, and with it the pin
    ts.remove_unused(spark, root)
    assert len(ts.published_versions(spark, root)) == 1
    same_as_full(spark, root, rows)
    ts.unpin(spark, root, "reader")
    assert ts.pinned(spark, root) == set() and ts.remove_unused(spark, root) == []


def test_a_damaged_index_is_noticed(spark):
    root = scratch_path(spark, "t-damaged")
    rows = corpus(20)
    ts.create(build(spark, rows), root, buckets=2, span=8)
    ts.load(spark, root, verify=True)
    index = build(spark, rows)
    inc.assert_consistent(index)
    twice = dataclasses.replace(index, postings=index.postings.unionByName(index.postings.where("doc_key = 3")), _scratch=[])
    with pytest.raises(ValueError, match="repeated posting"):
        inc.assert_consistent(twice)
    for wrong, what in ((dataclasses.replace(index, doc_freq=index.doc_freq.unionByName(index.doc_freq.where("term = 'the'")), _scratch=[]), "frequency"),
                        (dataclasses.replace(index, doc_freq=index.doc_freq.where("term <> 'w3'"), _scratch=[]), "frequency"),
                        (dataclasses.replace(index, documents=index.documents.where("doc_key <> 6"), _scratch=[]), "without a document")):
        with pytest.raises(ValueError, match=what):
            inc.assert_consistent(wrong)
    segment = ts.load(spark, root).segments[0].name  # a segment whose blocks were written twice
    path = f"{root}/segments/{segment}/postings"
    copy = materialize(spark.read.parquet(path), "t-copy")
    copy.write.mode("append").partitionBy("bucket").parquet(path)
    with pytest.raises(ValueError, match="repeated posting"):
        ts.load(spark, root, verify=True)
