"""Streams equal batch: indexing (with unique keys across batches) and search."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from lexspark.operators import index as ix
from lexspark.operators import ranking as rk
from lexspark.session import scratch_path
from lexspark.streaming import index_stream, search_stream


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "source")


def test_stream_index_equals_batch_and_keys_unique(spark, docs):
    src = scratch_path(spark, "t-stream-src")
    docs.select("doc_id", "text").repartitionByRange(3, "doc_id").write.parquet(f"{src}/a")
    docs.where(F.col("source") == "src3").select("doc_id", "text").coalesce(1).write.parquet(f"{src}/b")
    stream = (spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src)
              .select(F.col("doc_id").alias("doc_key"), "text"))
    out = scratch_path(spark, "t-stream-out")
    q = index_stream.index_stream(stream, out, scratch_path(spark, "t-stream-ckpt"), stem=False)
    q.awaitTermination()
    streamed = index_stream.read_stream_index(spark, out, stemmed=False)
    assert streamed.documents.count() == docs.count()
    assert spark.read.parquet(f"{out}/documents").select("batch_id").distinct().count() >= 3
    batch = ix.build_index(docs.select(F.col("doc_id").alias("doc_key"), "text"), stem=False)
    got = {tuple(r) for r in streamed.doc_freq.collect()}
    assert got == {tuple(r) for r in batch.doc_freq.select("term", "df").collect()}


def test_stream_search_equals_batch(spark, docs):
    index = ix.build_index(docs.select(F.col("doc_id").alias("doc_key"), "text"), stem=True)
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    src = scratch_path(spark, "t-q-src")
    bench.repartitionByRange(3, "query_id").write.parquet(src)
    stream = spark.readStream.schema("query_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(src)
    out = scratch_path(spark, "t-q-out")
    q = search_stream.search_stream(index, stream, out, scratch_path(spark, "t-q-ckpt"))
    q.awaitTermination()
    got = {tuple(r) for r in search_stream.read_results(spark, out).collect()}
    want = {tuple(r) for r in rk.search_many(index, bench).collect()}
    assert got == want


def test_batch_retry_is_idempotent(spark):
    """A micro-batch run twice (retry after a failure) leaves the same output."""
    from conftest import docs_df
    out = scratch_path(spark, "t-retry")
    first = docs_df(spark, [("a", "x y"), ("b", "y z")])
    index_stream.index_batch(first, 0, out)
    second = docs_df(spark, [("b", "y z"), ("c", "z z")])
    index_stream.index_batch(second, 1, out)
    index_stream.index_batch(second, 1, out)  # replayed
    idx = index_stream.read_stream_index(spark, out)
    assert sorted(r.doc_key for r in idx.documents.collect()) == ["a", "b", "c"]
    assert {tuple(r) for r in idx.doc_freq.collect()} == {("x", 1), ("y", 2), ("z", 2)}


def test_half_written_batch_is_not_read_and_scratch_goes(spark):
    from conftest import docs_df
    from lexspark.session import checkpoint_dir
    out = scratch_path(spark, "t-half")
    index_stream.index_batch(docs_df(spark, [("a", "running x"), ("b", "y")]), 0, out)
    index_stream.index_batch(docs_df(spark, [("c", "z")]), 1, out)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/complete/batch_id=1")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(p, True)
    half = index_stream.read_stream_index(spark, out)
    assert sorted(r.doc_key for r in half.documents.collect()) == ["a", "b"]
    assert {r.term for r in half.doc_freq.collect()} == {"run", "x", "y"}  # stemmed, as build_index does
    index_stream.index_batch(docs_df(spark, [("c", "z")]), 1, out)  # the retry
    assert index_stream.read_stream_index(spark, out).n_docs == 3
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    assert not [s for s in fs.listStatus(root) if s.getPath().getName().startswith("stream-batch-")]


def test_stream_of_replacements(spark):
    from conftest import docs_df
    out = scratch_path(spark, "t-replace")
    index_stream.index_batch(docs_df(spark, [("a", "x y"), ("b", "y")]), 0, out, policy="replace")
    index_stream.index_batch(docs_df(spark, [("a", "z"), ("c", "x")]), 1, out, policy="replace")
    index_stream.index_batch(docs_df(spark, [("a", "w w")]), 2, out, policy="replace")
    got = index_stream.read_stream_index(spark, out)
    assert {(r.doc_key, r.term, r.freq) for r in got.postings.collect()} == {("a", "w", 2), ("b", "y", 1), ("c", "x", 1)}
    assert got.n_docs == 3


def _rows(spark, items):
    from conftest import docs_df
    return docs_df(spark, items)


def test_key_filters_hold_every_key_and_few_others(spark):
    from lexspark.streaming import key_filters as kf
    keys = spark.range(0, 20_000, 2).select(F.concat(F.lit("doc/"), "id").alias("doc_key"))
    filters = kf.build(keys, 8)
    assert filters.count() == 8
    others = spark.range(1, 20_000, 2).select(F.concat(F.lit("doc/"), "id").alias("doc_key"))
    for probe, low, high in ((keys, 10_000, 10_000), (others, 0, 300)):
        keyed = probe.withColumn("key_bucket", kf.key_bucket("doc_key", 8)).join(filters, "key_bucket")
        assert low <= keyed.where(kf.may_hold(F.col("words"), F.col("n_bits"), "doc_key")).count() <= high
    assert kf.build(keys.limit(0)).collect() == []


def test_a_batch_reads_only_folders_that_may_hold_its_keys(spark):
    out = scratch_path(spark, "t-filters")
    for n in range(4):
        index_stream.index_batch(_rows(spark, [(f"k{n}-{i}", "x y") for i in range(30)]), n, out)
    known = index_stream.earlier_rows(spark, out, 4, _rows(spark, [("k2-5", ""), ("new", "")]).select("doc_key"))
    assert [tuple(r) for r in known.collect()] == [("k2-5", 2)]
    plan = known._jdf.queryExecution().executedPlan().toString()
    filters = [line.split("PartitionFilters: [")[1].split("PushedFilters")[0] for line in plan.split("\n") if "FileScan" in line]
    assert any("batch_id" in f and "key_bucket" in f for f in filters)
    folders = index_stream.key_filters.candidate_folders(spark.read.parquet(f"{out}/key_filters"), _rows(spark, [("k2-5", "")]))
    assert len(folders) < 4 < spark.read.parquet(f"{out}/key_filters").count()
    assert index_stream.earlier_rows(spark, out, 4, _rows(spark, [("certainly new", "")]).select("doc_key")) is None


def test_state_counts_replacements_and_retries_once(spark):
    out, state, ckpt = (scratch_path(spark, f"t-state-{n}") for n in "abc")
    batches = [[("a", "x y x"), ("b", "y z")], [("b", "z z new"), ("c", "")], [("a", "w"), ("b", "y"), ("d", "x")]]
    want = {}
    for n, batch in enumerate(batches):
        want.update(batch)
        for _ in range(2):  # the second is a retry
            index_stream.index_batch(_rows(spark, batch), n, out, stem=False, policy="replace", events=True)
        index_stream.doc_freq_stream(spark, out, state, ckpt).awaitTermination()  # starts from its checkpoint
        full = ix.build_index(_rows(spark, list(want.items())), stem=False).doc_freq
        got = {tuple(r) for r in index_stream.read_doc_freq(spark, state).collect()}
        assert got == {tuple(r) for r in full.select("term", "df").collect()}
        streamed = index_stream.read_stream_index(spark, out, stemmed=False)
        assert {tuple(r) for r in streamed.doc_freq.select("term", "df").collect()} == got


def test_stemming_is_stored_with_the_stream(spark):
    src, out = scratch_path(spark, "t-stem-src"), scratch_path(spark, "t-stem-out")
    _rows(spark, [("a", "running runs"), ("b", "run")]).write.parquet(src)
    for stem, term in ((False, "runs"), (True, "run")):
        stream = spark.readStream.schema("doc_key string, text string").parquet(src)
        index_stream.index_stream(stream, f"{out}{stem}", scratch_path(spark, "t-ckpt"), stem=stem).awaitTermination()
        index = index_stream.read_stream_index(spark, f"{out}{stem}")
        assert index.stemmed == stem and term in {r.term for r in index.doc_freq.collect()}


def test_no_task_reads_the_whole_table_for_the_documents_that_come_twice(spark, tmp_dir):
    """The file of the source that arrives again is written from a filtered exchange, not by one task over the table."""
    from lexspark.plans import catalog, params as P
    rows = [(n, f"word{n} and more", P.DUPLICATED_SOURCE if n % 5 == 0 else "src1", "en") for n in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4).write.parquet(
        f"{tmp_dir}/documents.parquet")
    written = []
    real = type(spark.range(1).write).parquet

    def parquet(self, path, *args, **kwargs):
        if path.endswith("/b"):
            written.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        return real(self, path, *args, **kwargs)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(spark.range(1).write), "parquet", parquet)
        out = catalog.stream_unique_keys(spark, tmp_dir)
    assert "Repartition 1, true" in written[0]  # with a shuffle
    assert sorted(r[0] for r in out.collect()) == list(range(40))


def test_a_batch_keeps_its_forward_index_and_no_second_copy_of_its_postings(spark):
    out = scratch_path(spark, "t-forward")
    index_stream.index_batch(_rows(spark, [("a", "x y x"), ("b", ""), (None, "x")]), 0, out, stem=False)
    index_stream.index_batch(_rows(spark, [("a", "other"), ("c", "y")]), 1, out, stem=False)
    assert not index_stream._exists(spark, f"{out}/postings")
    got = index_stream.read_stream_index(spark, out, stemmed=False)
    assert "Join" not in got.doc_terms._jdf.queryExecution().executedPlan().toString()  # stored, not grouped again
    assert {(r.doc_key, r.term_count, tuple(map(tuple, r.terms))) for r in got.doc_terms.collect()} == {
        ("a", 3, (("x", 2), ("y", 1))), ("b", 0, ()), (None, 1, (("x", 1),)), ("c", 1, (("y", 1),))}
    assert {tuple(r) for r in got.doc_freq.collect()} == {("x", 2), ("y", 2)}


def test_batches_that_kept_postings_are_read_with_later_ones(spark):
    """A stream begun before there was ``doc_terms``: batch 0 holds postings, batch 1 failed after it had written its own."""
    out = scratch_path(spark, "t-older")
    index_stream.index_batch(_rows(spark, [("a", "x y"), ("b", "y")]), 0, out, stem=False, policy="replace")
    older = ix.from_forward(spark.read.parquet(f"{out}/doc_terms/batch_id=0"), False).postings
    for n in (0, 1):
        older.write.parquet(f"{out}/postings/batch_id={n}")
    index_stream.delete_path(spark, f"{out}/doc_terms")
    index_stream.index_batch(_rows(spark, [("a", "z"), ("c", "y")]), 1, out, stem=False, policy="replace", events=True)
    got = index_stream.read_stream_index(spark, out, stemmed=False)
    assert {tuple(r) for r in got.doc_freq.collect()} == {("y", 2), ("z", 1)}
    assert {(r.doc_key, tuple(map(tuple, r.terms))) for r in got.doc_terms.collect()} == {
        ("a", (("z", 1),)), ("b", (("y", 1),)), ("c", (("y", 1),))}
    events = spark.read.parquet(f"{out}/df_events").select("term", "delta")
    assert {tuple(r) for r in events.collect()} == {("x", -1), ("z", 1)}


def test_filter_words_are_the_bits_of_the_keys_in_order(spark):
    from lexspark.streaming import key_filters as kf
    keys = spark.range(500).select(F.col("id").alias("doc_key"))
    want = {}
    placed = keys.select(F.explode(kf._places("doc_key", F.lit(5056))).alias("place")).collect()  # ceil(500 * 10 / 64) * 64
    for r in placed:
        want[r.place // 64] = want.get(r.place // 64, 0) | 1 << r.place % 64
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    row, = kf.build(keys, 1).collect()
    assert (row.key_bucket, row.n_bits, row.words) == (0, 5056, [signed(want.get(w, 0)) for w in range(79)])
