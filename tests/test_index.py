"""Index invariants, storage and format round trips, incremental = full build."""

import contextlib
import glob
import json

import pytest
from pyspark.sql import functions as F

from conftest import SF001, docs_df
from lexspark.operators import incremental as inc
from lexspark.operators import index as ix
from lexspark.operators import ranking as rk
from lexspark.session import scratch_path
from lexspark.sinks import index_json, index_store
from lexspark.sources import index_json as json_src


@pytest.fixture(scope="module")
def docs(spark):
    return (spark.read.parquet(f"{SF001}/documents.parquet")
            .select(F.col("doc_id").alias("doc_key"), "text", "source"))


@pytest.fixture(scope="module")
def index(docs):
    return ix.build_index(docs.select("doc_key", "text"), stem=True)


def as_set(df, cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_invariants(index):
    # sum of frequencies = document length; df <= N; no postings without document
    bad = (index.postings.groupBy("doc_key").agg(F.sum("freq").alias("s"), F.max("term_count").alias("n"))
           .where(F.col("s") != F.col("n")).count())
    assert bad == 0
    assert index.doc_freq.where(F.col("df") > index.n_docs).count() == 0
    assert inc.orphan_postings(index.postings, index.documents).count() == 0
    assert inc.duplicate_keys(index.postings.select("doc_key", "term").withColumn(
        "k", F.concat_ws("\u0001", F.col("doc_key").cast("string"), "term")), "k").count() == 0


def test_empty_document_counts_in_n(spark):
    idx = ix.build_index(docs_df(spark, [("e.txt", ""), ("a", "x y")]), stem=False)
    assert idx.n_docs == 2
    assert as_set(idx.documents, ["doc_key", "term_count"]) == {("e.txt", 0), ("a", 2)}


def test_stemming_merges_terms(spark):
    idx = ix.build_index(docs_df(spark, [("1", "running runs RUN ran")]), stem=True)
    assert as_set(idx.postings, ["term", "freq"]) == {("run", 3), ("ran", 1)}


def test_parquet_roundtrip_and_bucket_pruning(spark, index):
    path = scratch_path(spark, "t-index")
    index_store.save_index(index, path, buckets=4)
    loaded = index_store.load_index(spark, path)
    assert loaded.buckets == 4 and loaded.stemmed and loaded.n_docs == index.n_docs
    cols = ["doc_key", "term", "freq", "term_count"]
    assert as_set(loaded.postings, cols) == as_set(index.postings, cols)
    assert as_set(loaded.doc_freq, ["term", "df"]) == as_set(index.doc_freq, ["term", "df"])
    q = spark.createDataFrame([(1, "the running texture")], "query_id int, text string")
    a = [tuple(r) for r in rk.search_many(loaded, q).collect()]
    b = [tuple(r) for r in rk.search_many(index, q).collect()]
    assert sorted(a) == sorted(b)
    plan = rk.search_many(loaded, q, fill=False)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_published_versions(spark, docs):
    root = scratch_path(spark, "t-pub")
    first = ix.build_index(docs.where(F.col("source") == "src1").select("doc_key", "text"), stem=False)
    second = ix.build_index(docs.select("doc_key", "text"), stem=False)
    index_store.publish_index(first, root, buckets=2)
    v2 = index_store.publish_index(second, root, buckets=2)
    assert index_store.published_versions(spark, root)[-1] == v2
    assert index_store.load_published(spark, root).n_docs == second.n_docs


def test_json_roundtrip(spark, index):
    path = scratch_path(spark, "t-json")
    index_json.write_json_index(index, path)
    loaded = json_src.read_json_index(spark, path)
    cols = ["term", "freq", "term_count"]
    got = as_set(loaded.postings.withColumn("doc_key", F.col("doc_key").cast("bigint")), ["doc_key"] + cols)
    assert got == as_set(index.postings, ["doc_key"] + cols)
    assert as_set(loaded.doc_freq, ["term", "df"]) == as_set(index.doc_freq, ["term", "df"])


def test_json_object_form(spark, tmp_dir):
    path = f"{tmp_dir}/index.json"
    with open(path, "w") as f:
        f.write('{"docs": {"./a.txt": {"tf": {"x": 2, "y": 1}, "count": 3}, "./e.txt": {"tf": {}, "count": 0}},'
                ' "df": {"x": 1, "y": 1}}')
    idx = json_src.read_json_object_index(spark, path, stemmed=False)
    assert idx.n_docs == 2
    assert as_set(idx.postings, ["doc_key", "term", "freq", "term_count"]) == {("./a.txt", "x", 2, 3),
                                                                               ("./a.txt", "y", 1, 3)}
    got = {r.doc_key: r.rank for r in rk.rank_all(idx, "x").collect()}
    assert got == pytest.approx({"./a.txt": 2 / 3 * 0.30103, "./e.txt": 0.0}, abs=1e-6)


ODD_KEYS = [("a,b.txt", 'x , " } { \\ : x'), ('q".txt', ""), ("c}{.txt", 'y x " , ,'), ("e:1,\\\".txt", "[ ] , count tf docs df")]


@contextlib.contextmanager
def settings(spark, **values):
    """Session settings (names with _ for .) inside, as before after."""
    values = {name.replace("_", "."): value for name, value in values.items()}
    saved = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in saved.items():
            spark.conf.set(name, value)


def index_rows(index):
    return [as_set(index.postings, ["doc_key", "term", "freq", "term_count"]),
            as_set(index.documents, ["doc_key", "term_count"]), as_set(index.doc_freq, ["term", "df"])]


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_json_object_in_fragments_and_ranges(spark, tmp_dir, monkeypatch, size):
    """Commas, braces, quotes and backslashes in keys; an object in fragments, in one file and in ranges of a few bytes."""
    index = ix.build_index(docs_df(spark, ODD_KEYS), stem=False, cache=True)
    path = f"{tmp_dir}/object"
    with settings(spark, spark_sql_adaptive_coalescePartitions_enabled="false"):
        index_json.write_json_object_index(index, path)
    parts = sorted(glob.glob(f"{path}/part-*"))
    assert len(parts) > 1  # several tasks wrote
    parsed = json.loads("".join(open(p).read() for p in parts))
    want = index_rows(index)
    assert {(k, v["count"]) for k, v in parsed["docs"].items()} == want[1] and set(parsed["df"].items()) == want[2]
    one = f"{tmp_dir}/one.json"
    with open(one, "w") as f:
        f.write(json.dumps(parsed))
    ranges = []
    real = json_src._pieces

    def pieces(*args):
        with settings(spark, spark_sql_files_maxPartitionBytes=size, spark_sql_files_openCostInBytes=size):
            rows = real(*args)
        ranges.append(rows.select("file", "start").distinct().count())
        return rows

    monkeypatch.setattr(json_src, "_pieces", pieces)
    for source in (path, one):
        assert index_rows(json_src.read_json_object_index(spark, source, stemmed=False)) == want
    assert ranges[0] > 1 and (ranges[1] > 1) == (size < 100)  # ranges of one file, too


def test_json_object_of_an_empty_index(spark):
    index = ix.build_index(docs_df(spark, []), stem=False)
    path = scratch_path(spark, "t-json-object")
    index_json.write_json_object_index(index, path)
    got = json_src.read_json_object_index(spark, path, stemmed=False)
    assert got.documents.count() == 0 and got.postings.count() == 0 and got.doc_freq.count() == 0


def test_legacy_import(spark, tmp_dir):
    path = f"{tmp_dir}/index-small.json"
    with open(path, "w") as f:
        f.write('{"./small/a.xhtml":{"OPEN":1,"SHADER":22,",":11},"./small/b.xhtml":{"SHADER":1,"BUFFER":36}}')
    idx = json_src.legacy_index(spark, path)
    assert idx.n_docs == 2
    assert as_set(idx.doc_freq, ["term", "df"]) == {("OPEN", 1), ("SHADER", 2), (",", 1), ("BUFFER", 1)}
    assert as_set(idx.documents, ["doc_key", "term_count"]) == {("./small/a.xhtml", 34), ("./small/b.xhtml", 37)}


def test_merge_equals_full_build(docs, index):
    base = ix.build_index(docs.where(F.col("source") < "src5").select("doc_key", "text"), stem=True)
    delta = ix.build_index(docs.where(F.col("source") >= "src5").select("doc_key", "text"), stem=True)
    merged = inc.merge_indexes(base, delta)
    assert as_set(merged.doc_freq, ["term", "df"]) == as_set(index.doc_freq, ["term", "df"])


def test_add_documents_policies(spark):
    base = ix.build_index(docs_df(spark, [("1", "a b"), ("2", "b c")]), stem=False)
    new = docs_df(spark, [("2", "c d"), ("3", "a")])
    with pytest.raises(ValueError):
        inc.add_documents(base, new, policy="error")
    with pytest.raises(ValueError):
        inc.add_documents(base, docs_df(spark, [("9", "x"), ("9", "y")]), policy="ignore")
    replaced = inc.add_documents(base, new, policy="replace")
    assert as_set(replaced.doc_freq, ["term", "df"]) == {("a", 2), ("b", 1), ("c", 1), ("d", 1)}
    assert replaced.n_docs == 3
    ignored = inc.add_documents(base, new, policy="ignore")
    assert as_set(ignored.doc_freq, ["term", "df"]) == {("a", 2), ("b", 2), ("c", 1)}
    added = inc.add_documents(base, docs_df(spark, [("4", "b")]), policy="error")
    assert as_set(added.doc_freq, ["term", "df"]) == {("a", 1), ("b", 3), ("c", 1)}


def test_surrogate_ids(docs):
    ids = inc.surrogate_ids(docs.select("doc_key"))
    inc.check_surrogate_ids(ids)
    assert ids.select("doc_id").distinct().count() == docs.count()


def test_json_and_stream_indexes_search_by_documents(spark, docs):
    """Indexes loaded from JSON or written by a stream carry a forward index, so
    large batches use the document-partitioned plan there too; it returns the
    same rows as the term plan on the same index (JSON keys are strings, so
    ties order as strings there)."""
    from lexspark.streaming import index_stream
    unstemmed = ix.build_index(docs.select("doc_key", "text"), stem=False)
    path = scratch_path(spark, "t-json-doc")
    index_json.write_json_index(unstemmed, path)
    loaded = json_src.read_json_index(spark, path, stemmed=False)
    out = scratch_path(spark, "t-stream-doc")
    index_stream.index_batch(docs.select("doc_key", "text"), 0, out, stem=False)
    streamed = index_stream.read_stream_index(spark, out, stemmed=False)
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    for idx in (loaded, streamed):
        assert idx.doc_terms is not None
        by_terms = {tuple(r) for r in rk.search_many(idx, bench, plan="terms").collect()}
        by_docs = {tuple(r) for r in rk.search_many(idx, bench, plan="documents").collect()}
        assert by_docs == by_terms and len(by_docs) == 20 * bench.count()


def test_stored_first_keys(spark, index):
    """A stored index keeps its smallest keys; zero-fill reads them instead of
    a top-k over every key, with the same result."""
    path = scratch_path(spark, "t-first-keys")
    index_store.save_index(index, path, buckets=2)
    loaded = index_store.load_index(spark, path)
    assert loaded._first_keys is not None
    assert rk.first_keys(loaded, 20) == rk.first_keys(index, 20)
    assert rk.first_keys(loaded, 5) == sorted(r.doc_key for r in index.documents.collect())[:5]


def test_json_object_is_written_and_read_without_a_row_per_posting(spark, tmp_dir):
    """The write shuffles no documents; the read joins many pieces to a chunk, and documents go on over its end."""
    rows = [(f"d{n}", " ".join(f"w{n}x{m} ," for m in range(n * 7))) for n in range(40)]
    index = ix.build_index(docs_df(spark, rows), stem=False, cache=True)
    plan = index_json.object_lines(index)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Join" not in plan
    path = f"{tmp_dir}/object"
    with settings(spark, spark_sql_execution_arrow_maxRecordsPerBatch="50"):
        index_json.write_json_object_index(index, path)
        chunks = json_src._pieces(spark, path)
        commas = sum(open(p).read().count(",") for p in glob.glob(f"{path}/part-*"))
        assert 0 < chunks.count() < commas / 10
        assert index_rows(json_src.read_json_object_index(spark, path, stemmed=False)) == index_rows(index)
