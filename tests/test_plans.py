"""Plan shapes behind the scale claims in README.md."""

import re

from pyspark.sql import functions as F

from conftest import SF001
from lexspark.operators import index as ix
from lexspark.operators import ranking as rk
from lexspark.plans import params as P
from lexspark.session import scratch_path
from lexspark.sinks import index_json
from lexspark.sinks import index_store as store
from lexspark.sources.tables import from_table, read_table, scope, spread


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> list:
    return re.findall(r"Exchange (\w+)\(([^)]*)\)", plan)


def docs(spark):
    return from_table(read_table(spark, SF001, "documents"), "doc_id", "text")


def test_unstemmed_postings_need_no_shuffle(spark):
    idx = ix.build_index(docs(spark), stem=False, cache=False)
    kinds = [k for k, _ in exchanges(plan_of(idx.postings))]
    assert set(kinds) <= {"RoundRobinPartitioning"}  # only the spread of a one-split test table


def test_stemmed_postings_need_no_shuffle(spark):
    idx = ix.build_index(docs(spark), stem=True, cache=False)
    for df in (idx.doc_terms, idx.postings):
        plan = plan_of(df)
        assert "hashpartitioning" not in plan and "Join" not in plan


def stored(spark):
    path = scratch_path(spark, "t-stored-plan")
    store.save_index(ix.build_index(docs(spark), stem=False), path, buckets=4)
    return store.load_index(spark, path)


def test_few_terms_are_pushed_into_the_stored_scans(spark):
    idx = stored(spark)
    plan = plan_of(rk.score_literal(idx, "the weather"))
    assert re.search(r"PushedFilters: \[[^\]]*In\(term, \[the", plan) or "EqualTo(term,the)" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    queries = spark.createDataFrame([(1, "the of"), (2, "and")], "query_id int, text string")
    many = rk.search_many(idx, queries, fill=False, plan="terms")
    assert re.search(r"PushedFilters: \[[^\]]*In\(term", plan_of(many))


def test_one_word_search_of_a_stored_index_takes_few_jobs(spark):
    idx = stored(spark)
    sc = spark.sparkContext
    sc.setJobGroup("one-word", "search of one word")
    assert len(rk.search(idx, "the").collect()) == 20
    jobs = sc.statusTracker().getJobIdsForGroup("one-word")
    sc.setJobGroup("", "")
    assert len(jobs) <= 4


def test_spread_starts_no_job(spark):
    sc = spark.sparkContext
    a, b = read_table(spark, SF001, "documents"), read_table(spark, SF001, "labels")
    sc.setJobGroup("spread", "spread")
    spread(a.join(b, "doc_id"))
    jobs = sc.statusTracker().getJobIdsForGroup("spread")
    sc.setJobGroup("", "")
    assert not jobs


def test_json_objects_need_no_shuffle(spark):
    idx = ix.build_index(docs(spark), stem=False, cache=False)
    assert "hashpartitioning" not in plan_of(index_json.document_objects(idx))


def test_spread_leaves_split_inputs_alone(spark):
    parallelism = spark.sparkContext.defaultParallelism
    wide = spark.range(0, 1000, numPartitions=parallelism)
    assert spread(wide) is wide
    narrow = spark.range(0, 10, numPartitions=1)
    assert spread(narrow).rdd.getNumPartitions() == parallelism


def test_scope_filter_reaches_parquet(spark):
    scoped = scope(read_table(spark, SF001, "documents"), "source", P.SCOPED_SOURCES)
    plan = plan_of(ix.build_index(from_table(scoped, "doc_id", "text"), stem=False, cache=False).doc_freq)
    assert "PushedFilters: [In(source" in plan
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "text:string" in read and "lang" not in read and "n_chars" not in read


def test_documents_written_twice_are_chosen_before_their_postings_are_exploded(spark, tmp_dir):
    from lexspark.operators import incremental as inc
    from lexspark.plans import catalog
    rows = [(n if n % 7 else None, f"word{n % 3} and and", P.DUPLICATED_SOURCE if n % 5 == 0 else "src1") for n in range(20)]
    rows += [(5, "again", "src1")]  # the key comes in two sources: both documents are written twice
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_dir}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for more keys than a plan expects to fit
    try:
        index = catalog._doubled(spark, tmp_dir)
        assert "hashpartitioning(doc_key" not in plan_of(index.postings)
        assert sorted(tuple(r) for r in inc.wrong_terms(index).collect()) == [
            ("again", 1, 1, 2), ("and", 1, 20, 23), ("word0", 1, 7, 8), ("word1", 1, 7, 8), ("word2", 1, 6, 7)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
