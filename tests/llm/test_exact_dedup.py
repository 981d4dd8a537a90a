import hashlib

from lexspark.llm import exact_dedup as op

from . import fixtures as fx


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(fx.ascii_lower(t), []).append(i)
    return sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def got(df):
    return sorted(tuple(r) for r in df.select("id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_matches_brute_force(spark):
    docs = fx.documents(spark)
    assert got(op.exact_dedup(docs)) == expected(fx.plain(docs))


def test_frequent_texts_go_the_broadcast_way(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ROWS", 64)
    monkeypatch.setattr(op, "COUNTERS", 4)
    rows = [(i, "hot" if i % 3 else f"t{i % 50}", None, None) for i in range(2000)]
    docs = fx.documents(spark, rows)
    keys = docs.selectExpr("xxhash64(text) as key")
    hot = spark.sql("select xxhash64('hot') k").first()[0]
    assert hot in {r.key for r in op.frequent_keys(keys, 2000).collect()}
    assert got(op.exact_dedup(docs)) == expected(fx.plain(docs))


def test_summary_keeps_every_key_above_its_share(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ROWS", 32)
    monkeypatch.setattr(op, "COUNTERS", 9)
    keys = spark.range(0, 3000, 1, 7).selectExpr("case when id % 5 = 0 then -1 when id % 7 = 0 then -2 else id end as key")
    kept = {r.key for r in op.frequent_keys(keys, 3000).collect()}
    assert {-1, -2} <= kept and len(kept) <= 9


def test_drop_copies_keeps_columns_and_one_of_each(spark):
    docs = fx.documents(spark)
    kept = op.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({e[1] for e in expected(fx.plain(docs))})


def test_empty_and_null_ids(spark):
    assert got(op.exact_dedup(fx.empty(spark))) == []
    docs = fx.documents(spark, [(None, "a", None, None), (4, "A", None, None), (None, None, None, None)])
    rows = {(r.id, r.keep_id, r.group_size, r.kept) for r in op.exact_dedup(docs).collect()}
    assert rows == {(None, 4, 2, False), (4, 4, 2, True), (None, None, 1, True)}
