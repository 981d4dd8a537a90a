import re

import pytest

from lexspark.llm import mixing as op

from . import fixtures as fx


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fill(sizes, share=1.5, weights=(5, 2, 1), epochs=2):
    """Targets by the rule as stated: share out by weight, stop at the cap, reshare what is left."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > epochs * sizes[s]}
        for s in over or open_:
            target[s] = epochs * sizes[s] if over else level * weight[s]
            left -= target[s] if over else 0
        open_ -= over or open_
    return target


@pytest.mark.parametrize("share", [0.4, 1.5, 3.0])
def test_targets_and_exact_budgets(spark, share):
    docs = fx.documents(spark)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    size = {i: len(words(t)) for i, t in fx.plain(docs)}
    total = {}
    for i, s in source.items():
        total[s] = total.get(s, 0) + size[i]
    target = fill(total, share)
    taken = dict.fromkeys(total, 0)
    rows = op.mix(docs, share=share).collect()
    assert sorted(r.id for r in rows) == sorted(size)
    for r in rows:
        s = source[r.id]
        assert (r.size, r.source_size) == (size[r.id], total[s])
        assert r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= 0.5


def test_reruns_and_buckets_agree(spark, monkeypatch):
    docs = fx.documents(spark)
    first = sorted(tuple(r) for r in op.mix(docs).collect())
    assert sorted(tuple(r) for r in op.mix(docs.repartition(5)).collect()) == first
    monkeypatch.setattr(op, "BUCKET_ROWS", 3)
    assert sorted(tuple(r) for r in op.mix(docs).collect()) == first  # the order does not depend on the buckets


def test_repeated_gives_the_taken_words(spark):
    docs = fx.documents(spark)
    mixed = op.mix(docs)
    out = op.repeated(docs, mixed)
    assert out.columns == docs.columns
    got, whole = {}, dict(fx.plain(docs))
    for r in out.collect():
        assert whole[r.doc_id].startswith(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    assert got == {r.id: r.taken for r in mixed.collect() if r.taken}


def test_empty(spark):
    assert op.mix(fx.empty(spark)).collect() == []
    docs = fx.documents(spark, [(1, None, None, "s"), (2, "", None, None)])
    assert {(r.id, r.size, r.taken) for r in op.mix(docs).collect()} == {(1, 0, 0), (2, 0, 0)}


def test_equal_rows_and_null_ids_share_out_exactly(spark):
    rows = [(1, "a b c", None, "s")] * 3 + [(2, "d e f g", None, "s")] + [(None, f"w{i} x", None, "t") for i in range(30)] + \
        [(None, "w1 x", None, "t"), (1, "a b c", None, "t")]
    docs = fx.documents(spark, rows)
    mixed = op.mix(docs)
    taken = sum(r.taken for r in mixed.collect())
    out = op.repeated(docs, mixed).collect()
    assert sum(len(r.text.split()) for r in out) == taken
    keys = {r.key for r in spark.read.parquet(_newest(spark, "mix-sizes")).where("id is null").collect()}
    assert len(keys) > 20  # null ids do not share one place on their source's axis


def _newest(spark, name):
    import glob
    import os
    from lexspark.session import checkpoint_dir
    return max(glob.glob(checkpoint_dir(spark).replace("file:", "") + f"/{name}-*"), key=os.path.getmtime)
