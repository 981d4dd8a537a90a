import re
import random

import pytest

from lexspark.llm import jaccard_join as op
from lexspark.llm.components import components

from . import fixtures as fx


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", fx.ascii_lower(text))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b]) if a < b else 0
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(docs):
    return {r.id: (r.n_shingles, r.component_id) for r in op.jaccard_components(docs).collect()}


@pytest.mark.parametrize("block_docs", [384, 4])
def test_matches_brute_force(spark, monkeypatch, block_docs):
    monkeypatch.setattr(op, "BLOCK_DOCS", block_docs)
    docs = fx.documents(spark)
    assert got(docs) == expected(fx.plain(docs))


def test_family_of_near_copies_over_many_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_DOCS", 7)
    monkeypatch.setattr(op, "SHARD_BYTES", 20_000)
    rng = random.Random(4)
    base = fx.words(rng, 80)
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"new{rng.randrange(10)}"
        rows.append((i, " ".join(w), None, None))
    docs = fx.documents(spark, rows).repartition(4)
    assert got(docs) == expected(fx.plain(docs))


def test_links_are_counted_between_classes(spark):
    a, b = "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s u"
    docs = fx.documents(spark, [(5, a, None, None), (3, b, None, None), (9, a, None, None), (7, "z y", None, None)])
    assert {r.id: (r.class_id, r.component_id, r.n_links) for r in op.jaccard_components(docs).collect()} == {
        5: (5, 3, 1), 9: (5, 3, 1), 3: (3, 3, 1), 7: (7, 7, 0)}
    kept = op.drop_near_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7] and kept.columns == docs.columns


def test_empty_and_null_ids(spark):
    assert got(fx.empty(spark)) == {}
    docs = fx.documents(spark, [(None, "a b", None, None), (1, "a b", None, None), (2, None, None, None), (3, "", None, None)])
    assert got(docs) == {None: (1, None), 1: (1, 1), 2: (0, 2), 3: (0, 3)}
    assert sorted(r.doc_id or 0 for r in op.drop_near_copies(docs).collect()) == [0, 1, 2, 3]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200)]
    rows = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert rows == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_an_id_with_several_texts_keeps_all_its_links(spark):
    import random
    rng = random.Random(8)
    a, b = (fx.words(rng, 60) for _ in range(2))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, " ".join(a + ["x"])), (7, " ".join(b + ["y"])), (3, " ".join(fx.words(rng, 60)))]
    docs = fx.documents(spark, [(*r, None, None) for r in rows])
    found = {(r.id, r.component_id) for r in op.jaccard_components(docs).collect()}
    assert found == {(5, 5), (6, 5), (7, 5), (3, 3)}
    assert all(r.n_links == 1 for r in op.jaccard_components(docs).where("id in (6, 7)").collect())
