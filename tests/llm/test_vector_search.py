import math

import numpy as np
import pytest

from lexspark.llm import vector_search as op


def expected(rows, k=10):
    """Every pair of rows; query rows of one id are one query, for which a candidate row has its best score."""
    vectors = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
               if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in vectors if i % 100 == 0}:
        asked = [v for i, v in vectors if i == q]
        scores = sorted((-max(sum(x * y for x, y in zip(a, b)) for a in asked), i) for i, b in vectors if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.selectExpr("*", "1 as id", "'c' as block", "0 as v", "1 as rank", "2 as score")


@pytest.mark.parametrize("sizes", [(4096, 1024), (16, 2)])
def test_matches_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(op, "BLOCK", sizes[0])
    monkeypatch.setattr(op, "QUERIES", sizes[1])
    monkeypatch.setattr(op, "STRIPE", 2)
    rng = np.random.default_rng(2)
    rows = [(int(i * 10), [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(120)]
    same = rows[5][1]
    rows += [(2000 + i, same) for i in range(40)]  # ties
    rows += [(1, None), (2, []), (3, [0.1, None]), (100_000, [float("nan")] * 8), (5, [float("inf")] + [0.0] * 7), (None, same),
             (6, [0.5, -0.25])]
    got = {tuple(r) for r in op.top_k(table(spark, rows)).collect()}
    assert got == expected(rows)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (7, [0.5, 0.5])]
    assert {tuple(r) for r in op.top_k(table(spark, rows)).collect()} == expected(rows)
    assert op.top_k(table(spark, [])).collect() == []
    assert op.top_k(table(spark, [(0, [1.0])])).collect() == []


def test_repeated_queries_and_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 5)]) for i in range(60)]
    rows += [rows[0], rows[0], (0, rows[7][1]), (9, rows[8][1]), (9, rows[9][1])]
    got = [tuple(r) for r in op.top_k(table(spark, rows)).collect()]
    assert len(got) == 10 and set(got) == expected(rows)


@pytest.mark.parametrize("size", [1e5, 1e6, 1e13])
def test_large_components(spark, size):
    """Scores of about 2**53, 2**60 and beyond 64 bits, which are shown as the nearest ones."""
    rng = np.random.default_rng(5)
    rows = [(i * 5, [float(np.float32(x)) for x in rng.normal(0, size, 4)]) for i in range(80)] + [(3, [1e-3, 0.0, 0.5, -0.5])]
    got = {tuple(r) for r in op.top_k(table(spark, rows)).collect()}
    shown = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    assert got == {(q, r, i, shown(s)) for q, r, i, s in expected(rows)}
    assert (size > 1e12) == any(s == (1 << 63) - 1 for *_, s in got)


def test_component_beyond_the_largest(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 3e38]), (2, [1.0, -3e38]), (3, [2.0, 1.0])]
    got = {tuple(r) for r in op.top_k(table(spark, rows)).collect()}
    assert got == {(0, 1, 3, 2 << 20), (0, 2, 2, 1 << 20), (0, 3, 1, 0)}


def test_few_exact_vectors_are_read(spark, monkeypatch):
    """The approximations leave a small part to be read, and copies of a vector are not read one by one."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(4000)]
    rows += [(10_000 + i, rows[0][1]) for i in range(2000)]
    left = []
    real = op._to_read
    monkeypatch.setattr(op, "_to_read", lambda *a: left.append(real(*a)) or left[-1])
    got = {tuple(r) for r in op.top_k(table(spark, rows)).collect()}
    assert got == expected(rows)
    queries = sum(1 for i, _ in rows if i % 100 == 0)
    assert left[0].count() < 0.02 * queries * len(rows)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for size in (500, 1 << 56):
        matrix = rng.integers(-size, size, (300, 6))
        matrix[:, 5] = 7
        queries = rng.integers(-size, size, (20, 6))
        edges = op._edges([sorted(matrix[::9, d].tolist() + [int(matrix[:, d].min()), int(matrix[:, d].max())]) for d in range(6)])
        cells = op.approximate(matrix, edges)
        assert max(map(len, edges)) <= 257
        assert all((e[cells[:, d]] <= matrix[:, d]).all() and (matrix[:, d] < e[cells[:, d].astype(int) + 1]).all()
                   for d, e in enumerate(edges))
        lower, upper = op.bounds(queries, cells, edges, exact=size == 500)
        scores = [[sum(int(x) * int(y) for x, y in zip(q, v)) for v in matrix] for q in queries]
        assert all(lower[i, j] <= s <= upper[i, j] for i, row in enumerate(scores) for j, s in enumerate(row))
