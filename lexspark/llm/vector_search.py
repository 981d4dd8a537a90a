"""Exact top-k search by inner product with vector-approximation files.

Each component x becomes ``floor(SCALE * x)``.  A vector's approximation is one byte per component: its cell in a
grid of at most 256 cells, whose edges are half equally wide and half quantiles of the component.  The approximations
are made once and written; the exact vectors stay where they are.

1. Of equal vectors only the k + 1 rows with the smallest ids can be among any k results; the others go (a window
   that is cut in each task before its shuffle).
2. Stripes of approximations meet blocks of queries.  Cell corners, taken by the sign of the query, bound each score
   from both sides.  The k-th largest lower bound is carried from block to block of a stripe, and what cannot reach
   it is left; a k-th bound over all stripes leaves more.
3. Exact vectors are read by place, in the order of their upper bound (of their lower bound, as a distance): the
   first ``READ`` of a query, then those that can still reach the k-th score found.

The query set is stated (ids divisible by ``every``), so the bounds are queries x vectors, of one byte a component.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; a shorter vector
counts as padded with zeros; ties go to the smaller id; rows that repeat an id are separate candidates; query rows
that repeat an id are one query, for which a candidate has its best score; a query is never its own candidate (by
id); rows with a null id take no part; an empty table gives an empty result; other columns are ignored.  Components
beyond 2**57 count as that, and a score beyond 64 bits is shown as the nearest one, in its exact place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

SCALE = 1024
BLOCK = 4096      # approximations whose bounds are held at once
STRIPE = 16       # blocks of a stripe
QUERIES = 1024
EDGES = 125       # edges of each kind inside a component's range
READ = 40         # exact vectors read for a query before the others are judged by the k-th of them
LARGEST = 1 << 57
EXACT = 1 << 53   # sums of doubles are exact below

_SURVIVORS = pa.schema([("q", pa.int64()), ("place", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])


def _edges(quantiles: list[list[int]]) -> list[np.ndarray]:
    """Ascending edges per component from its (sorted) quantiles, the first being the least value, the last the
    greatest; the last edge is one above."""
    out = []
    for values in quantiles:
        low, high = int(values[0]), int(values[-1])
        even = {low + (high + 1 - low) * i // (EDGES + 1) for i in range(EDGES + 1)}
        out.append(np.array(sorted(even | {int(x) for x in values}) + [high + 1], np.int64))
    return out


def _matrix(lists: list, width: int) -> np.ndarray:
    matrix = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        matrix[i, :len(v)] = v
    return matrix


def approximate(matrix: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The cell of each component: one byte."""
    cells = np.empty(matrix.shape, np.uint8)
    for d, of_component in enumerate(edges):
        cells[:, d] = np.searchsorted(of_component, matrix[:, d], side="right") - 1
    return cells


def _approximations(edges: list[np.ndarray]):
    """Rows (place, id, v) to rows of up to BLOCK approximations."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                cells = approximate(_matrix(part.column("v").to_pylist(), len(edges)), edges)
                bytes_of = [part.column(c).to_numpy().tobytes() for c in ("place", "id")] + [cells.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in bytes_of], names=["places", "ids", "cells"])
    return run


def _query_block(width: int):
    """The queries of a block to one row."""
    def run(group: pa.Table) -> pa.Table:
        matrix = _matrix(group.column("v").to_pylist(), width)
        columns = [pa.array([group.column(c).to_numpy().tobytes()], pa.binary()) for c in ("q", "id")]
        return pa.Table.from_arrays([pa.array([group.column("query_block")[0].as_py()], pa.int64()), *columns,
                                     pa.array([matrix.tobytes()], pa.binary())], names=["query_block", "qs", "query_ids", "matrix"])
    return run


def bounds(queries: np.ndarray, cells: np.ndarray, edges: list[np.ndarray], exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores, (queries, vectors); widened by what rounding may lose unless ``exact``."""
    low = np.stack([e[cells[:, d]] for d, e in enumerate(edges)], axis=1).astype(np.float64)
    high = np.stack([e[cells[:, d].astype(np.int64) + 1] - 1 for d, e in enumerate(edges)], axis=1).astype(np.float64)
    positive, negative = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    lower, upper = positive @ low.T + negative @ high.T, positive @ high.T + negative @ low.T
    if not exact:
        lost = (positive - negative) @ np.maximum(np.abs(low), np.abs(high)).T * ((2 * len(edges) + 8) * 2.0 ** -52)
        lower, upper = lower - lost, upper + lost
    return lower, upper


def survivors(queries: np.ndarray, query_ids: np.ndarray, blocks, edges: list[np.ndarray], k: int, exact: bool):
    """(query, place, lower, upper) arrays of the vectors of ``blocks`` (places, ids, cells) whose upper bound reaches
    the k-th largest lower bound of their query in all blocks."""
    best = np.full((len(queries), k), -np.inf)
    kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)]
    for places, ids, cells in blocks:
        lower, upper = bounds(queries, cells, edges, exact)
        own = query_ids[:, None] == ids[None, :]
        lower[own] = upper[own] = -np.inf
        both = np.concatenate([best, lower], axis=1)
        best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        reach = best.min(axis=1)
        q, v = np.nonzero((upper >= reach[:, None]) & ~own)
        still = kept[3] >= reach[kept[0]]
        kept = [np.concatenate([a[still], b]) for a, b in zip(kept, (q, places[v], lower[q, v], upper[q, v]))]
    return kept


def _survivors(edges: list[np.ndarray], k: int, exact: bool):
    width = len(edges)

    def run(stripe: pa.Table, block: pa.Table) -> pa.Table:
        if not stripe.num_rows or not block.num_rows:
            return _SURVIVORS.empty_table()
        qs, query_ids = (np.frombuffer(block.column(c)[0].as_py(), np.int64) for c in ("qs", "query_ids"))
        queries = np.frombuffer(block.column("matrix")[0].as_py(), np.int64).reshape(-1, width)
        rows = ((np.frombuffer(p.as_py(), np.int64), np.frombuffer(i.as_py(), np.int64),
                 np.frombuffer(c.as_py(), np.uint8).reshape(-1, width))
                for p, i, c in zip(*(stripe.column(c) for c in ("places", "ids", "cells"))))
        q, place, lower, upper = survivors(queries, query_ids, rows, edges, k, exact)
        return pa.Table.from_arrays([pa.array(qs[q]), pa.array(place), pa.array(lower), pa.array(upper)], schema=_SURVIVORS)
    return run


def _product(a: str, b: str, small: bool) -> Column:
    """The inner product; a shorter vector counts as padded with zeros."""
    number = "bigint" if small else "decimal(38,0)"
    terms = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("bigint" if small else "decimal(19,0)") * y, F.lit(0)).cast(number))
    return F.aggregate(terms, F.lit(0).cast(number), lambda total, x: (total + x).cast(number))


def _file(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(place, id, v): the vectors that take part as candidates, a written table."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    limit = float(LARGEST)
    whole = lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x.cast("double") * SCALE))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(v) > 0) & finite).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(whole(x)).cast("long")).alias("v"))
    return materialize(rows.withColumn("place", F.monotonically_increasing_id()), "vectors")


def _candidates(rows: DataFrame, k: int) -> DataFrame:
    """Without the copies of a vector that are in no result: all but the k + 1 smallest ids (one may be the query's)."""
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id", "place"))
    return materialize(rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"), "vector-candidates")


def _to_read(candidates: DataFrame, queries: DataFrame, k: int, stats: list[list[int]]) -> DataFrame:
    """(q, place, upper): what the approximations leave to be read."""
    edges = _edges(stats or [[0]])
    greatest = max([max(abs(int(s[0])), abs(int(s[-1]))) for s in stats], default=0) + 1
    exact = greatest * greatest * len(edges) < EXACT
    n, n_queries = candidates.count(), queries.count()
    n_stripes, n_blocks = max(1, -(-n // (BLOCK * STRIPE))), max(1, -(-n_queries // QUERIES))
    numbers = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    stored = materialize(candidates.select("place", "id", "v").mapInArrow(
        _approximations(edges), "places binary, ids binary, cells binary"), "vector-approximations")
    stripes = (stored.withColumn("stripe", F.pmod(F.xxhash64("places"), F.lit(n_stripes)))
               .withColumn("query_block", numbers(n_blocks)))
    blocks = (queries.withColumn("query_block", F.pmod(F.xxhash64("q"), F.lit(n_blocks))).groupBy("query_block")
              .applyInArrow(_query_block(len(edges)), "query_block long, qs binary, query_ids binary, matrix binary")
              .withColumn("stripe", numbers(n_stripes)))
    keys = ["query_block", "stripe"]
    left = materialize(stripes.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(
        _survivors(edges, k, exact), "q long, place long, lower double, upper double"), "vector-bounds")
    kth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("lower"), "place"))
    reach = (left.select("q", "place", "lower").withColumn("n", kth).where(F.col("n") <= k)
             .where(F.col("n") == k).select("q", F.col("lower").alias("reach")))
    return left.join(reach, "q", "left").where(F.col("reach").isNull() | (F.col("upper") >= F.col("reach"))).select("q", "place", "upper")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for every query (rows whose id is divisible by ``every``)."""
    rows = _file(vectors, id_col, vector_col)
    queries = materialize(rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "v").dropDuplicates(["id", "v"])
                          .withColumn("q", F.monotonically_increasing_id()), "vector-queries")
    # a row per component: as many as a vector is long; a shorter vector has zeros
    shares = [i / (EDGES + 1) for i in range(EDGES + 2)]
    parts = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(
        F.percentile_approx("x", shares).alias("quantiles"), F.min("x").alias("least"), F.max("x").alias("greatest"))
    stats = [sorted([min(r["least"], 0), *r["quantiles"], max(r["greatest"], 0)]) for r in parts.orderBy("d").collect()]
    greatest = max([max(-s[0], s[-1]) for s in stats], default=0)
    small = greatest * greatest * len(stats) < 1 << 63
    candidates = _candidates(rows, k)
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("upper"), "place"))
    to_read = materialize(_to_read(candidates, queries, k, stats).withColumn("n", order), "vector-reads")

    def read(wanted: DataFrame) -> DataFrame:
        exact = wanted.join(candidates.select("place", F.col("id").alias("vec_id"), "v"), "place")
        return exact.join(queries.select("q", F.col("id").alias("query_id"), F.col("v").alias("w")), "q").select(
            "q", "query_id", "place", "vec_id", _product("v", "w", small).alias("score"))

    first = materialize(read(to_read.where(F.col("n") <= READ)), "vector-first")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "place"))
    kth = first.withColumn("n", best).where(F.col("n") <= k).where(F.col("n") == k).select("q", F.col("score").alias("kth"))
    rest = to_read.where(F.col("n") > READ).join(kth, "q", "left").where(
        F.col("kth").isNull() | (F.col("upper") >= F.col("kth").cast("double")))
    found = first.unionByName(read(rest)).groupBy("query_id", "place", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "place"))
    ends = [F.lit(x).cast("decimal(38,0)") for x in (-(1 << 63), (1 << 63) - 1)]
    shown = F.col("score") if small else F.greatest(ends[0], F.least(ends[1], F.col("score"))).cast("long")
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", shown.alias("score"))
