import hashlib

import numpy as np
import pytest

from lexspark.llm import suffix_dedup as op

from . import fixtures as fx


def expected(rows):
    out, seen = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in order:
        raw = (t or "").encode()
        for j in range(len(raw) - 49):
            seen.setdefault(raw[j:j + 50], i)
    for i, t in order:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - 49):
            if seen[raw[j:j + 50]] != i:
                gone[j:j + 50] = b"\1" * 50
        spans = sum(1 for j in range(len(raw)) if gone[j] and not (j and gone[j - 1]))
        out[i] = (len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, shards, buckets and scans of a text
        for name, value in (("SHARD_BYTES", 9_000), ("BUCKET_BYTES", 4_000), ("SAMPLE_BYTES", 60_000)):
            monkeypatch.setattr(op, name, value)
    docs = fx.documents(spark).repartition(3, "doc_id")
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in op.dedup_spans(docs).collect()}
    assert got == expected(fx.plain(docs))


def test_digest_repeated_rows_null_ids_and_empty(spark):
    t = "the same long passage of more than fifty bytes, again and again"
    docs = fx.documents(spark, [(4, t, None, None), (4, t, None, None), (7, "x" + t, None, None), (None, t, None, None)])
    got = sorted((r.id or 99, r.n_removed, r.n_spans, bytes(r.kept)) for r in op.dedup_spans(docs, digest=True).collect())
    h = lambda b: hashlib.sha256(b).digest()
    assert got == [(4, 0, 0, h(t.encode()))] * 2 + [(7, len(t), 1, h(b"x")), (99, len(t), 1, h(b""))]
    assert op.dedup_spans(fx.empty(spark)).collect() == []


def test_multikey_order():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order, runs = op.multikey_order(4, lambda k, which: keys[which, k], 500)
    rows = [tuple(keys[i]) for i in order]
    assert rows == sorted(rows)
    assert all((runs[i] == runs[i - 1]) == (rows[i] == rows[i - 1]) for i in range(1, 500))


def test_every_window_has_its_suffix():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    offsets = np.array([0, 1000, 1030, 1030, 3000])
    s = op._Suffixes(data, offsets)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(s.first, s.last)])
    assert sorted(covered) == [*range(0, 951), *range(1030, 2951)]
    assert ((s.first <= s.at) & (s.at <= s.first + op.LENGTH - op.LEAD)).all()
