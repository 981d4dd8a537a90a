import hashlib

import numpy as np
from pyspark.sql import functions as F

from lexspark.llm import simhash as op

from . import fixtures as fx


def edited(rows):
    """Edited text and next text per (id, text) row, ids descending (null last)."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(ordered):
        following, cut = ordered[(k + 1) % len(ordered)][1] or "", len(t or "") // 3
        out.append((i, t or "", (t or "")[:len(t or "") - cut] + following[:cut], following))
    return out


def marks(df):
    return df.select("id", "n_chars", "edited_sha256", op.as_text().alias("f"), op.as_text("e_").alias("e"), op.as_text("n_").alias("n"),
                     op.likeness("", "e_").alias("near_edited"), op.likeness("", "n_").alias("near_next")).collect()


def brute_fingerprint(spark, text):
    """Votes one by one over the terms, hashed by the engine's hash function."""
    words = spark.createDataFrame([(text,)], "t string").select(
        F.regexp_extract_all(F.lower("t"), F.lit(op.WORD), F.lit(0)).alias("w")).first().w
    votes = np.zeros(op.BITS, np.int64)
    pairs = list(zip(words, words[1:] + [None]))
    hashes = spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a", "b").alias("h")).withColumn("g", F.xxhash64("h")).collect()
    for (a, b), h in zip(pairs, hashes):
        for w, value in enumerate(h):
            for i in range(64):
                votes[64 * w + i] += (len(a) + len(b or "")) * (1 if value >> i & 1 else -1)
    return "".join(f"{sum(1 << i for i in range(64) if votes[64 * w + i] > 0):016x}" for w in range(op.BITS // 64))


def test_edited_texts_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(op, "RUN_ROWS", 4)
    docs = fx.documents(spark)
    rows = marks(op.neighbours(docs))
    expected = {i: (len(t), hashlib.sha256(e.encode()).hexdigest(), t, n) for i, t, e, n in edited(fx.plain(docs))}
    assert {r.id: (r.n_chars, r.edited_sha256) for r in rows} == {i: e[:2] for i, e in expected.items()}
    of_text = {expected[r.id][2]: r.f for r in rows}
    assert all(of_text[expected[r.id][2]] == r.f and of_text[expected[r.id][3]] == r.n for r in rows)
    bits = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert all(abs(r.near_edited - (1 - bits(r.f, r.e) / op.BITS)) < 1e-12 for r in rows)
    assert all(abs(r.near_next - (1 - bits(r.f, r.n) / op.BITS)) < 1e-12 for r in rows)
    for text in ("x" * 300, "a b c d e", fx.texts()[0]):
        assert of_text[text] == brute_fingerprint(spark, text)


def test_odd_tables(spark):
    assert marks(op.neighbours(fx.empty(spark))) == []
    one = marks(op.neighbours(fx.documents(spark, [(7, "abc def", None, None)])))
    assert [(r.id, r.n_chars, r.near_next) for r in one] == [(7, 7, 1.0)]
    assert one[0].edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    rows = [(None, "n u l l", None, None), (3, "x y", None, None), (3, "x y", None, None), (None, None, None, None), (9, "", None, None)]
    got = marks(op.neighbours(fx.documents(spark, rows)))
    assert sorted((r.id is None, r.id or 0, r.n_chars) for r in got) == [(False, 3, 3), (False, 3, 3), (False, 9, 0), (True, 0, 0), (True, 0, 7)]


def test_likeness_tells_edits_from_other_texts(spark):
    import random
    rng = random.Random(5)
    docs = fx.documents(spark, [(i, " ".join(fx.words(rng, 200)), None, None) for i in range(60)], clash=False)
    rows = marks(op.neighbours(docs))
    assert min(r.near_edited for r in rows) > max(r.near_next for r in rows)


def test_near_finds_all_within_the_radius(spark, monkeypatch):
    monkeypatch.setattr(op, "ARRAY_ROWS", 8)
    rng = np.random.default_rng(2)
    centres = rng.integers(-2 ** 63, 2 ** 63 - 1, (12, 2))
    rows = [tuple(int(x) for x in c) for c in centres]
    for c in centres:  # families around each centre, some far from it
        for _ in range(25):
            flipped = [int(x) for x in c]
            for b in rng.integers(0, 128, rng.integers(0, 6)):
                flipped[b // 64] ^= -(1 << 63) if b % 64 == 63 else 1 << (int(b) % 64)
            rows.append(tuple(flipped))
    rows += rows[:40]
    frame = spark.createDataFrame(rows, "f0 long, f1 long")
    bits = np.array(rows, np.int64).view(np.uint64)
    for radius, blocks in ((3, 4), (2, 4), (1, 2), (5, 8), (0, 4)):
        got = {(r.f0, r.f1): (r.copies, r.n_near) for r in op.near(frame, radius, blocks).collect()}
        for row in set(rows):
            apart = np.bitwise_count(bits ^ np.array(row, np.int64).view(np.uint64)).sum(1)
            assert got[row] == (int((apart == 0).sum()), int(((apart > 0) & (apart <= radius)).sum()))


def test_native_plan(spark):
    plan = op.neighbours(fx.documents(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
