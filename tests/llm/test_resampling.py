import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from lexspark.llm import hashing, resampling as op

from . import fixtures as fx

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall(fx.ascii_lower(text).encode())
    return len(w), [b" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, targets):
    bag = lambda texts: np.bincount([zlib.crc32(f) % 10_000 for t in texts for f in features(t)[1]] or [0], minlength=10_000) \
        if any(features(t)[1] for t in texts) else np.zeros(10_000, int)
    s, t = bag([r[1] for r in rows]), bag(targets)
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(b) + 1) * (S + 10_000) / ((int(a) + 1) * (T + 10_000)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        n, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(x) % 10_000] for x in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    may = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(may[:5 * len(may) // 100]):
        ranks.setdefault(r, []).append(k + 1)
    return sorted(((*r, ranks[r].pop() if r[1] >= 20 and ranks.get(r) else None) for r in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


def rows_of(n, seed=4):
    rng = random.Random(seed)
    rows = [(i, " ".join(fx.words(rng, rng.randint(1, 60))), None, None) for i in range(n)]
    rows += [(n + k, t, None, None) for k, t in enumerate(fx.texts())]
    return rows + [(None, rows[3][1] + " q" * 30, None, None), (1, "Z-9 " * 25, None, None), (1, "Z-9 " * 25, None, None)]


def targets(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_matches_brute_force(spark, monkeypatch):
    rows = rows_of(300)
    texts = [r[1] for r in rows[5:20]] + [None, "", "Z-9"]
    docs = fx.documents(spark, rows).repartition(6)
    assert got(op.resample(docs, targets(spark, texts))) == brute([r[:2] for r in rows], texts)
    monkeypatch.setattr(op, "CHUNK_BYTES", 500)
    assert got(op.resample(docs, targets(spark, texts))) == brute([r[:2] for r in rows], texts)


def test_every_rank_once_and_reruns_agree(spark):
    docs = fx.documents(spark, [(i % 40, "same words here " * 10, None, None) for i in range(400)]).repartition(5)
    a, b = (got(op.resample(docs, targets(spark, ["same words"]))) for _ in range(2))
    assert a == b and sorted(r[5] for r in a if r[5]) == list(range(1, 21))
    assert {r[0] for r in a if r[5]} <= {r[0] for r in sorted(a, key=lambda r: -r[4])[:30]}


def test_empty_tables(spark):
    assert got(op.resample(fx.empty(spark), targets(spark, ["a b"]))) == []
    rows = rows_of(30)
    assert got(op.resample(fx.documents(spark, rows), targets(spark, []))) == brute([r[:2] for r in rows], [])


def test_crc_matrices():
    rng = random.Random(1)
    rows = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 3, 3, 3, 7, 40, 900]))) for _ in range(500)]
    assert op.crc32_rows(*hashing.text_buffer(pa.array(rows))).tolist() == [zlib.crc32(r) for r in rows]
    assert op.crc32_rows(np.zeros(0, np.uint8), np.zeros(1, np.int64)).tolist() == []
