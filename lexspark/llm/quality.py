"""Quality classifier: a factorisation machine over hashed words, structure statistics and
metadata (the text's length).

Features of a text: its words (A-Z lower-cased), hashed to ``WORDS`` buckets, weighted by the
logarithm of their count and scaled to length 1/2; and ``STATISTICS``, each a share or
a logarithm cut into ``BINS`` bins, one of which is on.  The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

which is linear in the number of features that are on.  The machine is trained by
Adagrad on at most ``TRAIN_ROWS`` labelled texts (chosen by hash); only their features travel.

Defined results: null and empty texts have the features of an empty text and get a score;
rows without a label, or with a null one, are not learned from; a text that is labelled twice counts twice; nothing to learn
from gives 0.5 everywhere; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import hashing

WORDS = 1 << 14
BINS = 12
STATISTICS = ("length", "words", "word_length", "upper", "digits", "symbols", "non_ascii", "distinct_words",
              "repeated_next", "line_words", "distinct_lines", "marked_words", "lone_symbols", "shouted_words",
              "top_word")
N_FEATURES = WORDS + len(STATISTICS) * (BINS + 1)
FACTORS = 8
TRAIN_ROWS = 8_000
EPOCHS, STEP, DECAY, BATCH = 12, 0.08, 1e-5, 128
BATCH_BYTES = 4 << 20

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 symbol, 5 other byte of a letter
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
_PLAIN = np.zeros(256, bool)     # punctuation of ordinary prose
_PLAIN[[ord(c) for c in ",.;:'\"()-?"]] = True
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def _bin(share: float) -> int:
    return min(BINS, max(0, int(np.ceil(share * BINS))))


def text_features(raw: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one text: its bytes and the hashes of its words."""
    n, m = len(raw), len(words)
    kinds = np.bincount(_KIND[raw], minlength=6) / max(n, 1)
    distinct, counts = np.unique(words, return_counts=True)
    lines = raw.tobytes().split(b"\n")
    filled = [x for x in lines if x]
    space = _SPACE[raw]
    # a word's last byte, and whether the word is one byte long or upper case in its first two letters
    last = np.flatnonzero(~space & np.append(space[1:], True)) if n else np.zeros(0, np.int64)
    first = np.flatnonzero(~space & np.append(True, space[:-1])) if n else np.zeros(0, np.int64)
    marked = ((_KIND[raw[last]] == 4) & ~_PLAIN[raw[last]]).mean() if m else 0.0
    lone = ((first == last) & (_KIND[raw[first]] == 4)).mean() if m else 0.0
    second = np.minimum(first + 1, n - 1)
    shouted = ((_KIND[raw[first]] == 1) & (_KIND[raw[second]] == 1)).mean() if m else 0.0
    values = (np.log1p(n) / 14, np.log1p(m) / 12, min(1.0, n / max(m, 1) / 24), kinds[1], kinds[3], kinds[4], kinds[5],
              len(distinct) / max(m, 1), (words[1:] == words[:-1]).mean() if m > 1 else 0.0,
              min(1.0, m / max(len(filled), 1) / 60), len(set(filled)) / max(len(filled), 1), marked, lone, shouted,
              counts.max() / m if m else 0.0)
    bins = WORDS + np.arange(len(STATISTICS)) * (BINS + 1) + [_bin(v) for v in values]
    buckets = (distinct >> np.uint64(64 - 14)).astype(np.int64)
    weight = np.log1p(counts)
    weight = 0.5 * weight / np.sqrt((weight * weight).sum()) if m else weight
    return np.concatenate([buckets, bins]).astype(np.int32), \
        np.concatenate([weight, np.full(len(bins), 1 / np.sqrt(len(bins)))]).astype(np.float32)


def batch_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and row bounds of a column of texts."""
    data, offsets = hashing.text_buffer(column)
    words, at = hashing.word_hashes(data, offsets)
    rows = [text_features(data[s:e], words[a:b]) for s, e, a, b in zip(offsets[:-1], offsets[1:], at[:-1], at[1:])]
    bounds = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int64)
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), bounds
    return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), bounds


class Machine:
    """The parameters: a bias, a weight and FACTORS factors per feature."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(N_FEATURES, np.float32)
        self.v = rng.normal(0, 0.05, (N_FEATURES, FACTORS)).astype(np.float32)

    def raw_scores(self, ids: np.ndarray, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score before the logistic, and sum_i v_if x_i, per row (no row is without features)."""
        starts = bounds[:-1]
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * (sums * sums - np.add.reduceat(vx * vx, starts, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.w[ids] * x, starts) + pairs, sums

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for part in hashing.chunks(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text", BATCH_BYTES):
            ids, x, bounds = batch_features(part.column("text"))
            z, _ = self.raw_scores(ids, x, bounds)
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64))))
        return np.concatenate(out or [np.zeros(0)])

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray | None = None,
              seed: int = 7) -> None:
        """``weights``: how often a row counts (once each unless given)."""
        rng = np.random.default_rng(seed)
        weights = np.ones(len(rows)) if weights is None else np.asarray(weights, np.float64)
        share = np.clip(np.average(labels, weights=weights), 0.01, 0.99)
        weights = (weights / weights.mean()).astype(np.float32)
        self.bias = float(np.log(share / (1 - share)))
        sum_w, sum_v = np.full(N_FEATURES, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                pick = order[at:at + BATCH]
                ids = np.concatenate([rows[i][0] for i in pick])
                x = np.concatenate([rows[i][1] for i in pick])
                sizes = [len(rows[i][0]) for i in pick]
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                z, sums = self.raw_scores(ids, x, bounds)
                miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]).astype(np.float32) * weights[pick]
                per = np.repeat(miss, sizes)[:, None]
                used, place = np.unique(ids, return_inverse=True)
                grad_w = np.bincount(place, per[:, 0] * x, len(used)).astype(np.float32) + DECAY * self.w[used]
                full = per * (x[:, None] * np.repeat(sums, sizes, axis=0) - self.v[ids] * (x * x)[:, None])
                grad_v = np.stack([np.bincount(place, full[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32)
                grad_v += DECAY * self.v[used]
                sum_w[used] += grad_w ** 2
                sum_v[used] += grad_v ** 2
                self.w[used] -= STEP * grad_w / np.sqrt(sum_w[used])
                self.v[used] -= STEP * grad_v / np.sqrt(sum_v[used])
                self.bias -= STEP * 0.1 * float(miss.mean())


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in hashing.chunks(batches, "text", BATCH_BYTES):
        ids, x, bounds = batch_features(batch.column("text"))
        cut = list(zip(bounds[:-1], bounds[1:]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("label"), batch.column("copies"), pa.array([ids[s:e].tobytes() for s, e in cut], pa.binary()),
             pa.array([x[s:e].tobytes() for s, e in cut], pa.binary())], names=["key", "label", "copies", "ids", "x"])


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "label", train_rows: int = TRAIN_ROWS) -> Machine | None:
    """The machine of labelled texts (label 0 or 1), None if there are none."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(
        F.xxhash64(F.col(text_col), F.lit(3)).alias("key"), F.col(label_col).cast("int").alias("label"),
        F.col(text_col).alias("text"))
    n = rows.count()
    picked = rows.where(F.pmod("key", F.lit(1_000_000)) < F.lit(1_000_000) * min(1.0, train_rows / max(n, 1)))
    # copies of a text are one row with their number, so what reaches the driver does not grow with them
    picked = picked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("copies"), F.max("text").alias("text"))
    sent = picked.mapInArrow(_send, "key long, label int, copies long, ids binary, x binary").toPandas() \
                 .sort_values(["key", "label"], kind="stable")
    if not len(sent):
        return None
    machine = Machine()
    machine.train([(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for i, x in zip(sent["ids"], sent["x"])],
                  sent["label"].to_numpy(np.float32), sent["copies"].to_numpy())
    return machine


def score(docs: DataFrame, machine: Machine | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (a column of that name is replaced)."""
    if machine is None:
        return docs.withColumn("score", F.lit(0.5))

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(machine.scores(pa.array(texts, pa.large_string(), from_pandas=True)))

    return docs.withColumn("score", scores(F.col(text_col)))
