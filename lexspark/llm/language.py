"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte trigrams of lower-cased text
(letters only; everything else is a space).  It is learned from texts with a known
language, about ``TRAIN_DOCS`` different ones of each language or fewer (chosen by hash), as smoothed counts.

A text is a mixture of languages: expectation-maximisation finds the proportions that
make its trigrams likeliest.  The language set is selected by penalised likelihood: it starts
with the best single language and takes in the next one (by its proportion in the
mixture of all) while the log-likelihood gains more than ``PENALTY * log(trigrams)``.
The prediction is the language with the largest proportion in the selected set, and the score its
proportion in the mixture of all languages.

Defined results: a text that is null or holds no letter is ``und`` with score 0, as is any text
when nothing could be learned; rows with a null language are not learned from; equal scores go to the language
that comes first by name; rows that repeat are predicted alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from . import hashing
from .common import unused

BUCKETS = 1 << 15
TRAIN_DOCS = 10_000
SMOOTHING = 0.5
ROUNDS = 8
PENALTY = 2.0
BATCH_BYTES = 1 << 20
LETTER = re.compile(r"[^\W\d_]")


def _codes(text: str) -> np.ndarray:
    """Bucket of each byte trigram that holds a letter."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    letter = (raw >= 0x80) | ((raw >= 97) & (raw <= 122))
    b = np.where(letter, raw, 32).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x27D4EB2F)
    return ((mixed >> np.uint32(15)) % np.uint32(BUCKETS)).astype(np.int64)[letter[:-2] | letter[1:-1] | letter[2:]]


def has_letter(text: str | None) -> bool:
    if not text or not LETTER.search(text):
        return False
    return any(map(str.isalpha, text))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language of a partition."""
    sums: dict[str, np.ndarray] = {}
    for batch in hashing.chunks(batches, "text", BATCH_BYTES):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if has_letter(text):
                counts = np.bincount(_codes(text), minlength=BUCKETS)
                sums[lang] = sums[lang] + counts if lang in sums else counts
    for lang, counts in sums.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used.astype(np.int32)),
                                          pa.array(counts[used])], names=["lang", "bucket", "n"])


class Model:
    """Languages and the log-probability of each trigram bucket (BUCKETS x languages)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.p = smooth / smooth.sum(axis=0, keepdims=True)

    @staticmethod
    def _em(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood of the mixture of the columns of p."""
        share = np.full(p.shape[1], 1 / p.shape[1])
        total = n.sum()
        if p.shape[1] > 1:
            for _ in range(ROUNDS):
                share = share * ((n / (p @ share)) @ p) / total
        return share, float(n @ np.log(p @ share))

    def mixture(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The selected languages, their proportions, and the proportions in the mixture of all."""
        counts = np.bincount(_codes(text), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        p, n = self.p[used], counts[used].astype(np.float64)
        everything, _ = self._em(p, n)
        chosen = [int(np.argmax(n @ np.log(p)))]
        share, best = self._em(p[:, chosen], n)
        for nxt in np.argsort(-everything, kind="stable"):
            if nxt in chosen:
                continue
            tried = [*chosen, int(nxt)]
            tried_share, value = self._em(p[:, tried], n)
            if value - best <= PENALTY * np.log(max(n.sum(), 2.0)):
                break
            chosen, share, best = tried, tried_share, value
        return chosen, share, everything

    def describe(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        """Prediction, score, and the selected languages with their proportions, largest first."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, [], []
        chosen, share, everything = self.mixture(text)
        order = sorted(range(len(chosen)), key=lambda i: (-share[i], self.languages[chosen[i]]))
        score = float(min(max(everything[chosen[order[0]]], 0.0), 1.0))
        return self.languages[chosen[order[0]]], score, [self.languages[chosen[i]] for i in order], [float(share[i]) for i in order]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.describe(text)[:2]


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """The model of ``labelled`` texts; its size is (languages x BUCKETS)."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), train_docs / F.count(F.lit(1))).alias("share"))
    # a row per language; the hash of the text picks about train_docs of each
    picked = rows.withColumn("key", F.xxhash64("text")).join(F.broadcast(share), "lang").where(
        F.pmod("key", F.lit(1_000_000)) < F.col("share") * 1_000_000).dropDuplicates(["lang", "key"])
    sums = (picked.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    counts[sums["bucket"].to_numpy(np.int64), sums["lang"].map(place).to_numpy(np.int64)] = sums["n"].to_numpy(np.float64)
    return Model(languages, counts)


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds a letter."""
    mark = unused(docs, "lettered")
    holds = lambda texts: [pa.array([has_letter(t) for t in texts], pa.bool_())]
    return _beside(docs, text_col, docs.columns, {mark: "boolean"}, holds).where(mark).drop(mark)


def _beside(docs: DataFrame, text_col: str, keep: list[str], added: dict[str, str],
            found: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and those of ``found(texts)``; texts come in chunks of bounded bytes."""
    text, limit = unused(docs, "text_"), BATCH_BYTES
    given = docs.select(*keep)
    schema = StructType([*given.schema.fields, *(StructField(n, DataType.fromDDL(t)) for n, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashing.chunks(batches, text, limit):
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(columns + found(batch.column(text).to_pylist()), names=[*keep, *added])
    return docs.select(*keep, F.col(text_col).cast("string").alias(text)).mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all) with ``lang_pred``, ``score``, and the selected language set with its
    proportions, largest first: ``lang_set ARRAY<STRING>``, ``lang_shares ARRAY<DOUBLE>`` (columns of those names are replaced)."""
    added = {"lang_pred": "string", "score": "double", "lang_set": "array<string>", "lang_shares": "array<double>"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]

    def found(texts: list[str | None]) -> list[pa.Array]:
        rows = [model.describe(t) for t in texts]
        types = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return _beside(docs, text_col, keep, added, found)
