"""Small documents with the hard cases: copies, near copies, shared passages, nulls, empty and very
long texts, ties, repeated words, and extra columns whose names clash with the operators' own."""

import random

from pyspark.sql import functions as F

SYLLABLES = "an er the ti on re ou st ing ha nd ea le de que ció".split()
#: Names that the operators use inside.
CLASHING = ("id", "key", "row", "size", "block", "n", "h", "label", "digest", "kind", "taken", "score", "lang_pred", "_id",
            "_dropped", "_kept_id", "found", "part")


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def texts(seed=3):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(20, 120)) for _ in range(12)]
    passage = " ".join(words(rng, 60))
    out = [" ".join(b) for b in base]
    for b in base[:6]:
        for edits in (1, 2, 4, 9):
            w = list(b)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(SYLLABLES) + "x"
            out.append(" ".join(w))
    out += [out[0], out[0].upper(), out[1], out[1], out[2] + "\n"]
    out += [" ".join(words(rng, 9)) + " " + passage + " " + " ".join(words(rng, 9)) for _ in range(4)]
    out += [None, "", " \t\n", "a", "a b", "A B", "a b c d e", "x" * 300, "é" * 120, "one two three four", "ab " * 200]
    out.append(" ".join(words(rng, 30_000)))
    out.append("Éa ñ 中文字 🙂 don't  'll x　 y\r\n" * 20)
    return out


def documents(spark, rows=None, clash=True):
    """``doc_id, text, lang, source`` (and clashing columns); ids are dealt without order."""
    if rows is None:
        t = texts()
        rng = random.Random(9)
        ids = rng.sample(range(1, 10_000), len(t))
        rows = [(i, x, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s2", "s2", None, ""])) for i, x in zip(ids, t)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in CLASHING if clash else ():
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return documents(spark, rows=[], clash=False)


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
