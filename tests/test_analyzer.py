"""Tokenizer: FIXTURES.md cases, ASCII-only case folding, token kinds."""

import pytest
from pyspark.sql import functions as F

from lexspark.functions.analyze import raw_token_array, term_counts, token_array, token_kind

CASES = [
    ("3D 1D glTexImage1D", ["3", "D", "1", "D", "glTexImage1D"]),
    ("don't foo_bar", ["don", "'", "t", "foo", "_", "bar"]),
    ("naïve É Ⅷ ½x x²y 中文字", ["naïve", "É", "Ⅷ", "½", "x", "x²y", "中文字"]),
    ("🙂🙂 ok", ["🙂", "🙂", "ok"]),
    ("é", ["e", "́"]),
    ("a b　c d", ["a", "b", "c", "d"]),
    ("", []),
]


@pytest.mark.parametrize("text,tokens", CASES)
def test_tokens(spark, text, tokens):
    got = spark.createDataFrame([(text,)], "t string").select(raw_token_array("t")).first()[0]
    assert got == tokens


def test_ascii_case_folding(spark):
    got = spark.createDataFrame([("ABCÉ Hello",)], "t string").select(token_array("t")).first()[0]
    assert got == ["abcÉ", "hello"]


def test_null_text_is_empty(spark):
    got = spark.createDataFrame([(None,)], "t string").select(token_array("t")).first()[0]
    assert got == []


def test_token_kinds(spark):
    df = spark.createDataFrame([("12",), ("Ⅷ",), ("word",), (",",), ("🙂",)], "t string")
    kinds = [r[0] for r in df.select(token_kind("t")).collect()]
    assert kinds == ["number", "number", "word", "symbol", "symbol"]


def test_term_counts_in_row_equals_group_by(spark):
    texts = [(1, "b a b c a b"), (2, ""), (3, "x"), (4, "z z z")]
    df = spark.createDataFrame(texts, "id int, text string").select("id", token_array("text").alias("t"))
    rows = term_counts(df, "t").select("id", F.inline("term_counts")).collect()
    got = sorted((r.id, r.term, r.freq) for r in rows)
    assert got == [(1, "a", 2), (1, "b", 3), (1, "c", 1), (3, "x", 1), (4, "z", 3)]
