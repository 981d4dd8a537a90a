"""Terms counted in Arrow batches equal those of the column expressions."""

import random

import pytest
from pyspark.sql import functions as F

from lexspark.functions.analyze import term_counts, token_array
from lexspark.operators import counting
from lexspark.operators import index as ix
from lexspark.operators.stemming import stem_forward


def by_expressions(docs):
    tokens = docs.select("doc_key", token_array("text").alias("tokens")).withColumn("term_count", F.size("tokens").cast("bigint"))
    return term_counts(tokens, "tokens", "terms").select("doc_key", "term_count", "terms")


def odd_texts(spark):
    """Every code point among letters and numbers, mixed characters, and texts that are empty, null or no UTF-8."""
    around = [(n, "".join(f"a{chr(c)}1{chr(c)}b {chr(c)}" for c in range(n * 512, n * 512 + 512) if not 0xD800 <= c <= 0xDFFF))
              for n in range(0x110000 // 512)]
    rnd = random.Random(5)
    chars = "aZé9 ,.\nⅧ²½́　 \U0001F642中١﻿​İ\x00'_"
    mixed = [(10_000 + n, "".join(rnd.choice(chars) for _ in range(rnd.randint(0, 40)))) for n in range(1000)]
    rows = [*around, *mixed, (-1, None), (-2, ""), (None, "b a b"), (7, "again"), (7, "again")]
    bad = spark.createDataFrame([(-3, b"a\xff\xfe \xc3( b\xe2\x82A")], "doc_key long, b binary").select("doc_key", F.col("b").cast("string").alias("text"))
    return spark.createDataFrame(rows, "doc_key long, text string").unionByName(bad)


@pytest.mark.parametrize("most", [200, counting.SLICE_CHARS])
def test_counts_equal_those_of_the_expressions(spark, monkeypatch, most):
    monkeypatch.setattr(counting, "SLICE_CHARS", most)
    docs = odd_texts(spark).repartition(4)
    for want, got in ((by_expressions(docs), ix.build_index(docs, stem=False).doc_terms),
                      (stem_forward(by_expressions(docs)), ix.build_index(docs, stem=True).doc_terms)):
        key = lambda r: str(r)
        assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_classes_are_asked_once(spark):
    counting.char_classes(spark)
    assert counting.char_classes(spark.newSession()) is counting.char_classes(spark)


def test_documents_are_counted_in_arrow_batches(spark):
    plan = ix.build_index(odd_texts(spark), stem=False).doc_terms._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan
