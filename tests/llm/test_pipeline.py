"""The pipeline's stages against brute force on a small table, and its column contract."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexspark.llm.catalog import vocabulary_path

from . import fixtures as fx
from .test_jaccard_join import expected as components


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    docs = fx.documents(spark, clash=False).selectExpr("*", "length(text) as n_chars")
    docs.write.parquet(f"{sf}/documents.parquet")
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf).write.parquet(f"{sf}/{name}")
        out.append(spark.read.parquet(f"{sf}/{name}"))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_only_documents_without_letters_are_rejected(stages):
    assert ids(stages[1]) == sorted(i for i, t in fx.plain(stages[0]) if t and any(map(str.isalpha, t)))


def test_exact_and_near_copies_go(stages):
    groups = {}
    for i, t in fx.plain(stages[1]):
        groups.setdefault(fx.ascii_lower(t), []).append(i)
    assert ids(stages[2]) == sorted(max(g) for g in groups.values())
    assert ids(stages[3]) == sorted({c for _, c in components(fx.plain(stages[2])).values()})


def test_mixture_and_ids(stages):
    n = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in fx.plain(df))
    assert n(stages[4]) == pytest.approx(1.5 * n(stages[3]), abs=3)
    library = Tokenizer.from_file(vocabulary_path())
    want = sorted((i, library.encode(t, add_special_tokens=False).ids) for i, t in fx.plain(stages[4]))
    assert sorted((r.doc_id, list(r.ids)) for r in stages[5].collect()) == want


def test_language_stage_without_labels(spark):
    texts = [(1, "the cat sat on the mat"), (2, "12 ..."), (3, None), (4, "der Hund und die Katze")]
    docs = fx.documents(spark, [(i, t, None, None) for i, t in texts], clash=False)
    for unlabelled in (docs.withColumn("lang", F.lit(None).cast("string")),
                       docs.withColumn("lang", F.when(F.col("doc_id") == 2, "en"))):
        out = corpus_pipeline.identify_language(spark, unlabelled, "")
        assert out.columns == unlabelled.columns
        assert {r.doc_id: r.lang for r in out.collect()} == {1: None, 4: None}


def test_language_stage_fills_null_languages(spark):
    given = {1: "en", 2: "de", 3: None, 4: None, 5: "und"}
    texts = {1: "the cat sat on the mat with the hat", 2: "der Hund und die Katze schlafen nicht", 3: "the cat sat on the mat",
             4: "der Hund und die Katze", 5: "zzyzx qqq wxwx"}
    docs = fx.documents(spark, [(i, t, None, None) for i, t in texts.items()], clash=False).drop("lang")
    langs = spark.createDataFrame(list(given.items()), "doc_id long, lang string")
    out = corpus_pipeline.identify_language(spark, docs.join(langs, "doc_id"), "")
    assert {r.doc_id: r.lang for r in out.collect()} == {**given, 3: "en", 4: "de"}
