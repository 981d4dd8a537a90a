"""The corpus pipeline: language identification, exact dedup, near-copy removal, mixing, BPE.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspark.llm import bpe, exact_dedup, jaccard_join, language, mixing
from lexspark.llm.catalog import vocabulary_path
from lexspark.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those that are null or hold no letter.  The languages are learned
    from the documents that name theirs, and the others get the one predicted; ``lang`` stays null
    where none could be learned."""
    model = language.learn(docs)
    if not model.languages:
        return language.lettered(docs)
    marked = language.identify(docs, model).where("score > 0")  # 0 without a letter only
    lang = F.coalesce("lang", "lang_pred").alias("lang")
    return marked.select(*(lang if c == "lang" else c for c in docs.columns))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.75 over 5-word shingles the smallest id stays."""
    return jaccard_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document once per epoch that takes it; the one at a source's cut in part."""
    return mixing.repeated(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` per document of the mixture, encoded and decoded; the job stops
    where the ids do not give the text back."""
    texts = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    coded = bpe.encode(texts.withColumn("key", F.struct("doc_id", "text_sha256")), vocabulary_path(), "key", decoded=True)
    exact = F.assert_true(F.col("id.text_sha256") == F.col("decoded_sha256"), F.lit("the ids do not give the text back"))
    return coded.where(exact.isNull()).select(F.col("id.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                                              "ids", "decoded_sha256")


STAGES = [("language", identify_language), ("exact_dedup", drop_exact_copies), ("near_copies", drop_near_copies),
          ("mixing", mix_sources), ("bpe", encode)]

#: SQL has no BPE and learns no model; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
