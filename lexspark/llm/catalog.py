"""The registered queries: thin ``(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (bpe, collocations, exact_dedup, html_extract, jaccard_join, language, mixing, quality, resampling, secrets,
               simhash, suffix_dedup, vector_search)
from ..session import materialize
from .common import crc_mod, join_groups, table

#: Vocabulary of op10, by its name in the package of public tokenizers.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_spans(table(spark, sf_dir, "documents"), digest=True)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                      F.lower(F.hex("kept")).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = language.learn(docs.where(~held_out))
    found = language.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "lang_set", "lang_shares")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("digest")


def op4_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_extract.extract(pages, html_extract.learn(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    machine = quality.learn(docs.join(labels, "doc_id"))
    return quality.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score",
                                               (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path()).withColumnRenamed("id", "doc_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = materialize(simhash.neighbours(table(spark, sf_dir, "documents")), "simhash")
    near = materialize(simhash.near(marked), "simhash-near")
    found = join_groups(marked, near, simhash.FINGERPRINT, "copies", marked.count())
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", simhash.as_text().alias("fingerprint"),
                        simhash.as_text("e_").alias("edited_fingerprint"), simhash.likeness("", "e_").alias("near_edited"),
                        simhash.likeness("", "n_").alias("near_next"), "copies", "n_near")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_language_id, op3_mix_sources, op4_vector_top_k, op5_jaccard_join, op6_html_text,
    op7_exact_dedup, op8_quality, op9_secret_scan, op10_bpe, op11_simhash, op12_collocations, op13_resample)}
