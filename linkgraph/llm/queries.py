"""The registered queries: each applies one operator to its whole table and
derives the digest columns from the operator's result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.llm import (audit, doubling, fmindex, jaccard, langid, lm, mixing, packing, quality, resample, toxicity,
                           vectors, wumanber)
from linkgraph.llm.folds import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = wumanber.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit",
                        F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op1_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = lm.learn(docs.where(remainder(F.col("doc_id"), 10) != 0))
    out = lm.score(docs, model, counts)
    return out.select(F.col("row.doc_id").alias("doc_id"),
                      (remainder(F.col("row.doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known",
                      F.lit(model.vocab.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


@query
def op2_substring_dedup(spark, sf_dir):
    return fmindex.per_document(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    train = remainder(F.col("doc_id"), 5) != 0
    model = toxicity.learn(docs.where(train), labels.where(train))
    out = toxicity.score(docs, model).select("row.doc_id", "score")
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_embedding_near_dup(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = langid.learn(docs.where(remainder(F.col("doc_id"), 5) != 0))
    out = langid.predict(docs.select("doc_id", "text"), dictionaries)
    return out.select(F.col("row.doc_id").alias("doc_id"),
                      (remainder(F.col("row.doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    train = remainder(F.col("doc_id"), 4) != 2
    model = quality.learn(docs.where(train), labels.where(train))
    out = quality.score(docs, model).select("row.doc_id", "score")
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= quality.DECISION).cast("int").alias("predicted"))


@query
def op10_jaccard_join(spark, sf_dir):
    return jaccard.joined(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, threshold=85)


@query
def op9_suffix_array_dedup(spark, sf_dir):
    return doubling.per_document(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_filter_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit.audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")).drop("filter")


def tokenizer_file() -> str:
    """The path of the public tokenizer that op12 names; `packing` takes any."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op12_best_fit_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())


@query
def op13_importance_resampling(spark, sf_dir):
    out = resample.resample(table(spark, sf_dir, "documents").select("doc_id", "text"),
                            table(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
