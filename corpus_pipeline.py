"""A training-corpus pipeline: five stages, each by one operator of linkgraph.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; `run` writes each stage's result as Parquet and reads it again.  Empty
tables, nulls, repeated rows and extra columns are treated as the operators'
docstrings say.

1. quality: documents whose line field scores below the decision go.
2. near_duplicates: one document (the smallest doc_id) of each group of word
   5-gram Jaccard similarity of at least 0.8 stays.
3. substring_dedup: words in 35-word windows that occur more than once go; the
   text of such a document becomes its kept words, joined by one space.
4. decontamination: documents with an occurrence of a 10-word window of a
   benchmark item (or a whole shorter item) go.
5. mixing: each document is repeated as its source's target weight asks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.llm import fmindex, jaccard, mixing, quality, wumanber
from linkgraph.llm.folds import remainder
from linkgraph.sources.store import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    train = remainder(F.col("doc_id"), 4) != 2
    model = quality.learn(docs.select("doc_id", "text").where(train), labels.where(train))
    return quality.keep_good(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, width=5, threshold=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fmindex.without_repeats(docs, window=35)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return wumanber.decontaminate(docs, items, width=10)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(mixing.plan(docs))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

# The line field of the first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
