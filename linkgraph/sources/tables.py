"""Parquet layouts of the pipeline's stage tables (S6-S11, S13, S17, K1, K2,
K5-K7, K9).  Columns are named, so scans prune columns and push filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.sources.store import without_files, write_columns


def with_bucket(pairs: DataFrame, n_buckets: int = 107) -> DataFrame:
    """The reference computed pairs in `n_buckets` passes keyed by
    p1 % n_buckets; the pass number survives as a partition column."""
    return pairs.withColumn("bucket", (F.col("p1") % n_buckets).cast("int"))


# Rows below which a bucketed table is written by one task per core.
SMALL_TABLE = 10_000_000


def write_candidates(pairs: DataFrame, path: str, n_buckets: int = 107, rows: int | None = None) -> None:
    """K2: candidates (or histograms) partitioned by bucket.  The rebalance
    hint lets AQE split an oversized bucket over several writers instead of
    sending a whole bucket to one task; of a table known to be small it would
    make one task that writes all buckets, so that one is dealt out by bucket.  A
    table without rows has no bucket to write and leaves its columns only."""
    out = with_bucket(pairs, n_buckets)
    if rows is not None and rows <= SMALL_TABLE:
        out = out.repartition(pairs.sparkSession.sparkContext.defaultParallelism, "bucket")
    else:
        out = out.hint("rebalance", "bucket")
    out.write.mode("overwrite").partitionBy("bucket").parquet(path)
    if without_files(out.sparkSession, path):
        write_columns(out, path)


def read_candidates(spark: SparkSession, path: str, bucket: int | None = None) -> DataFrame:
    """The whole table, or one bucket through partition pruning."""
    df = spark.read.parquet(path)
    if bucket is not None:
        df = df.where(F.col("bucket") == bucket)
    return df.drop("bucket")


def write_reversed(adjacency: DataFrame, path: str) -> None:
    """K1: reversed lists (friend_id, users ARRAY<...>), plain or with masks."""
    adjacency.write.mode("overwrite").parquet(path)


def read_reversed(spark: SparkSession, path: str) -> DataFrame:
    """Reversed lists back to long rows (friend_id, user_id[, mask])."""
    df = spark.read.parquet(path)
    elem = df.schema["users"].dataType.elementType
    if hasattr(elem, "fields"):  # ARRAY<STRUCT<user_id, mask>>
        return df.select("friend_id", F.inline("users"))
    return df.select("friend_id", F.explode("users").alias("user_id"))


def read_hist_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Histogram vectors (p1, p2, hist ARRAY<DOUBLE>) from the
    named layout (p1, p2, hist) or the older one (_1 STRUCT<_1,_2>, _2 ARRAY)."""
    df = spark.read.parquet(path)
    if "_1" in df.columns:
        return df.select(F.col("_1._1").cast("bigint").alias("p1"), F.col("_1._2").cast("bigint").alias("p2"),
                         F.col("_2").cast("array<double>").alias("hist"))
    return df.select("p1", "p2", F.col("hist").cast("array<double>").alias("hist"))


def write_hist_vectors(vectors: DataFrame, path: str, older: bool = False) -> None:
    """Histogram vectors in the named or the older layout."""
    if older:
        vectors = vectors.select(F.struct(F.col("p1").alias("_1"), F.col("p2").alias("_2")).alias("_1"),
                                 F.col("hist").alias("_2"))
    vectors.write.mode("overwrite").parquet(path)


def write_probabilities(scores: DataFrame, path: str) -> None:
    """K5: directed probabilities (person1, person2, proba)."""
    (scores.select(F.col("user_id").alias("person1"), F.col("candidate_id").alias("person2"),
                   F.col("score").alias("proba"))
     .write.mode("overwrite").parquet(path))


def read_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, candidate_id, score)."""
    return spark.read.parquet(path).select(F.col("person1").alias("user_id"),
                                           F.col("person2").alias("candidate_id"),
                                           F.col("proba").alias("score"))


def write_prediction_labels(df: DataFrame, path: str, files: int) -> None:
    """K6: (prediction, label) pairs with a fixed number of files.  The rows are
    dealt out after scoring, which keeps its own parallelism."""
    df.select("prediction", "label").repartition(files).write.mode("overwrite").parquet(path)


def append_report(report: DataFrame, path: str) -> None:
    """K9: one row per run, appended."""
    report.coalesce(1).write.mode("append").parquet(path)


def preview(df: DataFrame, n: int = 50, order: list[str] | None = None) -> DataFrame:
    """The first n rows in an explicit order (top-n per partition,
    then a merge of n rows per partition: TakeOrderedAndProject)."""
    order = order or df.columns
    return df.orderBy(*order).limit(n)
