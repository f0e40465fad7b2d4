"""Exploration of the graph and the profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count of non-NULL values, mean, sample stddev, min, max of each
    column, as long rows (one pass: explode to (column, value), then a
    partial+final aggregate per column)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("_c")).select("_c.*")
    return long.groupBy("column_name").agg(
        F.count("value").alias("n"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_samp("value"), 6).alias("stddev"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"))


def log_degree_hist(degree: DataFrame, width: float = 0.5) -> DataFrame:
    """Histogram of ln(degree) with bins of `width`."""
    b = F.floor(F.log(F.col("deg").cast("double")) / F.lit(width)).cast("int")
    return (degree.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (F.col("bin").cast("double") * F.lit(width)).alias("bin_start"), "n"))
