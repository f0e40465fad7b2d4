"""Distributed running totals over a global order.

A window ordered over the whole table runs in one task.  Instead:
1. cut the order column into about `buckets` ranges of similar row count
   (approximate quantiles; the boundary list is bounded by `buckets`);
2. sum each bucket (<= buckets rows) and prefix those sums - a window over
   a table of bounded size;
3. broadcast those offsets (bounded) back, and run the ordered window per
   bucket, adding the bucket's offset.
Rows must have distinct order values (aggregate per value first), which
also makes the quantile cut balanced even when many rows share a score.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 50_000
MAX_BUCKETS = 4_096


def _splits(df: DataFrame, col: str, buckets: int) -> list[float]:
    probs = [i / buckets for i in range(1, buckets)]
    qs = df.stat.approxQuantile(col, probs, 1.0 / (4 * buckets)) if buckets > 1 else []
    inner = sorted(set(q for q in qs if q is not None)) or [0.0]  # two buckets at least
    return [float("-inf")] + inner + [float("inf")]


def running_totals(df: DataFrame, order_col: str, sum_cols: list[str],
                   descending: bool = True, buckets: int | None = None) -> DataFrame:
    """Add cum_<c> = sum of c over rows at or before this row in the order
    (descending by default), for each c in sum_cols."""
    if buckets is None:  # follows the rows; the cut list on the driver stays bounded
        buckets = min(MAX_BUCKETS, 1 + df.count() // ROWS_PER_BUCKET)
    splits = _splits(df, order_col, buckets)
    b = Bucketizer(splits=splits, inputCol=order_col, outputCol="_bucket", handleInvalid="keep")
    tagged = b.transform(df.withColumn(order_col, F.col(order_col).cast("double")))
    totals = tagged.groupBy("_bucket").agg(*[F.sum(c).alias("_t_" + c) for c in sum_cols])
    bo = F.desc("_bucket") if descending else F.asc("_bucket")
    # bounded: one row per bucket
    wb = Window.orderBy(bo).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", *[F.coalesce(F.sum("_t_" + c).over(wb), F.lit(0)).alias("_o_" + c)
                                         for c in sum_cols])
    oc = F.desc(order_col) if descending else F.asc(order_col)
    w = Window.partitionBy("_bucket").orderBy(oc).rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.join(F.broadcast(offsets), "_bucket")
    for c in sum_cols:
        out = out.withColumn("cum_" + c, F.sum(c).over(w) + F.col("_o_" + c))
    return out.drop("_bucket", *["_o_" + c for c in sum_cols])
