"""Evaluation metrics.

Curves aggregate per distinct score first (partial aggregation), then take
running totals with the bucketed prefix sum of `prefix`, so no step sorts
the whole score table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.operators.prefix import running_totals
from linkgraph.sources.store import materialize


def score_counts(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Per distinct score: positives and negatives."""
    return (scored.groupBy(F.col(score).cast("double").alias("threshold"))
            .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
                 F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("bigint").alias("neg")))


def _totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))


def roc_curve(scored: DataFrame, score: str = "score", label: str = "label",
              buckets: int | None = None) -> DataFrame:
    """Per distinct threshold (descending) the cumulative tp / fp and the
    rates.  The per-score counts are written once: the cuts, the totals and
    the curve itself all read them.  Totals P and N enter as scalar subqueries."""
    counts = materialize(score_counts(scored, score, label), "score-counts")
    cum = running_totals(counts, "threshold", ["pos", "neg"], descending=True, buckets=buckets)
    tot = _totals(counts)
    P, N = tot.select("P").scalar(), tot.select("N").scalar()
    return cum.select("threshold", "pos", "neg",
                      F.col("cum_pos").cast("bigint").alias("tp"),
                      F.col("cum_neg").cast("bigint").alias("fp"),
                      F.round(F.try_divide(F.col("cum_pos").cast("double"), P.cast("double")), 6).alias("tpr"),
                      F.round(F.try_divide(F.col("cum_neg").cast("double"), N.cast("double")), 6).alias("fpr"))


def auc_from_curve(curve: DataFrame) -> DataFrame:
    """Exact trapezoid area under the ROC curve (ties count one half):
    sum(neg * (tp - pos/2)) / (P * N).  One aggregate, one row."""
    return curve.agg(F.round(
        F.sum(F.col("neg").cast("double") * (F.col("tp").cast("double") - F.col("pos") / 2.0))
        / (F.sum("pos").cast("double") * F.sum("neg").cast("double")), 6).alias("auc"))


def auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return auc_from_curve(roc_curve(scored, score, label))


def fbeta_by_threshold(curve: DataFrame, beta: float = 2.0) -> DataFrame:
    """Precision, recall and F-beta at each threshold, with Spark ML's
    conventions (precision 1 when nothing is predicted, F 0 when p + r = 0)."""
    P = curve.agg(F.sum("pos")).scalar()
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    prec = F.when(tp + fp == 0, F.lit(1.0)).otherwise(tp / (tp + fp))
    rec = F.when(P == 0, F.lit(0.0)).otherwise(tp / P.cast("double"))
    b2 = beta * beta
    f = F.when(prec + rec == 0, F.lit(0.0)).otherwise((1 + b2) * prec * rec / (b2 * prec + rec))
    return curve.select("threshold", prec.alias("precision"), rec.alias("recall"), f.alias("fbeta"))


def best_threshold(fb: DataFrame) -> DataFrame:
    """A14 + O5: arg-max F-beta; on a tie the highest threshold wins (the
    reference's stable sort over descending thresholds).  orderBy + limit(1)
    plans as TakeOrderedAndProject: each partition keeps one row."""
    return (fb.orderBy(F.desc("fbeta"), F.desc("threshold")).limit(1)
            .select("threshold", F.round("fbeta", 6).alias("fbeta")))


def roc_binned(scored: DataFrame, bins: int = 100, score: str = "score",
               label: str = "label") -> DataFrame:
    """Thresholds binned to `bins` steps of the score; cumulative counts
    from the top bin down (a window over at most bins + 1 rows)."""
    per = (scored.groupBy(F.floor(F.col(score) * bins).cast("int").alias("bin"))
           .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
                F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("bigint").alias("neg")))
    w = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return per.select("bin", "pos", "neg",
                      F.sum("pos").over(w).cast("bigint").alias("tp"),
                      F.sum("neg").over(w).cast("bigint").alias("fp"))


def roc_grouped(scored: DataFrame, groups: int = 100, score: str = "score", label: str = "label") -> DataFrame:
    """A15 as the library call has it: the distinct scores, highest first, in
    about `groups` runs of equal length; a run's threshold is its first score.

    The place of a score is a running total of ones over the written per-score
    counts; the curve is a window over the runs (groups + 1 rows at most)."""
    counts = materialize(score_counts(scored, score, label), "score-counts")
    size = max(1, counts.count() // groups)
    placed = running_totals(counts.withColumn("one", F.lit(1)), "threshold", ["one"], descending=True)
    run = F.floor((F.col("cum_one") - 1) / F.lit(size)).cast("int")
    per = placed.groupBy(run.alias("run")).agg(F.max("threshold").alias("threshold"), F.sum("pos").alias("pos"),
                                               F.sum("neg").alias("neg"))
    w = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("run", "threshold", "pos", "neg", F.sum("pos").over(w).cast("bigint").alias("tp"),
                      F.sum("neg").over(w).cast("bigint").alias("fp"))


def class_balance(train: DataFrame, label: str = "label") -> DataFrame:
    """Count and share of each label in the training part."""
    c = train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n")).scalar()
    return c.select("label", "n", F.round(F.col("n") / total.cast("double"), 6).alias("share"))


def hidden_neighbours(truth_pairs: DataFrame) -> DataFrame:
    """A9 + U1: hidden neighbours of each user from both directions, long
    form (user_id, neighbour_id); never collected per user."""
    both = F.explode(F.array(
        F.struct(F.col("p1").alias("user_id"), F.col("p2").alias("neighbour_id")),
        F.struct(F.col("p2").alias("user_id"), F.col("p1").alias("neighbour_id"))))
    # pairs are unique with p1 < p2, so the two directions never collide
    return truth_pairs.select(both.alias("_e")).select("_e.*")


IDCG_CHUNK = 4096


def ideal_dcg(n_truth: DataFrame) -> DataFrame:
    """Ideal DCG of |truth| ones, sum_{i=1..n} 1/log2(i + 1), per user.

    The ideal is not capped at the list length (as in the reference), so n
    is unbounded; the sum is cut into chunks of IDCG_CHUNK terms, one row per
    chunk, spread over partitions and summed with a partial aggregate."""
    c = IDCG_CHUNK
    chunks = n_truth.select("user_id", "n_truth", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("n_truth") - 1) / c).cast("int"))).alias("_k"))
    part = F.aggregate(F.sequence(F.col("_k") * c + 1, F.least(F.col("n_truth"), (F.col("_k") + 1) * c)
                                  .cast("int")),
                       F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
    return (chunks.repartition("user_id", "_k").select("user_id", part.alias("_s"))
            .groupBy("user_id").agg(F.sum("_s").alias("idcg")))


def ndcg(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """A10 + J15: per user DCG of the ranked list (gain 1 on a hidden
    neighbour, discount log2(rank + 1)) over the ideal DCG of |truth| ones;
    total = sum over users / number of users with truth * 1000.  Users with
    truth but no list score 0; lists without truth add nothing."""
    hits = (ranked.select("user_id", F.col("candidate_id").alias("neighbour_id"), "rank")
            .join(truth, ["user_id", "neighbour_id"]))
    dcg = hits.groupBy("user_id").agg(F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    n = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_truth"))
    per_user = (n.join(ideal_dcg(n), "user_id").join(dcg, "user_id", "left")
                .select("user_id", (F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"))
                .where(~F.isnan("ndcg")))  # P14 (cannot happen: idcg > 0)
    return per_user.agg(F.round(F.sum("ndcg") / F.count(F.lit(1)) * 1000.0, 6).alias("ndcg_x1000"),
                        F.count(F.lit(1)).alias("truth_users"))
