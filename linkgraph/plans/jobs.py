"""End-to-end jobs (Z1-Z9): each reads its inputs, writes its output under
`out_dir` (parquet, or the reference's text layouts) and returns the
written table, so every stage boundary is a lineage cut on shared storage.

`run` chains them like the production job: candidates, histogram + PCA,
2-hop statistics, training set, model and threshold, recommendations,
hold-out lists, rank evaluation and the run report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linkgraph.config import Params
from linkgraph.operators import candidates as C
from linkgraph.operators import features as FT
from linkgraph.operators import graph as G
from linkgraph.operators import masks as MK
from linkgraph.operators import metrics as MT
from linkgraph.operators import model as ML
from linkgraph.operators import ranking as R
from linkgraph.operators import sampling as S
from linkgraph.operators import twohop as TH
from linkgraph.operators.explore import column_summary, log_degree_hist
from linkgraph.sources import tables as TB
from linkgraph.sources import text as X
from linkgraph.sources.store import drop_stage, without_files, write_bucketed, write_columns


# When True, a stage whose output folder is complete (_SUCCESS present) is
# read instead of recomputed.
REUSE_STAGES = False


def stage_exists(spark: SparkSession, path: str) -> bool:
    """Is `path` a finished Spark output (its _SUCCESS marker exists)?"""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(marker))


def _save(df: DataFrame, path: str, reuse: bool | None = None) -> DataFrame:
    spark = df.sparkSession
    if not ((REUSE_STAGES if reuse is None else reuse) and stage_exists(spark, path)):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


PAIR = ["p1", "p2"]


def _save_pairs(df: DataFrame, path: str) -> DataFrame:
    """`_save` bucketed by the pair, for the tables that meet in a feature vector.
    A stage that is reused is read as plain files and exchanged again; one without
    rows (no pair may have 2-hop statistics) is written as a plain one."""
    if REUSE_STAGES and stage_exists(df.sparkSession, path):
        return df.sparkSession.read.parquet(path)
    out = write_bucketed(df, path, PAIR)
    if without_files(df.sparkSession, path):
        drop_stage(out)
        write_columns(df, path)
        return df.sparkSession.read.parquet(path)
    return out


def _save_counted(df: DataFrame, path: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """`_save`, with the aggregates `counts` as its own write observed them (the
    rows `n` and positives `n1` of a labelled table if none are given); a stage
    that is reused is counted by a job."""
    spark = df.sparkSession
    counts = counts or {"n": F.count(F.lit(1)), "n1": F.sum("label")}
    named = [c.alias(name) for name, c in counts.items()]
    if REUSE_STAGES and stage_exists(spark, path):
        out = spark.read.parquet(path)
        seen = out.agg(*named).first().asDict()
    else:
        observed = Observation()
        out = _save(df.observe(observed, *named), path, reuse=False)
        seen = observed.get
    return out, {name: int(seen[name] or 0) for name in counts}


@dataclass
class Stages:
    edges: DataFrame
    degree: DataFrame
    kept: DataFrame
    lists: DataFrame
    candidates: DataFrame
    labelled: DataFrame
    n_listed: int  # rows of the pairs with a histogram


def candidate_generation(edges: DataFrame, out_dir: str, p: Params) -> Stages:
    """Bands, reversed lists (K1), pair counts with minimum support (K2).

    The one pair explosion of the job happens here; `pair_lists` keeps what the
    later stages need of it (pairs with two common friends or more, or a
    candidate's support if that is less)."""
    edges = _save(edges, f"{out_dir}/edges")
    degree = _save(G.degree(edges), f"{out_dir}/degree")
    kept = _save(G.kept_edges(edges, p, degree), f"{out_dir}/kept")
    TB.write_reversed(G.reverse_adjacency(kept), f"{out_dir}/reversed")
    least = min(2, p.min_support + 1, p.hist_min_support + 1)
    supported = F.col("common_cnt") > p.min_support
    listed = F.when(F.col("common_cnt") > p.hist_min_support, F.col("common_cnt"))
    size = C.pair_explosion_size(kept)
    lists, n = _save_counted(C.pair_lists(kept, least, size), f"{out_dir}/pair_lists",
                             candidates=F.count(F.when(supported, 1)), listed=F.sum(listed))
    cands = lists.where(supported).select("p1", "p2", "common_cnt")
    TB.write_candidates(cands, f"{out_dir}/candidates", p.n_buckets, n["candidates"])
    cands = TB.read_candidates(edges.sparkSession, f"{out_dir}/candidates")
    # candidates' ends are banded users, so the canonical banded edges label them (see views)
    parts, known = C.explosion_partitions(kept, size), C.canonical_edges(G.degree_band(edges, p, degree))
    lab = C.with_degrees(C.label_candidates(cands, known, parts), degree, partitions=parts)
    lab = _save_pairs(lab.withColumn("score", C.jaccard_score()), f"{out_dir}/labelled")
    return Stages(edges, degree, kept, lists, cands, lab, n["listed"])


def mask_histogram(st: Stages, out_dir: str, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Histogram (long form), PCA projection (M1) and per-type shares."""
    # K2: the histogram is written bucketed like the candidates
    TB.write_candidates(MK.mask_pair_hist(st.lists, p.hist_min_support), f"{out_dir}/hist", p.n_buckets, st.n_listed)
    hist = TB.read_candidates(st.edges.sparkSession, f"{out_dir}/hist")
    k = FT.FEATURE_SETS[p.feature_set].pca or p.pca_k
    cells = _save(ML.cell_vectors(hist), f"{out_dir}/hist_cells")
    pca = _save_pairs(ML.fit_pca(cells, k), f"{out_dir}/hist_pca")
    shares = _save_pairs(ML.type_shares(MK.mask_diag_counts(hist), st.candidates, p.divide_type_counts),
                         f"{out_dir}/type_shares")
    return hist, pca, shares


def twohop_job(st: Stages, out_dir: str) -> DataFrame:
    """Z3: 2-hop statistics of every pair, parquet plus the text layout (K4)."""
    lists = st.lists.select("p1", "p2", F.col("common.friend_id").alias("friends"))
    th = _save_pairs(TH.twohop_of_lists(lists, TH.candidate_ratios(st.labelled)), f"{out_dir}/twohop")
    X.write_lines(X.render_twohop(th), f"{out_dir}/twohop_text")
    return th


def feature_vectors(st: Stages, profile: DataFrame, twohop: DataFrame, pca: DataFrame,
                    shares: DataFrame, out_dir: str, p: Params) -> DataFrame:
    """M5 over all candidates, written once (read by fit, metrics, scoring)."""
    attrs = FT.user_attributes(st.degree, profile)
    ft = _save_pairs(FT.feature_table(st.labelled, attrs, twohop, p.count_unknown_sex), f"{out_dir}/features")
    fs = FT.FEATURE_SETS[p.feature_set]
    bits = MK.edge_mask_bits(st.candidates, G.positives(st.edges, with_mask=True)) if fs.edge_bits else None
    return _save(ML.feature_set_vectors(ft, fs, pca, shares, bits), f"{out_dir}/vectors")


@dataclass
class Trained:
    """Z4 + Z5: the stored model and what the run report says of it."""
    model: PipelineModel
    train: DataFrame
    auc: float | None
    threshold: float
    positives: int
    negatives: int
    valid_rows: int
    iterations: int
    converged: bool


def train_and_threshold(vectors: DataFrame, out_dir: str, p: Params) -> Trained:
    """Z4 + Z5: sample and split, fit scaler + LR on the training part,
    AUC and the F-beta threshold on the validation part, class balance (A11)."""
    train, valid = S.train_valid(vectors, p)
    train, n = _save_counted(train, f"{out_dir}/train")
    model = ML.fit(train, p.max_iter, p.fit_intercept, n["n"], f"{out_dir}/model")  # K7
    vs, n_valid = _save_counted(ML.score(model, valid), f"{out_dir}/valid_scores")
    # K6: (prediction, label) of training (1 file) and validation (4 files)
    for part, df, files in (("training", ML.score(model, train), 1), ("validation", vs, 4)):
        TB.write_prediction_labels(df.select(F.col("score").alias("prediction"), "label"),
                                   f"{out_dir}/Model_fin/{part}", files)
    curve = MT.roc_curve(vs)
    auc = MT.auc_from_curve(curve).first()["auc"]
    best = MT.best_threshold(MT.fbeta_by_threshold(curve, p.beta)).first()
    used, converged = ML.solver_state(model, p.max_iter)
    return Trained(model, train, auc, best["threshold"], n["n1"], n["n"] - n["n1"], n_valid["n"], used, converged)


def recommend(vectors: DataFrame, model, threshold: float, out_dir: str, p: Params) -> DataFrame:
    """Test-group pairs that are not known edges, scored once, both
    directions (K5), target users, top-k, ranked text lists (K3)."""
    pop = vectors.where(S.test_group(p) & (F.col("label") == 0))
    scored = _save(ML.score(model, pop), f"{out_dir}/test_scores")
    directed = R.flip_scores(scored)
    TB.write_probabilities(directed, f"{out_dir}/prediction_proba")
    ranked = R.top_k(R.target_users(directed, p, residue=p.test_residue, threshold=threshold), p.top_k)
    ranked = _save(ranked, f"{out_dir}/prediction_ranked")
    # K6: (prediction, label) of the test group (8 files)
    TB.write_prediction_labels(scored.select(F.col("score").alias("prediction"), "label"),
                               f"{out_dir}/Model_fin/test", 8)
    X.write_lines(R.ranked_lines(ranked).select(F.col("line").alias("value")), f"{out_dir}/prediction")
    return ranked


def holdout_build(vectors: DataFrame, train: DataFrame, model, threshold: float, out_dir: str,
                  p: Params) -> tuple[DataFrame, dict[str, int]]:
    """Hold-out group minus training pairs, positives thinned; truth
    (K8), directed probabilities (K5) and ranked lists (K3) cut at the fitted
    threshold."""
    hold, n = _save_counted(S.thin_positives(S.holdout(vectors, train, p), p), f"{out_dir}/holdout")
    X.write_lines(X.render_pairs(hold.where(F.col("label") == 1).select("p1", "p2")),
                  f"{out_dir}/validPrediction_real")
    directed = R.flip_scores(ML.score(model, hold))
    TB.write_probabilities(directed, f"{out_dir}/validPrediction_proba")
    proba = TB.read_probabilities(hold.sparkSession, f"{out_dir}/validPrediction_proba")
    ranked = R.top_k(R.target_users(proba, p, threshold=threshold), p.top_k)
    X.write_lines(R.ranked_lines(ranked).select(F.col("line").alias("value")), f"{out_dir}/validPrediction")
    return hold, n


def offline_lists(spark: SparkSession, proba_path: str, p: Params, residue: int | None = None) -> DataFrame:
    """Ranked lists of the offline evaluation, from stored probabilities at the
    offline threshold (0.0): of hold-out users, or with `residue` of that group."""
    proba = TB.read_probabilities(spark, proba_path)
    users = R.target_users(proba, p, threshold=p.threshold) if residue is None else \
        R.target_users(proba, p, residue=residue, threshold=p.threshold)
    return R.top_k(users, p.top_k)


def rank_evaluation(spark: SparkSession, out_dir: str, p: Params) -> DataFrame:
    """Read the probabilities (S13) and the hidden edges (S15) back, rank
    (W1), write the test group's offline lists (K3) and compute NDCG (A10)."""
    test = offline_lists(spark, f"{out_dir}/prediction_proba", p, p.test_residue)
    X.write_lines(R.ranked_lines(test).select(F.col("line").alias("value")), f"{out_dir}/prediction_offline")
    truth = MT.hidden_neighbours(X.parse_pairs(spark.read.text(f"{out_dir}/validPrediction_real")))
    return MT.ndcg(offline_lists(spark, f"{out_dir}/validPrediction_proba", p), truth)


def exploration(edges: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Degree, its log histogram, profile summary."""
    deg = G.degree(edges)
    cols = [c for c in ("create_date", "birth_date", "gender", "country_id", "location_id", "login_region")
            if c in profile.columns]
    return deg, log_degree_hist(deg), column_summary(profile, cols)


def run(spark: SparkSession, edges: DataFrame, profile: DataFrame, out_dir: str,
        p: Params = Params(), rejects: DataFrame | None = None) -> DataFrame:
    """The production chain; returns the one-row run report (K9), whose counts come
    from the stages' own writes (`Observation`): the class
    balance (A11), split and hold-out sizes (A12), AUC, threshold, NDCG, the
    solver's cap, iterations and convergence, and how many input items the
    readers rejected (`rejects`: the row of `text.adjacency_rejects`, if the
    edges came from text)."""
    st = candidate_generation(edges, out_dir, p)
    _, pca, shares = mask_histogram(st, out_dir, p)
    th = twohop_job(st, out_dir)
    vectors = feature_vectors(st, profile, th, pca, shares, out_dir, p)
    t = train_and_threshold(vectors, out_dir, p)
    recommend(vectors, t.model, t.threshold, out_dir, p)
    _, hold = holdout_build(vectors, t.train, t.model, t.threshold, out_dir, p)
    nd = rank_evaluation(spark, out_dir, p).first()
    rows = t.positives + t.negatives
    tot = max(1, rows)
    rejected = int(rejects.first()["rejected_items"]) if rejects is not None else 0
    report = spark.createDataFrame([(
        FT.FEATURE_SETS[p.feature_set].pca, float(p.row_sample_rate), float(t.auc) if t.auc is not None else None,
        t.positives, t.negatives, t.positives / tot, t.negatives / tot, float(t.threshold),
        hold["n"], hold["n1"], nd["ndcg_x1000"], rows, t.valid_rows, p.max_iter, t.iterations, t.converged, rejected)],
        "pca_size INT, sample_filter DOUBLE, auc DOUBLE, positives BIGINT, negatives BIGINT, "
        "positive_share DOUBLE, negative_share DOUBLE, threshold DOUBLE, holdout_rows BIGINT, "
        "holdout_positives BIGINT, ndcg_x1000 DOUBLE, train_rows BIGINT, valid_rows BIGINT, "
        "max_iter INT, iterations INT, converged BOOLEAN, rejected_items BIGINT")
    TB.append_report(report, f"{out_dir}/report")
    return spark.read.parquet(f"{out_dir}/report")
