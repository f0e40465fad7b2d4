"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query derives the graph from the raw test tables through the library
operators (no SQL text on the Spark side) and runs over whole tables.
Column names and types match the oracle SQL of `plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.operators import graph as G
from linkgraph.operators import ranking as R
from linkgraph.plans.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---- graph -------------------------------------------------------------------
@query
def user_degree(spark, sf_dir):
    return Views(spark, sf_dir).degree


@query
def distinct_users(spark, sf_dir):
    return G.distinct_users(Views(spark, sf_dir).edges)


@query
def degree_band(spark, sf_dir):
    v = Views(spark, sf_dir)
    return G.degree_band(v.edges, v.p, v.degree).select("user_id", "friend_id", "mask")


@query
def reverse_edges(spark, sf_dir):
    v = Views(spark, sf_dir)
    return G.reverse_edges(G.degree_band(v.edges, v.p, v.degree))


@query
def reverse_band(spark, sf_dir):
    return Views(spark, sf_dir).kept.select("user_id", "friend_id", "mask")


@query
def reverse_adjacency(spark, sf_dir):
    adj = G.reverse_adjacency(Views(spark, sf_dir).kept)
    return adj.select("friend_id", F.size("users").cast("bigint").alias("n_users"),
                      F.array_join(F.col("users").cast("array<string>"), ",").alias("users"))


@query
def positives(spark, sf_dir):
    return Views(spark, sf_dir).positives


# ---- candidates ----------------------------------------------------------------
@query
def common_friends(spark, sf_dir):
    return Views(spark, sf_dir).candidates


@query
def label_candidates(spark, sf_dir):
    return Views(spark, sf_dir).labelled.select("p1", "p2", "common_cnt", "label")


def _score_population(v: Views) -> DataFrame:
    """P6 + P11: test-group pairs that are not known edges."""
    m, r = v.p.modulus, v.p.test_residue
    return (v.labelled.where(((F.col("p1") % m) == r) | ((F.col("p2") % m) == r))
            .where(F.col("label") == 0).select("p1", "p2", "score"))


@query
def score_population(spark, sf_dir):
    return _score_population(Views(spark, sf_dir))


# ---- ranking -------------------------------------------------------------------
@query
def flip_scores(spark, sf_dir):
    return R.flip_scores(_score_population(Views(spark, sf_dir)))


def _topk(v: Views) -> DataFrame:
    directed = R.target_users(R.flip_scores(_score_population(v)), v.p, residue=v.p.test_residue)
    return R.top_k(directed, v.p.top_k).select("user_id", "rank", "candidate_id", "score")


@query
def topk_recommend(spark, sf_dir):
    return _topk(Views(spark, sf_dir))


# ---- candidates (cont.) ------------------------------------------------------
@query
def common_friend_ids(spark, sf_dir):
    from linkgraph.operators.candidates import common_friend_ids as cfi
    v = Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {'candidates'})
    out = cfi(v.pairs, v.candidates, v.partitions)
    return out.select("p1", "p2", F.size("friend_ids").cast("bigint").alias("n_common"),
                      F.array_join(F.col("friend_ids").cast("array<string>"), ",").alias("friend_ids"))


@query
def candidate_ratios(spark, sf_dir):
    return Views(spark, sf_dir).ratios


# ---- features -------------------------------------------------------------------
@query
def degree_features(spark, sf_dir):
    from linkgraph.operators.candidates import with_degrees
    from linkgraph.operators.features import degree_feature_cols
    v = Views(spark, sf_dir)
    j = with_degrees(v.candidates, v.degree, "left")
    return j.select("p1", "p2", "common_cnt", "deg1", "deg2", *degree_feature_cols().values())


@query
def profile_features(spark, sf_dir):
    from linkgraph.operators.features import attach_users, profile_feature_cols
    v = Views(spark, sf_dir)
    j = attach_users(v.candidates.select("p1", "p2"), v.attrs)
    return j.select("p1", "p2", *profile_feature_cols(v.p.count_unknown_sex))


@query
def feature_table(spark, sf_dir):
    return Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {'candidates', 'labelled'}).features


# ---- masks ----------------------------------------------------------------------
@query
def mask_to_bits(spark, sf_dir):
    from linkgraph.functions.masks import mask_bits_string
    e = Views(spark, sf_dir).edges
    return e.select("mask").distinct().select("mask", mask_bits_string("mask").alias("bits"))


@query
def mask_positions(spark, sf_dir):
    from linkgraph.functions.masks import mask_positions as mp
    e = Views(spark, sf_dir).edges
    return e.select("mask").distinct().select(
        "mask", F.array_join(mp("mask").cast("array<string>"), ",").alias("positions"))


@query
def mask_pair_cells(spark, sf_dir):
    from linkgraph.functions.masks import pair_cells
    pm = Views(spark, sf_dir).pairs_masked
    combos = pm.select("mask1", "mask2").distinct()
    return combos.select("mask1", "mask2", F.array_join(
        F.array_sort(pair_cells("mask1", "mask2")).cast("array<string>"), ",").alias("cells"))


@query
def mask_pair_hist(spark, sf_dir):
    return Views(spark, sf_dir).hist


@query
def mask_diag_counts(spark, sf_dir):
    from linkgraph.operators.masks import mask_diag_counts as mdc
    return mdc(Views(spark, sf_dir).hist)


@query
def edge_mask_bits(spark, sf_dir):
    from linkgraph.operators.masks import edge_mask_bits as emb
    v = Views(spark, sf_dir)
    return emb(v.candidates, G.positives(v.edges, with_mask=True))


# ---- 2-hop ------------------------------------------------------------------------
@query
def twohop_stats(spark, sf_dir):
    return Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {'candidates', 'labelled'}).twohop


@query
def twohop_all_pairs(spark, sf_dir):
    return Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {'candidates', 'labelled'}).twohop_all


# ---- groups, samples, splits -----------------------------------------------------
def _lab(v: Views) -> DataFrame:
    return v.labels.select("p1", "p2", "label")


@query
def train_group(spark, sf_dir):
    from linkgraph.operators.sampling import train_group as tg
    v = Views(spark, sf_dir)
    return _lab(v).where(tg(v.p))


@query
def test_group(spark, sf_dir):
    from linkgraph.operators.sampling import test_group as tg
    v = Views(spark, sf_dir)
    return _lab(v).where(tg(v.p))


@query
def holdout_group(spark, sf_dir):
    from linkgraph.operators.sampling import holdout_group as hg
    v = Views(spark, sf_dir)
    return _lab(v).where(hg(v.p))


@query
def holdout_anti(spark, sf_dir):
    from linkgraph.operators.sampling import holdout, train_valid
    v = Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {'labels'})
    return holdout(_lab(v), train_valid(_lab(v), v.p)[0], v.p)


@query
def holdout_thinning(spark, sf_dir):
    return Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {'labelled'}).holdout.select("p1", "p2", "label")


@query
def stratified_sample(spark, sf_dir):
    from linkgraph.operators.sampling import stratified_sample as ss
    v = Views(spark, sf_dir)
    return ss(_lab(v), v.p)


@query
def bernoulli_sample(spark, sf_dir):
    from linkgraph.operators.sampling import bernoulli_sample as bs
    v = Views(spark, sf_dir)
    return bs(_lab(v), v.p)


@query
def train_valid_split(spark, sf_dir):
    from linkgraph.operators.sampling import split_flag, training_data
    v = Views(spark, sf_dir)
    d = training_data(_lab(v), v.p)
    return d.select("p1", "p2", "label",
                    F.when(split_flag(v.p), "train").otherwise("valid").alias("part"))


@query
def class_balance(spark, sf_dir):
    from linkgraph.operators.metrics import class_balance as cb
    return cb(Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {'labelled'}).train)


# ---- metrics ----------------------------------------------------------------------
# The per-score counts are the only reader of the labelled pairs and are written themselves: without a
# stage below them the draws of the sample reach the pairs before degrees are joined.
@query
def roc_curve(spark, sf_dir):
    from linkgraph.operators.metrics import roc_curve as rc
    return rc(Views(spark, sf_dir).valid)


@query
def roc_binned(spark, sf_dir):
    from linkgraph.operators.metrics import roc_binned as rb
    return rb(Views(spark, sf_dir).valid)


@query
def auc(spark, sf_dir):
    from linkgraph.operators.metrics import auc as a
    return a(Views(spark, sf_dir).valid)


@query
def fbeta_by_threshold(spark, sf_dir):
    from linkgraph.operators.metrics import fbeta_by_threshold as fb
    from linkgraph.operators.metrics import roc_curve as rc
    v = Views(spark, sf_dir)
    out = fb(rc(v.valid), v.p.beta)
    return out.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fbeta")])


@query
def best_threshold(spark, sf_dir):
    from linkgraph.operators.metrics import best_threshold as bt
    from linkgraph.operators.metrics import fbeta_by_threshold as fb
    from linkgraph.operators.metrics import roc_curve as rc
    v = Views(spark, sf_dir)
    return bt(fb(rc(v.valid), v.p.beta))


@query
def hidden_neighbours(spark, sf_dir):
    from linkgraph.operators.metrics import hidden_neighbours as hn
    h = Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {'labelled'}).holdout
    return hn(h.where(F.col("label") == 1))


def _holdout_ranked(v: Views) -> DataFrame:
    directed = R.target_users(R.flip_scores(v.holdout), v.p)
    return R.top_k(directed, v.p.top_k)


@query
def ndcg(spark, sf_dir):
    from linkgraph.operators.metrics import hidden_neighbours as hn
    from linkgraph.operators.metrics import ndcg as nd
    v = Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {'labelled'})
    return nd(_holdout_ranked(v), hn(v.holdout.where(F.col("label") == 1)))


# ---- sources and sinks: native layouts, written and read back ------------------------
@query
def edges_from_adjacency(spark, sf_dir):
    from linkgraph.sources import text as X
    lines = X.roundtrip(X.render_adjacency(Views(spark, sf_dir).edges), "adjacency")
    return X.parse_adjacency(lines)


@query
def demography_roundtrip(spark, sf_dir):
    from linkgraph.sources import text as X
    from linkgraph.sources.store import stage_path
    prof = Views(spark, sf_dir).profile
    path = stage_path(prof, "demography")
    X.write_lines(X.render_demography(prof), path, gzip=False)
    return X.read_demography(spark, path).select("user_id", "birth_date", "gender", "location_id",
                                                 "login_region")


@query
def candidates_scan(spark, sf_dir):
    from linkgraph.sources import tables as TB
    from linkgraph.sources.store import stage_path
    v = Views(spark, sf_dir)
    path = stage_path(v.candidates, "candidates_by_bucket")
    TB.write_candidates(v.candidates, path, v.p.n_buckets)
    return TB.read_candidates(spark, path)


@query
def candidates_bucket(spark, sf_dir):
    from linkgraph.sources import tables as TB
    from linkgraph.sources.store import stage_path
    v = Views(spark, sf_dir)
    path = stage_path(v.candidates, "candidates_by_bucket")
    TB.write_candidates(v.candidates, path, v.p.n_buckets)
    return TB.read_candidates(spark, path, bucket=33)


@query
def reversed_lists_roundtrip(spark, sf_dir):
    from linkgraph.sources import tables as TB
    from linkgraph.sources.store import stage_path
    adj = G.reverse_adjacency(Views(spark, sf_dir).kept, with_masks=True)
    path = stage_path(adj, "reversed_masks")
    TB.write_reversed(adj, path)
    return TB.read_reversed(spark, path).select("user_id", "friend_id", "mask")


@query
def table_preview(spark, sf_dir):
    from linkgraph.sources.tables import preview
    return preview(Views(spark, sf_dir).edges, 50, ["user_id", "friend_id"])


@query
def profile_summary(spark, sf_dir):
    from linkgraph.operators.explore import column_summary
    return column_summary(Views(spark, sf_dir).profile,
                          ["birth_date", "gender", "location_id", "login_region"])


@query
def log_degree_hist(spark, sf_dir):
    from linkgraph.operators.explore import log_degree_hist as ldh
    return ldh(Views(spark, sf_dir).degree)


@query
def ranked_list_text(spark, sf_dir):
    return R.ranked_lines(_topk(Views(spark, sf_dir)))


@query
def ranked_list_parse(spark, sf_dir):
    from linkgraph.sources import text as X
    lines = R.ranked_lines(_topk(Views(spark, sf_dir))).select(F.col("line").alias("value"))
    return X.parse_ranked_lists(X.roundtrip(lines, "ranked"))


@query
def twohop_text_roundtrip(spark, sf_dir):
    from linkgraph.sources import text as X
    v = Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {"candidates", "labelled"})
    return X.parse_twohop(X.roundtrip(X.render_twohop(v.twohop_all), "twohop"))


@query
def hidden_edges_text(spark, sf_dir):
    from linkgraph.sources import text as X
    v = Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {"labelled"})
    truth = v.holdout.where(F.col("label") == 1).select("p1", "p2")
    return X.parse_pairs(X.roundtrip(X.render_pairs(truth), "hidden"))


@query
def probabilities_roundtrip(spark, sf_dir):
    from linkgraph.sources import tables as TB
    from linkgraph.sources.store import stage_path
    scores = R.flip_scores(_score_population(Views(spark, sf_dir)))
    path = stage_path(scores, "proba")
    TB.write_probabilities(scores, path)
    return TB.read_probabilities(spark, path)


# ---- ML ---------------------------------------------------------------------------------
# the histogram feeds the PCA fit, the projection and the type shares; the pair-keyed
# tables are bucketed by the pair
ML_STAGES = Views.DEFAULT_STAGES | {"candidates", "hist", "pairs"}


@query
def scaled_features(spark, sf_dir):
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from linkgraph.operators.features import FEATURE_COLS, feature_table
    from linkgraph.operators.twohop import twohop_stats
    from linkgraph.sources.store import materialize
    v = Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {"candidates", "labelled"})
    # features are made of the training pairs only, from the statistics of all candidates, and written for the
    # fit and the result
    train = materialize(v.train, "train")
    twohop = twohop_stats(v.pairs, v.ratios, train, v.partitions)
    train = materialize(feature_table(train, v.attrs, twohop, v.p.count_unknown_sex), "train_features")
    vec = VectorAssembler(inputCols=FEATURE_COLS, outputCol="x").transform(train)
    sc = StandardScaler(inputCol="x", outputCol="xs", withStd=True, withMean=False).fit(vec)
    out = sc.transform(vec).select("p1", "p2", vector_to_array("xs").alias("_a"))
    return out.select("p1", "p2", *[F.round(F.col("_a").getItem(i), 6).alias(c)
                                    for i, c in enumerate(FEATURE_COLS)])


@query
def feature_vector(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    v = Views(spark, sf_dir, stages=ML_STAGES)
    return v.vectors.select("p1", "p2", "label", vector_to_array("features").alias("features"))


@query
def mask_pca(spark, sf_dir):
    return Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {"hist"}).pca


@query
def link_model_coefficients(spark, sf_dir):
    from linkgraph.operators.model import coefficients
    return coefficients(Views(spark, sf_dir, stages=ML_STAGES).model)


@query
def link_scores(spark, sf_dir):
    from linkgraph.operators.model import score
    v = Views(spark, sf_dir, stages=ML_STAGES)
    return score(v.model, v.ml_split[1])


@query
def type_shares(spark, sf_dir):
    """J5 + F15 in long form, divided and undivided, where a count is not 0."""
    from linkgraph.operators.masks import mask_diag_counts as mdc
    from linkgraph.operators.model import type_shares as ts
    v = Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {"candidates", "hist"})
    diag = mdc(v.hist)
    both = (ts(diag, v.candidates).join(ts(diag, v.candidates, divide=False)
                                        .withColumnRenamed("type_shares", "counts"), ["p1", "p2"]))
    long = both.select("p1", "p2", F.posexplode(F.arrays_zip("type_shares", "counts")).alias("type", "x"))
    return long.where("x.counts > 0").select("p1", "p2", "type", F.col("x.counts").alias("cnt"),
                                             F.round("x.type_shares", 6).alias("share"))


def _scalar_vectors(feature_set: str):
    """The scalar and mask-bit entries of a generation's vectors as columns x0, x1, ..."""
    def run(spark, sf_dir):
        from dataclasses import replace

        from pyspark.ml.functions import vector_to_array

        from linkgraph.operators.features import FEATURE_SETS
        from linkgraph.operators.model import feature_set_vectors
        fs = replace(FEATURE_SETS[feature_set], pca=0, type_counts=False)
        v = Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {"candidates", "labelled"})
        vec = feature_set_vectors(v.features, fs, edge_bits=v.edge_bits if fs.edge_bits else None)
        a = vec.select("p1", "p2", vector_to_array("features").alias("a"))
        return a.select("p1", "p2", *[F.round(F.col("a").getItem(i), 6).alias(f"x{i}") for i in range(fs.width)])
    return run


# M5: scalars (and the edge's mask bits) of the job generations, as they stand in the vector
QUERIES["vector_baseline"] = _scalar_vectors("baseline")
QUERIES["vector_extended"] = _scalar_vectors("extended")
QUERIES["vector_short"] = _scalar_vectors("short")
QUERIES["vector_holdout"] = _scalar_vectors("holdout")


@query
def mask_covariance(spark, sf_dir):
    """The covariance that M1 decomposes, over the whole grid of cells x <= y."""
    from linkgraph.operators.model import cell_covariance
    cov = cell_covariance(Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {"hist"}).hist)
    return cov.select("x", "y", (F.round("cov", 6) + 0.0).alias("cov"))


@query
def pca_certificate(spark, sf_dir):
    """What holds of the projection whatever the components' signs."""
    from linkgraph.operators.model import pca_certificate as certificate
    v = Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {"hist"})
    return certificate(v.hist, v.pca_model, v.cells).select("part", "i", (F.round("value", 5) + 0.0).alias("value"))


# The largest mean gradient that counts as 0 (scaled features, log loss per row).
GRADIENT_TOLERANCE = 1e-3


@query
def model_gradient(spark, sf_dir):
    """M3: the loss gradient at the fitted coefficients, one row a term, and for the
    scalar terms what the training rows add up to."""
    from linkgraph.operators.model import gradient
    v = Views(spark, sf_dir, stages=ML_STAGES)
    g = gradient(v.model, v.ml_split[0])
    scalar = F.col("term") < len(v.feature_set.scalars)
    return g.select("term", F.when(scalar, F.round("observed", 4)).alias("observed"),
                    (F.abs("gradient") <= GRADIENT_TOLERANCE).alias("at_optimum"))


@query
def model_reload(spark, sf_dir):
    """M4 / K7: validation pairs scored by the model as loaded from its folder, and by
    plain columns from its stored numbers; how many differ."""
    from linkgraph.operators.model import score, score_by_columns
    v = Views(spark, sf_dir, stages=ML_STAGES)
    valid = v.ml_split[1]
    both = (score(v.model, valid).select("p1", "p2", F.col("score").alias("a"))
            .join(score_by_columns(v.model, valid).withColumnRenamed("score", "b"), ["p1", "p2"], "full"))
    differ = ~F.coalesce(F.abs(F.col("a") - F.col("b")) <= 1e-9, F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(differ, 1)).alias("n_differing"))


@query
def run_counts(spark, sf_dir):
    """Rows and positives of each part of the run."""
    v = Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {"labelled"})
    parts = [("train", v.train), ("valid", v.valid), ("holdout", v.holdout)]
    out = [df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).cast("bigint").alias("positives"))
           .select(F.lit(name).alias("part"), "n", "positives") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def model_keys(spark, sf_dir):
    """Which pairs each end of the ML part has: PCA rows and scored pairs."""
    from linkgraph.operators.model import score
    v = Views(spark, sf_dir, stages=ML_STAGES)
    return v.pca.select(F.lit("pca").alias("part"), "p1", "p2").unionByName(
        score(v.model, v.ml_split[1]).select(F.lit("scores").alias("part"), "p1", "p2"))


# ---- layouts read back -----------------------------------------------------------------------
@query
def edges_without_masks(spark, sf_dir):
    """S2."""
    from linkgraph.sources import text as X
    from linkgraph.sources.store import stage_path
    edges = Views(spark, sf_dir).edges
    path = stage_path(edges, "adjacency")
    X.write_lines(X.render_adjacency(edges), path)
    return X.read_adjacency(spark, path, with_masks=False)


@query
def edges_from_chunks(spark, sf_dir):
    """The chunked adjacency layout, written and read."""
    from linkgraph.sources import text as X
    lines = X.roundtrip(X.render_adjacency(Views(spark, sf_dir).edges, chunk_items=20), "chunks")
    return X.parse_adjacency(lines, chunked=True)


@query
def adjacency_rejects(spark, sf_dir):
    """Reject counts over all edges, every tenth friend and seventh mask made unreadable."""
    from linkgraph.sources import text as X
    e = Views(spark, sf_dir).edges
    friend = F.when(F.col("friend_id") % 10 == 0, "x").otherwise(F.col("friend_id").cast("string"))
    mask = F.when(F.col("friend_id") % 7 == 0, "?").otherwise(F.col("mask").cast("string"))
    lines = e.groupBy("user_id").agg(F.collect_list(F.concat(F.lit("("), friend, F.lit(","), mask, F.lit(")"))).alias("i"))
    lines = lines.select(F.concat(F.col("user_id").cast("string"), F.lit("\t{"), F.array_join("i", ","), F.lit("}"))
                         .alias("value"))
    return X.adjacency_rejects(X.roundtrip(lines, "rejects"))


@query
def reversed_plain_roundtrip(spark, sf_dir):
    """S8."""
    from linkgraph.sources import tables as TB
    from linkgraph.sources.store import stage_path
    adj = G.reverse_adjacency(Views(spark, sf_dir).kept)
    path = stage_path(adj, "reversed")
    TB.write_reversed(adj, path)
    return TB.read_reversed(spark, path).select("user_id", "friend_id")


def _hist_layout(older: bool):
    def run(spark, sf_dir):
        from linkgraph.operators.masks import hist_vectors
        from linkgraph.sources import tables as TB
        from linkgraph.sources.store import stage_path
        h = hist_vectors(Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {"hist"}).hist)
        path = stage_path(h, "hist_vectors")
        TB.write_hist_vectors(h, path, older)
        back = TB.read_hist_vectors(spark, path).select("p1", "p2", F.posexplode("hist").alias("i", "x"))
        return back.where("x <> 0").select("p1", "p2", (F.col("i") + 1).cast("int").alias("cell"),
                                           F.col("x").cast("bigint").alias("cnt"))
    return run


QUERIES["hist_vectors_roundtrip"] = _hist_layout(False)      # S10
QUERIES["hist_vectors_older_layout"] = _hist_layout(True)    # S11


@query
def roc_grouped(spark, sf_dir):
    from linkgraph.operators.metrics import roc_grouped as rg
    return rg(Views(spark, sf_dir, stages=Views.DEFAULT_STAGES | {'labelled'}).valid)


@query
def offline_lists(spark, sf_dir):
    """The test group's lists at the offline threshold, from stored probabilities."""
    from linkgraph.plans import jobs
    from linkgraph.sources import tables as TB
    from linkgraph.sources.store import stage_path
    v = Views(spark, sf_dir)
    scores = R.flip_scores(_score_population(v))
    path = stage_path(scores, "prediction_proba")
    TB.write_probabilities(scores, path)
    return jobs.offline_lists(spark, path, v.p, v.p.test_residue).select("user_id", "rank", "candidate_id")


# ---- end-to-end ---------------------------------------------------------------------------
_job_dirs: dict[tuple[str, str], str] = {}


def _job(spark: SparkSession, sf_dir: str) -> str:
    """The output folder of the production chain over `sf_dir`, run once an application."""
    from linkgraph.plans.jobs import run
    from linkgraph.sources.store import scratch
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _job_dirs:
        fx = Views(spark, sf_dir, stages=frozenset())
        out = scratch(spark, "job")
        run(spark, fx.edges, fx.profile, out, fx.p)
        _job_dirs[key] = out
    return _job_dirs[key]


@query
def job_candidates(spark, sf_dir):
    """Z1, from the job's folder."""
    from linkgraph.sources.tables import read_candidates
    return read_candidates(spark, f"{_job(spark, sf_dir)}/candidates").select("p1", "p2", "common_cnt")


@query
def job_hist(spark, sf_dir):
    """Z2, from the job's folder."""
    from linkgraph.sources.tables import read_candidates
    return read_candidates(spark, f"{_job(spark, sf_dir)}/hist").select("p1", "p2", "cell", "cnt")


@query
def job_twohop(spark, sf_dir):
    """Z3, from the job's folder."""
    return spark.read.parquet(f"{_job(spark, sf_dir)}/twohop").select(
        "p1", "p2", "max_common", "linked_pairs", "max_ratio_maxdeg", "max_ratio_mindeg")


@query
def job_train(spark, sf_dir):
    """Z4, from the job's folder."""
    train = spark.read.parquet(f"{_job(spark, sf_dir)}/train")
    return train.select("p1", "p2", F.col("label").cast("int").alias("label"))


@query
def job_recommendations(spark, sf_dir):
    """The scored population of the job, each pair once."""
    return spark.read.parquet(f"{_job(spark, sf_dir)}/test_scores").select("p1", "p2")


@query
def job_holdout(spark, sf_dir):
    """Z7, from the job's folder."""
    hold = spark.read.parquet(f"{_job(spark, sf_dir)}/holdout")
    return hold.select("p1", "p2", F.col("label").cast("int").alias("label"))


@query
def hidden_edges_order(spark, sf_dir):
    """K8 / O3: the hidden edges in the order of the written files and their lines."""
    from linkgraph.sources.text import numbered_lines, parse_pairs
    lines = numbered_lines(spark, f"{_job(spark, sf_dir)}/validPrediction_real")
    return parse_pairs(lines, keep=["position"]).select("position", "p1", "p2")


@query
def prediction_labels(spark, sf_dir):
    """K6: files, rows and positives of the three (prediction, label) sinks."""
    out = _job(spark, sf_dir)
    parts = []
    for part in ("training", "validation", "test"):
        df = spark.read.parquet(f"{out}/Model_fin/{part}").withColumn("file", F.input_file_name())
        parts.append(df.agg(F.lit(part).alias("part"), F.countDistinct("file").alias("files"),
                            F.count("prediction").alias("n"), F.sum("label").cast("bigint").alias("positives")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def run_report(spark, sf_dir):
    """Z1-Z8 + K9 on the fixture graph; the one-row report of the run."""
    from linkgraph.plans.jobs import run
    from linkgraph.sources.store import stage_path
    fx = Views(spark, sf_dir, stages=frozenset())
    return run(spark, fx.edges, fx.profile, stage_path(fx.edges, "run"), fx.p)
