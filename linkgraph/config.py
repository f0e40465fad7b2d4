"""Parameters of the pipeline.  Defaults are the reference job's values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # Degree band applied to a user's own list.
    min_degree: int = 8
    max_degree: int = 1000
    # Band applied to the reversed list of a friend.
    min_in_list: int = 2
    max_in_list: int = 2000
    # Minimum number of common friends for a candidate pair (P9): count > this.
    min_support: int = 8
    # Minimum support of a pair for the mask histogram (P10): count > this.
    hist_min_support: int = 5
    # Group predicates (P5-P7): id % modulus compared with these residues.
    modulus: int = 11
    test_residue: int = 7
    holdout_residue: int = 6
    # Number of candidate passes of the reference, kept as a bucket column.
    n_buckets: int = 107
    # Ranking (W1) and F-beta.
    top_k: int = 100
    beta: float = 2.0
    # PCA size (M1) and the solver cap (M3).
    pca_k: int = 47
    max_iter: int = 6000
    # Sampling (R1-R3, P8); see functions.hashing for the deterministic draw.
    negative_fraction: float = 0.15
    row_sample_rate: float = 100.0 / 107.0
    train_fraction: float = 0.3
    holdout_positive_fraction: float = 0.1
    salts: dict = field(default_factory=lambda: {
        "stratified": 1, "bernoulli": 2, "split": 3, "thinning": 4})
    # Score threshold of the offline evaluation.
    threshold: float = 0.0
    # The reference counts unknown sex as "same" only in its first baseline.
    count_unknown_sex: bool = False
    # Model forms of the job generations: the feature set (operators.features),
    # the intercept (off in the first baseline) and whether the per-type counts
    # are divided by the common count (not in the hold-out job).
    feature_set: str = "production"
    fit_intercept: bool = True
    divide_type_counts: bool = True


# Parameters of the derived test fixture (FIXTURES.md part B): support "> 1"
# ("> 2" for histograms) so that sf0.01 and sf0.1 have candidates and histograms,
# thinning 0.5 so NDCG has truth.
FIXTURE = Params(min_support=1, hist_min_support=2, holdout_positive_fraction=0.5)
