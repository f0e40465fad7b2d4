"""Group predicates, samples and splits.

All draws are deterministic functions of the pair (functions.hashing), so
they are pushable filters, identical on recomputation after an executor
loss, and the hold-out anti join against the training split is exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.config import Params
from linkgraph.functions.hashing import hash_unit


def _res(c: str, p: Params) -> Column:
    return F.col(c) % p.modulus  # sign-following %, like the JVM remainder


def train_group(p: Params = Params()) -> Column:
    """P5: neither end in the test residue."""
    return (_res("p1", p) != p.test_residue) & (_res("p2", p) != p.test_residue)


def test_group(p: Params = Params()) -> Column:
    """At least one end in the test residue."""
    return (_res("p1", p) == p.test_residue) | (_res("p2", p) == p.test_residue)


def holdout_group(p: Params = Params()) -> Column:
    """Not both ends in the test residue, and one end in the hold-out residue."""
    return (((_res("p1", p) != p.test_residue) | (_res("p2", p) != p.test_residue))
            & ((_res("p1", p) == p.holdout_residue) | (_res("p2", p) == p.holdout_residue)))


def draw(p: Params, name: str) -> Column:
    return hash_unit("p1", "p2", p.salts[name])


def stratified_sample(df: DataFrame, p: Params = Params(), label: str = "label") -> DataFrame:
    """Keep every positive, negatives with probability negative_fraction."""
    return df.where((F.col(label) == 1) | (draw(p, "stratified") < p.negative_fraction))


def bernoulli_sample(df: DataFrame, p: Params = Params()) -> DataFrame:
    """R2: keep a row with probability row_sample_rate."""
    return df.where(draw(p, "bernoulli") <= p.row_sample_rate)


def split_flag(p: Params = Params()) -> Column:
    """True for the training part (train_fraction), False for validation."""
    return draw(p, "split") < p.train_fraction


def training_data(labelled: DataFrame, p: Params = Params()) -> DataFrame:
    """Z4 up to the split: train group, stratified sample, row sample.  The
    group predicate is applied first so it reaches the scan side."""
    return bernoulli_sample(stratified_sample(labelled.where(train_group(p)), p), p)


def train_valid(labelled: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    data = training_data(labelled, p)
    return data.where(split_flag(p)), data.where(~split_flag(p))


def holdout(labelled: DataFrame, training: DataFrame, p: Params = Params()) -> DataFrame:
    """P7 + J11 + U3: hold-out group minus the training pairs (key subtraction
    as a left anti join; training pairs of no hold-out group stay out of it)."""
    taken = training.where(holdout_group(p)).select("p1", "p2")
    return labelled.where(holdout_group(p)).join(taken, ["p1", "p2"], "left_anti")


def thin_positives(df: DataFrame, p: Params = Params(), label: str = "label") -> DataFrame:
    """All negatives, positives with probability holdout_positive_fraction;
    the kept positives are the hidden truth."""
    return df.where((F.col(label) == 0) | (draw(p, "thinning") < p.holdout_positive_fraction))
