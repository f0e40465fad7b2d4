"""Shared lazy views over one data directory.

Each property builds a DataFrame once per `Views` object, so a query that
needs e.g. the candidates twice reuses one logical plan (Spark then reuses
the identical exchanges).  The views named in `stages` run a Spark job when
they are first read (they are written and read back), and so does every pair
explosion, which counts its rows to size its tasks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.config import FIXTURE, Params
from linkgraph.operators import candidates as C
from linkgraph.operators import graph as G
from linkgraph.sources.fixtures import Fixture
from linkgraph.sources.store import materialize, materialize_bucketed


class Views:
    """Stages named in `stages` are written to the checkpoint folder the
    first time they are needed (edges and banded edges by default: every
    later plan reads them several times).  Queries that read candidates or
    labelled pairs more than once add those.  With "pairs" among them, the
    pair-keyed tables that meet in a feature vector are stages bucketed by
    (p1, p2), so that they meet without an exchange."""

    DEFAULT_STAGES = frozenset({"edges", "kept"})

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = FIXTURE,
                 stages=DEFAULT_STAGES):
        self.spark, self.sf_dir, self.p = spark, sf_dir, params
        self.stages = frozenset(stages)
        self.fx = Fixture(spark, sf_dir)

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name) if name in self.stages else df

    def _pair_stage(self, df: DataFrame, name: str) -> DataFrame:
        """A table with one row per pair: bucketed by the pair if asked."""
        if "pairs" in self.stages:
            return materialize_bucketed(df, name, ["p1", "p2"])
        return self._stage(df, name)

    # -- base tables -------------------------------------------------------
    @cached_property
    def edges(self) -> DataFrame:
        return self._stage(self.fx.edges(), "edges")

    @cached_property
    def profile(self) -> DataFrame:
        return self.fx.profile()

    @cached_property
    def degree(self) -> DataFrame:
        return G.degree(self.edges)

    @cached_property
    def kept(self) -> DataFrame:
        return self._stage(G.kept_edges(self.edges, self.p, self.degree), "kept")

    @cached_property
    def explosion(self) -> int:
        """Rows of a pair explosion, counted once."""
        return C.pair_explosion_size(self.kept)

    @property
    def partitions(self) -> int:
        return C.explosion_partitions(self.kept, self.explosion)

    @cached_property
    def pairs(self) -> DataFrame:
        return C.pair_rows_by_user(self.kept, self.partitions)

    @cached_property
    def pairs_masked(self) -> DataFrame:
        return C.pair_rows(self.kept, with_masks=True, partitions=self.partitions)

    @cached_property
    def candidates(self) -> DataFrame:
        return self._stage(C.counts_by_user(self.kept, self.p.min_support + 1, self.partitions), "candidates")

    @cached_property
    def positives(self) -> DataFrame:
        return G.positives(self.edges)

    @cached_property
    def labels(self) -> DataFrame:
        """candidates + label.

        Both ends of a candidate are users (they come from user_id of the
        banded edges), so "p1 -> p2 is a known edge whose friend end is a
        user" reduces to "p1 -> p2 is a banded edge": the label looks up the
        canonical edges directly, without the semi join of `positives`."""
        banded = G.degree_band(self.edges, self.p, self.degree)
        return self._stage(C.label_candidates(self.candidates, C.canonical_edges(banded), self.partitions), "labels")

    @cached_property
    def labelled(self) -> DataFrame:
        """candidates + label + degrees + the model-free score."""
        return self._pair_stage(C.with_degrees(self.labels, self.degree, partitions=self.partitions)
                                .withColumn("score", C.jaccard_score()), "labelled")

    # -- masks, 2-hop, features ----------------------------------------------
    @cached_property
    def hist(self) -> DataFrame:
        from linkgraph.operators.masks import mask_pair_hist
        # staged candidates hold the counts of all pairs with more support
        counted = "candidates" in self.stages and self.p.hist_min_support >= self.p.min_support
        lists = C.pair_lists(self.kept, self.p.hist_min_support + 1, self.explosion, self.candidates if counted else None)
        return self._stage(mask_pair_hist(lists, self.p.hist_min_support), "hist")

    @cached_property
    def ratios(self) -> DataFrame:
        from linkgraph.operators.twohop import candidate_ratios
        return candidate_ratios(self.labelled)

    @cached_property
    def twohop(self) -> DataFrame:
        from linkgraph.operators.twohop import twohop_stats
        return self._pair_stage(twohop_stats(self.pairs, self.ratios, self.candidates, self.partitions), "twohop")

    @cached_property
    def twohop_all(self) -> DataFrame:
        from linkgraph.operators.twohop import twohop_stats
        # every pair with two common friends, the least that has statistics, is a candidate
        every = self.candidates if self.p.min_support <= 1 else None
        return twohop_stats(self.pairs, self.ratios, every, self.partitions)

    @cached_property
    def attrs(self) -> DataFrame:
        from linkgraph.operators.features import user_attributes
        return user_attributes(self.degree, self.profile)

    @cached_property
    def features(self) -> DataFrame:
        from linkgraph.operators.features import feature_table
        return self._pair_stage(feature_table(self.labelled, self.attrs, self.twohop, self.p.count_unknown_sex),
                                "features")

    # -- sampling and splits ---------------------------------------------------
    @cached_property
    def split(self) -> tuple[DataFrame, DataFrame]:
        from linkgraph.operators.sampling import train_valid
        return train_valid(self.labelled, self.p)

    @property
    def train(self) -> DataFrame:
        return self.split[0]

    @property
    def valid(self) -> DataFrame:
        return self.split[1]

    @cached_property
    def holdout(self) -> DataFrame:
        from linkgraph.operators.sampling import holdout, thin_positives
        return thin_positives(holdout(self.labelled, self.train, self.p), self.p)

    # -- ML ------------------------------------------------------------------------
    @cached_property
    def cells(self) -> DataFrame:
        """The histograms as sparse vectors, always staged: the PCA fit reads them
        several times."""
        from linkgraph.operators.model import cell_vectors
        return materialize(cell_vectors(self.hist), "cells")

    @cached_property
    def pca_model(self):
        from linkgraph.operators.model import pca_model
        return pca_model(self.cells, self.feature_set.pca or self.p.pca_k)

    @cached_property
    def pca(self) -> DataFrame:
        from linkgraph.operators.model import project
        return self._pair_stage(project(self.pca_model, self.cells), "pca")

    @cached_property
    def shares(self) -> DataFrame:
        from linkgraph.operators.masks import mask_diag_counts
        from linkgraph.operators.model import type_shares
        return self._pair_stage(type_shares(mask_diag_counts(self.hist), self.candidates, self.p.divide_type_counts),
                                "shares")

    @property
    def feature_set(self):
        from linkgraph.operators.features import FEATURE_SETS
        return FEATURE_SETS[self.p.feature_set]

    @cached_property
    def edge_bits(self) -> DataFrame:
        from linkgraph.operators.masks import edge_mask_bits
        return self._pair_stage(edge_mask_bits(self.candidates, G.positives(self.edges, with_mask=True)), "edge_bits")

    @cached_property
    def vectors(self) -> DataFrame:
        """Full feature vectors of all candidates (staged when asked; the scaler,
        L-BFGS and scoring read the sample of `ml_split`)."""
        from linkgraph.operators.model import feature_set_vectors
        fs = self.feature_set
        return self._stage(feature_set_vectors(
            self.features, fs, self.pca if fs.pca else None, self.shares if fs.type_counts else None,
            self.edge_bits if fs.edge_bits else None), "vectors")

    @cached_property
    def ml_split(self) -> tuple[DataFrame, DataFrame]:
        """The sampled vectors are written once, whatever reads the parts: the draws reach the
        pair tables below the vectors, so no others are made unless the vectors are a stage."""
        from linkgraph.operators.sampling import train_valid, training_data
        return train_valid(materialize(training_data(self.vectors, self.p), "sample"), self.p)

    @cached_property
    def model(self):
        """Fitted, saved and loaded (K7)."""
        from linkgraph.operators.model import fit
        return fit(self.ml_split[0], self.p.max_iter, self.p.fit_intercept)
