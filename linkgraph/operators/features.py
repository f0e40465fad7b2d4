"""Pair features (F1-F16, J4-J10) as column expressions over joins, with the
math of X8 (abs, log, greatest/least, try_divide) and the NULL defaults of
X9 (coalesce instead of getOrElse).

Per-user attributes (degree, profile) are first combined into one
user-keyed table, so a pair needs two lookups (p1, p2) instead of four;
pair-keyed tables (label, 2-hop, histogram) join on (p1, p2), which the
candidate aggregate is already partitioned by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN_CITY = -1
DIVISOR_DEFAULT = 999999  # degree used as divisor when a user is unknown (F8)


def _div(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def user_attributes(degree: DataFrame, profile: DataFrame) -> DataFrame:
    """One row per user: degree and profile defaults of the reference
    (age 0 when empty, login region 0 when the column is missing)."""
    prof = profile.select("user_id",
                          F.coalesce("birth_date", F.lit(0)).cast("bigint").alias("age"),
                          F.coalesce("gender", F.lit(0)).alias("sex"),
                          F.col("location_id").alias("city"),
                          F.coalesce("login_region", F.lit(0)).alias("region"),
                          F.lit(True).alias("known"))
    return degree.join(prof, "user_id", "full")


def attach_users(pairs: DataFrame, attrs: DataFrame) -> DataFrame:
    """Attributes of both ends, suffixed 1 and 2 (left joins)."""
    cols = [c for c in attrs.columns if c != "user_id"]
    a1 = attrs.select(F.col("user_id").alias("p1"), *[F.col(c).alias(c + "1") for c in cols])
    a2 = attrs.select(F.col("user_id").alias("p2"), *[F.col(c).alias(c + "2") for c in cols])
    return pairs.join(a1, "p1", "left").join(a2, "p2", "left")


def degree_feature_cols(common: str = "common_cnt") -> dict[str, Column]:
    """F1-F8 over columns deg1, deg2 (NULL = unknown user -> 0), by name."""
    c = F.col(common)
    d1 = F.coalesce(F.col("deg1"), F.lit(0))
    d2 = F.coalesce(F.col("deg2"), F.lit(0))
    both = (d1 != 0) & (d2 != 0)
    hi, lo = F.greatest(d1, d2), F.least(d1, d2)
    cols = {
        "log_common": F.round(F.log(c.cast("double")), 6),
        "share1": F.when(d1 != 0, _div(c, d1)).otherwise(F.lit(0.0)),
        "share2": F.when(d2 != 0, _div(c, d2)).otherwise(F.lit(0.0)),
        "share_max": F.when(both, _div(c, hi)).otherwise(F.lit(0.0)),
        "share_min": F.when(both, _div(c, lo)).otherwise(F.lit(0.0)),
        "deg_max": hi.cast("bigint"),
        "deg_min": lo.cast("bigint"),
        "share2_default": _div(c, F.coalesce(F.col("deg2"), F.lit(DIVISOR_DEFAULT))),
    }
    return {k: v.alias(k) for k, v in cols.items()}


def profile_feature_cols(count_unknown_sex: bool = False) -> list[Column]:
    """Age gap, same sex, same home city, same login region; unknown
    users get age 0, sex 0, city -1, region -1 (the reference's sentinels)."""
    age1 = F.coalesce(F.col("age1"), F.lit(0))
    age2 = F.coalesce(F.col("age2"), F.lit(0))
    sex1 = F.coalesce(F.col("sex1"), F.lit(0))
    sex2 = F.coalesce(F.col("sex2"), F.lit(0))
    city1 = F.coalesce(F.col("city1"), F.lit(UNKNOWN_CITY))
    city2 = F.coalesce(F.col("city2"), F.lit(UNKNOWN_CITY))
    reg1 = F.when(F.col("known1").isNull(), F.lit(UNKNOWN_CITY)).otherwise(F.col("region1"))
    reg2 = F.when(F.col("known2").isNull(), F.lit(UNKNOWN_CITY)).otherwise(F.col("region2"))
    same_sex = (sex1 == sex2) if count_unknown_sex else ((sex1 == sex2) & (sex1 != 0))
    return [
        F.abs(age1 - age2).cast("bigint").alias("age_gap"),
        same_sex.cast("int").alias("same_sex"),
        ((city1 == city2) & (city1 != UNKNOWN_CITY)).cast("int").alias("same_city"),
        ((reg1 == reg2) & (reg1 != UNKNOWN_CITY)).cast("int").alias("same_region"),
    ]


TWOHOP_COLS = ["max_common", "linked_pairs", "max_ratio_maxdeg", "max_ratio_mindeg"]


def feature_table(labelled: DataFrame, attrs: DataFrame, twohop: DataFrame,
                  count_unknown_sex: bool = False) -> DataFrame:
    """M5 scalars: F1-F12 and F16 plus the label (a feature set picks from
    them).  Missing 2-hop statistics default to 0 (J6)."""
    base = labelled.select("p1", "p2", "common_cnt", "label")
    th = twohop.select("p1", "p2", *TWOHOP_COLS)
    j = attach_users(base.join(th, ["p1", "p2"], "left"), attrs)
    deg = degree_feature_cols()
    return j.select(
        "p1", "p2", "label", "common_cnt",
        *deg.values(),
        *profile_feature_cols(count_unknown_sex),
        F.coalesce("max_common", F.lit(0)).cast("bigint").alias("max_common"),
        F.coalesce("linked_pairs", F.lit(0)).cast("bigint").alias("linked_pairs"),
        F.coalesce("max_ratio_maxdeg", F.lit(0.0)).alias("max_ratio_maxdeg"),
        F.coalesce("max_ratio_mindeg", F.lit(0.0)).alias("max_ratio_mindeg"))


FEATURE_COLS = ["common_cnt", "share_max", "share_min", "share2_default", "age_gap",
                "same_sex", "same_city", "same_region"] + TWOHOP_COLS

@dataclass(frozen=True)
class FeatureSet:
    """What a feature vector holds: scalar columns, then (each if asked) the
    21 mask bits of the known edge, the PCA projection, the 22 per-type counts."""
    scalars: tuple[str, ...]
    edge_bits: bool = False
    pca: int = 0
    type_counts: bool = False

    @property
    def width(self) -> int:
        return len(self.scalars) + 21 * self.edge_bits + self.pca + 22 * self.type_counts


_EXTENDED = ("common_cnt", "share1", "share2", "share_max", "share2_default", "age_gap", "same_sex", "same_city",
             "same_region")
_SHORT = ("common_cnt", "log_common") + _EXTENDED[1:]

# The vectors of the reference's job generations.  Production and hold-out are
# 2 narrower than there: the two ids that slipped into its 2-hop statistics are
# left out.
FEATURE_SETS = {
    "baseline": FeatureSet(("common_cnt", "age_gap", "same_sex")),
    "extended": FeatureSet(_EXTENDED, edge_bits=True),
    "short": FeatureSet(_SHORT, edge_bits=True),
    "short_pca": FeatureSet(_SHORT, edge_bits=True, pca=10),
    "production": FeatureSet(tuple(FEATURE_COLS), pca=47, type_counts=True),
    "holdout": FeatureSet(("common_cnt", "deg_max", "deg_min") + tuple(FEATURE_COLS[1:]), pca=47, type_counts=True),
}
