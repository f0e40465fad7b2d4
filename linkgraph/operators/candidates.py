"""Candidate pairs by shared friends."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linkgraph.config import Params
from linkgraph.sources.store import materialize


# Pair rows one explosion task should emit.  Nearly all of them are different
# pairs, so this is also about the size of a counting task's hash table: it
# bounds its memory (some 100 bytes a pair), whatever the input.
PAIR_ROWS_PER_TASK = 2_000_000

# Most tasks one explosion may have; beyond it the tasks grow.
MAX_TASKS = 20_000

# Users of one friend that meet in one join group; a longer list is cut into
# blocks and the block pairs are joined, each in a group of its own.
FRIEND_BLOCK = 2_000


# Support first: the masked explosion is filtered by the supported pairs when
# these hold at most this share of all pair rows, else one pass is cheaper.
SUPPORTED_SHARE = 0.5

# Supported pairs that are broadcast at most (two ids each, 32 MB in all); more
# of them meet the explosion in a shuffled semi join behind a Bloom filter.
BROADCAST_PAIRS = 2_000_000

# Pair rows beyond which lists are made per user: a Bloom filter of Spark's
# default size lets nearly every row pass once some millions of pairs are in it.
ROWS_BY_USER = 100_000_000


def pair_explosion_size(kept: DataFrame) -> int:
    """Exact number of (p1, p2, friend) rows of the self join:
    sum over friends of C(n_f, 2), from a per-friend count (one number
    comes back to the driver)."""
    n = F.col("n").cast("double")
    tot = (kept.groupBy("friend_id").agg(F.count(F.lit(1)).alias("n"))
           .agg(F.sum(n * (n - 1) / 2).alias("t")).first()["t"])
    return int(tot or 0)


def explosion_partitions(kept: DataFrame, size: int | None = None) -> int:
    """Partition count for the pair explosion of `kept` (of `size` rows, counted
    if not given).

    The explosion multiplies rows (sum of C(n, 2) per friend), so its
    parallelism must follow the output, not the small input: one task per core
    at least (defaultParallelism = all executor cores), more when the exact
    explosion size needs them, MAX_TASKS at most.  Being explicit, the count
    keeps AQE from coalescing the input into a few tasks."""
    base = kept.sparkSession.sparkContext.defaultParallelism
    size = pair_explosion_size(kept) if size is None else size
    return max(base, min(MAX_TASKS, -(-size // PAIR_ROWS_PER_TASK)))


def _friend_groups(kept: DataFrame, cols: list[str]) -> DataFrame:
    """`cols` of `kept` with the block of the row's user (own) and the join group of
    its friend it is dealt to: (i, j), one for each pair of blocks with its own."""
    long = (kept.groupBy("friend_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FRIEND_BLOCK)
            .select("friend_id", F.ceil(F.col("n") / FRIEND_BLOCK).cast("int").alias("blocks")))
    rows = kept.select(*cols).join(long, "friend_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("user_id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(*cols, "blocks", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def pair_rows(kept: DataFrame, with_masks: bool = False, partitions: int | None = None) -> DataFrame:
    """One row per (p1, p2, friend) with p1 < p2 both naming friend.

    A self equi-join on friend_id plus the order predicate.  The list of a
    friend with more than FRIEND_BLOCK users (possible only with a widened
    band) is cut into blocks; its rows go to every pair of blocks they belong
    to, so a friend's pairs spread over many tasks.  With masks, mask1 belongs
    to p1 and mask2 to p2."""
    if partitions is None:
        partitions = explosion_partitions(kept)
    cols = ["friend_id", "user_id"] + (["mask"] if with_masks else [])
    rows = _friend_groups(kept, cols).drop("blocks").repartition(partitions, "friend_id", "i", "j")
    key = ["friend_id", "i", "j"]
    mask1, mask2 = ([F.col("mask").alias(x)] if with_masks else [] for x in ("mask1", "mask2"))
    a = rows.select(*key, F.col("own").alias("own1"), F.col("user_id").alias("p1"), *mask1)
    b = rows.select(*key, F.col("own").alias("own2"), F.col("user_id").alias("p2"), *mask2)
    # a pair of two blocks meets only in their own group
    met = (F.col("i") == F.col("j")) | (F.col("own1") != F.col("own2"))
    out = a.join(b, key).where((F.col("p1") < F.col("p2")) & met)
    # Only the key columns travel on
    return out.select("p1", "p2", "friend_id", *(["mask1", "mask2"] if with_masks else []))


def user_lists(kept: DataFrame, with_masks: bool = False, partitions: int | None = None) -> DataFrame:
    """The pair rows before they are exploded, in `partitions` partitions by p1: for
    each friend of p1 the later users of the friend's sorted list, as
    (p1, friend_id[, mask1], users ARRAY[, masks ARRAY]).

    A pair row costs 8 bytes of this exchange (16 with masks), and all rows of a
    pair arrive in one partition: what is grouped by (p1, p2) afterwards needs no
    exchange of pair rows.  A group holds at most two blocks of FRIEND_BLOCK users."""
    if partitions is None:
        partitions = explosion_partitions(kept)
    cols = ["friend_id", "user_id"] + (["mask"] if with_masks else [])
    known = kept.where(F.col("friend_id").isNotNull() & F.col("user_id").isNotNull())
    # an array that can't hold nulls is sorted as plain numbers
    rows = _friend_groups(known.withColumn("user_id", F.coalesce("user_id", F.lit(0))), cols)
    rows = rows.repartition(partitions, "friend_id", "i", "j")
    item = F.struct("user_id", "own", *(["mask"] if with_masks else []))
    groups = rows.groupBy("friend_id", "i", "j").agg(F.array_sort(F.collect_list(item)).alias("l"))
    at = groups.select("friend_id", "i", "j", "l", F.posexplode("l").alias("at", "u"))
    at = at.where(F.col("at") + 1 < F.size("l"))
    # a group of two blocks pairs users of different ones only
    later = F.slice("l", F.col("at") + 2, F.size("l"))
    later = F.when(F.col("i") == F.col("j"), later).otherwise(F.filter(later, lambda x: x["own"] != F.col("u.own")))
    at = at.select("friend_id", F.col("u.user_id").alias("p1"), *([F.col("u.mask").alias("mask1")] if with_masks else []),
                   later.alias("l"))
    out = at.select("p1", "friend_id", *(["mask1"] if with_masks else []), F.col("l.user_id").alias("users"),
                    *([F.col("l.mask").alias("masks")] if with_masks else []))
    return out.repartition(partitions, "p1")


def pair_rows_by_user(kept: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows of `pair_rows` (p1, p2, friend_id), each user's in one partition."""
    out = user_lists(kept, partitions=partitions)
    return out.select("p1", F.explode("users").alias("p2"), "friend_id").where(F.col("p1") < F.col("p2"))


@contextmanager
def _kept_in_place(spark: SparkSession):
    """Plans made in the block let a join by (p1, p2) use partitions by p1."""
    conf = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(conf, "true")
    spark.conf.set(conf, "false")
    try:
        yield
    finally:
        spark.conf.set(conf, was)


def _only_pairs_in_place(rows: DataFrame, pairs: DataFrame, partitions: int) -> DataFrame:
    """The rows of the given pairs, where `rows` have `partitions` partitions by p1:
    the pairs are dealt out like them and the rows stay, each partition looking its
    rows up in a hash table of its few pairs.  To be planned in `_kept_in_place`."""
    keys = pairs.select("p1", "p2").repartition(partitions, "p1").hint("shuffle_hash")
    return rows.join(keys, ["p1", "p2"], "left_semi")


def friend_lists(pairs: DataFrame, candidates: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """(p1, p2, friends ARRAY) of all pairs, or of the candidates among them.  With
    `partitions`, the number of the partitions of `pair_rows_by_user`, no pair row is
    exchanged and the lists are a stage table."""
    rows = pairs.select("p1", "p2", "friend_id")
    lists = F.collect_list("friend_id").alias("friends")
    if candidates is None:
        return rows.groupBy("p1", "p2").agg(lists)
    if partitions is None:
        return rows.join(candidates.select("p1", "p2"), ["p1", "p2"], "left_semi").groupBy("p1", "p2").agg(lists)
    with _kept_in_place(pairs.sparkSession):
        return materialize(_only_pairs_in_place(rows, candidates, partitions).groupBy("p1", "p2").agg(lists), "friend_lists")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """A2: common friends per pair; of `pair_rows_by_user` without an exchange."""
    return pairs.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("common_cnt"))


def counts_by_user(kept: DataFrame, least: int, partitions: int | None = None) -> DataFrame:
    """A2 + P9 / P10: (p1, p2, common_cnt) of the pairs with at least `least` common
    friends, made of whole lists instead of pair rows.

    All later users that p1 meets, over all friends, are one sorted array (max_degree *
    max_in_list ids at most).  One that stands `least` - 1 places after itself has
    enough common friends; only these leave the array, so no hash table ever holds the
    pairs with less support, which are nearly all."""
    if least < 2:
        return pair_counts(pair_rows_by_user(kept, partitions))
    met = (user_lists(kept, partitions=partitions).groupBy("p1")
           .agg(F.sort_array(F.flatten(F.collect_list("users"))).alias("met")))
    enough = F.filter("met", lambda x, i: x == F.get("met", i - (least - 1)))
    pairs = met.select("p1", F.explode(enough).alias("p2")).where(F.col("p1") < F.col("p2"))
    return pairs.groupBy("p1", "p2").agg((F.count(F.lit(1)) + F.lit(least - 1)).alias("common_cnt"))


@dataclass(frozen=True)
class Supported:
    """The pairs with at least `least` common friends, as a stage table
    (p1, p2, common_cnt), with what its write counted."""
    pairs: DataFrame
    least: int
    n_pairs: int
    n_rows: int  # pair rows that belong to them: the sum of common_cnt


def supported_pairs(kept: DataFrame, least: int, partitions: int | None = None) -> Supported:
    """Phase one: A2 + P10 without masks, counted where each user's lists are; the
    survivors are written once and counted by that write."""
    counts = counts_by_user(kept, least, partitions)
    seen = Observation()
    counts = counts.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("common_cnt").alias("rows"))
    pairs = materialize(counts, "supported_pairs")
    return Supported(pairs, least, int(seen.get["n"] or 0), int(seen.get["rows"] or 0))


def counted_pairs(counts: DataFrame, least: int) -> Supported:
    """The same from a written table that has the counts of all such pairs."""
    pairs = counts.where(F.col("common_cnt") >= least)
    seen = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("common_cnt").alias("rows")).first()
    return Supported(pairs, least, int(seen["n"]), int(seen["rows"] or 0))


def only_supported(rows: DataFrame, s: Supported) -> DataFrame:
    """Phase two: the pair rows of supported pairs, with `pair`, a hash of both
    ids, by which they are grouped on.

    Few survivors are broadcast, so rows of other pairs end where they are made.
    More meet the rows in a shuffled semi join on (pair, p1, p2): `pair` is one
    key for Spark's runtime Bloom filter, which drops nearly all other rows
    before the shuffle, and the groups that follow need no second one."""
    pair = F.xxhash64("p1", "p2").alias("pair")
    # the comparison holds for every row; it tells the planner the side is selective
    keys = s.pairs.where(F.col("common_cnt") >= s.least).select(pair, "p1", "p2")
    keys = F.broadcast(keys) if s.n_pairs <= BROADCAST_PAIRS else keys
    return rows.select(pair, *rows.columns).join(keys, ["pair", "p1", "p2"], "left_semi")


def _lists_by_user(kept: DataFrame, pairs: DataFrame, partitions: int) -> DataFrame:
    """Lists of the given pairs, made in the partitions of `user_lists`; a stage table."""
    lists = user_lists(kept, with_masks=True, partitions=partitions)
    rows = lists.select("p1", F.posexplode("users").alias("at", "p2"), "friend_id", "mask1", "masks")
    rows = _only_pairs_in_place(rows.where(F.col("p1") < F.col("p2")), pairs, partitions)
    mask2 = F.get("masks", F.col("at")).alias("mask2")
    lists = (rows.select("p1", "p2", F.struct("friend_id", "mask1", mask2).alias("c"))
             .groupBy("p1", "p2").agg(F.collect_list("c").alias("common")))
    with _kept_in_place(kept.sparkSession):
        return materialize(lists, "pair_lists")


def pair_lists(kept: DataFrame, least: int = 1, size: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(p1, p2, common_cnt, common ARRAY<STRUCT<friend_id, mask1, mask2>>) of the
    pairs with at least `least` common friends: one masked explosion from which
    candidates, histograms and 2-hop statistics all follow.  A list holds at most
    max_degree entries (the degree band of its users).

    collect_list can't combine on the map side, so every row that reaches it is
    shuffled with its masks.  With least > 1 the pairs are therefore counted
    first, unless a written table `counts` has all of them; if the supported ones
    hold at most SUPPORTED_SHARE of the pair rows, only their rows go on: past a
    broadcast or a Bloom filter, or, of more than ROWS_BY_USER rows, in each user's
    partition.  `size` is the number of pair rows, counted if not given."""
    size = pair_explosion_size(kept) if size is None else size
    partitions = explosion_partitions(kept, size)
    rows = pair_rows(kept, with_masks=True, partitions=partitions)
    keys, lists = ["p1", "p2"], None
    if least > 1:
        supported = supported_pairs(kept, least, partitions) if counts is None else counted_pairs(counts, least)
        if supported.n_rows <= SUPPORTED_SHARE * size:
            if size > ROWS_BY_USER and supported.n_pairs > BROADCAST_PAIRS:
                lists = _lists_by_user(kept, supported.pairs, partitions)
            else:
                rows, keys = only_supported(rows, supported), ["pair", "p1", "p2"]
    if lists is None:
        lists = rows.groupBy(*keys).agg(F.collect_list(F.struct("friend_id", "mask1", "mask2")).alias("common"))
    return (lists.select("p1", "p2", F.size("common").cast("bigint").alias("common_cnt"), "common")
            .where(F.col("common_cnt") >= least))


def common_friends(kept: DataFrame, p: Params = Params()) -> DataFrame:
    """J12 + A2 + P9: candidates(p1, p2, common_cnt) with common_cnt > min_support."""
    return counts_by_user(kept, p.min_support + 1)


def common_friend_ids(pairs: DataFrame, candidates: DataFrame, partitions: int | None = None) -> DataFrame:
    """A6 + O1: sorted common-friend ids of each candidate pair (bounded by the
    degree band: at most max_degree ids per pair)."""
    lists = friend_lists(pairs, candidates, partitions)
    return lists.select("p1", "p2", F.array_sort("friends").alias("friend_ids"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Edges p1 -> p2 with p1 < p2, as (p1, p2)."""
    return (edges.where(F.col("friend_id") > F.col("user_id"))
            .select(F.col("user_id").alias("p1"), F.col("friend_id").alias("p2")))


def label_candidates(candidates: DataFrame, positives: DataFrame, partitions: int | None = None) -> DataFrame:
    """J2 + P15: label 1 when the pair is a known edge, else 0.

    With `partitions`, the number of the partitions by p1 that counting leaves the
    candidates in, known edges (distinct, of users within the degree band) come as one
    list per p1, max_degree ids at most, and the candidates stay where they are."""
    if partitions is not None:
        known = (positives.repartition(partitions, "p1").groupBy("p1").agg(F.collect_list("p2").alias("_known"))
                 .hint("shuffle_hash"))
        is_known = F.coalesce(F.array_contains("_known", F.col("p2")), F.lit(False))
        return candidates.join(known, "p1", "left").withColumn("label", is_known.cast("int")).drop("_known")
    pos = positives.select("p1", "p2").withColumn("_pos", F.lit(1))
    return (candidates.join(pos, ["p1", "p2"], "left")
            .withColumn("label", F.coalesce(F.col("_pos"), F.lit(0)))
            .drop("_pos"))


def with_degrees(df: DataFrame, deg: DataFrame, how: str = "left", partitions: int | None = None) -> DataFrame:
    """Degrees of both ends (deg1 of p1, deg2 of p2).

    With `partitions`, rows in that many partitions by p1 stay for the first degree and
    are exchanged once, by p2; each task looks its rows up in a hash table of its few
    users, so nothing is sorted and a task's share does not grow with the input."""
    d1 = deg.select(F.col("user_id").alias("p1"), F.col("deg").alias("deg1"))
    d2 = deg.select(F.col("user_id").alias("p2"), F.col("deg").alias("deg2"))
    if partitions is not None:
        d1, d2 = (d.repartition(partitions, key).hint("shuffle_hash") for d, key in ((d1, "p1"), (d2, "p2")))
        return df.join(d1, "p1", how).repartition(partitions, "p2").join(d2, "p2", how)
    return df.join(d1, "p1", how).join(d2, "p2", how)


def jaccard_score(common="common_cnt", deg1="deg1", deg2="deg2"):
    """Model-free link score: |N(a) & N(b)| / |N(a) | N(b)| over kept lists."""
    c = F.col(common)
    return F.round(c.cast("double") / (F.col(deg1) + F.col(deg2) - c).cast("double"), 6)
