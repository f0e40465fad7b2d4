"""The reference's native text layouts (S1-S5, S12, S14, S15) and their
writers (K3, K4, K8), with the string functions of X7 (split, regexp_replace,
trim, try_cast, concat_ws, slice).  Parsing is column expressions over `spark.read.text`
lines (splittable for plain text; one task per .gz file, as any gzip);
malformed numbers become NULL through try_cast instead of failing the job; the
rows they would have given are left out and counted (`adjacency_rejects`,
`line_rejects`, also in the run report).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkgraph.sources.store import materialize, stage_path


def _try(c, t: str):
    return F.trim(c).try_cast(t)


# ---- S1 / S2 / S16: adjacency lists --------------------------------------------------
def _adjacency_items(lines: DataFrame, col: str, chunked: bool) -> DataFrame:
    """One row per item: user_id, friend_id, mask, each NULL where unreadable
    (a line without a list gives one row of that kind)."""
    parts = F.split(F.col(col), "\t", 3 if chunked else 2)
    body = F.regexp_replace(F.regexp_replace(F.get(parts, F.lit(2 if chunked else 1)), r"^\s*\{\s*\(", ""),
                            r"\)\s*\}\s*$", "")
    items = F.split(body, r"\)\s*,\s*\(")
    return (lines.select(_try(parts.getItem(0), "bigint").alias("user_id"), F.explode_outer(items).alias("_it"))
            .select("user_id", F.split("_it", ",").alias("_kv"))
            .select("user_id", _try(F.get("_kv", F.lit(0)), "bigint").alias("friend_id"),
                    _try(F.get("_kv", F.lit(1)), "bigint").alias("mask")))


def parse_adjacency(lines: DataFrame, col: str = "value", dedupe: bool = True, chunked: bool = False) -> DataFrame:
    """`user<TAB>{(friend,mask),(friend,mask),...}` -> edges(user_id, friend_id, mask);
    `chunked` reads `user<TAB>chunk<TAB>{...}`.

    Items are split on `),(` (spaces tolerated).  With `dedupe`, repeated
    (user, friend) items are merged with bit_or of their masks.  Items without
    a readable user or friend are left out; `adjacency_rejects` counts them."""
    rows = (_adjacency_items(lines, col, chunked).withColumn("mask", F.coalesce("mask", F.lit(0)).cast("bigint"))
            .where(F.col("user_id").isNotNull() & F.col("friend_id").isNotNull()))
    if dedupe:
        rows = rows.groupBy("user_id", "friend_id").agg(F.bit_or("mask").cast("bigint").alias("mask"))
    return rows


def adjacency_rejects(lines: DataFrame, col: str = "value", chunked: bool = False) -> DataFrame:
    """One row: items, rejected_items (no readable user or friend), unreadable_masks
    (read as 0)."""
    r = _adjacency_items(lines, col, chunked)
    bad = F.col("user_id").isNull() | F.col("friend_id").isNull()
    return r.agg(F.count(F.lit(1)).alias("items"), F.count_if(bad).alias("rejected_items"),
                 F.count_if(~bad & F.col("mask").isNull()).alias("unreadable_masks"))


def line_rejects(lines: DataFrame, parsed: DataFrame, col: str = "value") -> DataFrame:
    """One row: non-empty lines of a one-row-per-line layout (pairs, demography)
    and how many of them gave no row."""
    n = lines.where(F.length(F.trim(F.col(col))) > 0).agg(F.count(F.lit(1)).alias("lines"))
    got = parsed.agg(F.count(F.lit(1))).scalar()
    return n.select("lines", (F.col("lines") - got).alias("rejected_lines"))


def read_adjacency(spark: SparkSession, path: str, with_masks: bool = True, chunked: bool = False) -> DataFrame:
    """S1 (S2 without masks): adjacency text files, .gz included."""
    e = parse_adjacency(spark.read.text(path), chunked=chunked)
    return e if with_masks else e.select("user_id", "friend_id")


def render_adjacency(edges: DataFrame, chunk_items: int | None = None) -> DataFrame:
    """Adjacency lines for `edges`, one line per user (the native layout: as long
    as the user's list).

    With `chunk_items`, the chunked layout instead: every line is
    `user<TAB>chunk<TAB>{...}` with about that many items, whatever the size of
    the list, so no user becomes one giant group or line.  The two layouts have
    their own readers (`parse_adjacency(chunked=...)`)."""
    item = F.concat(F.lit("("), F.col("friend_id").cast("string"), F.lit(","),
                    F.col("mask").cast("string"), F.lit(")"))
    items = F.array_sort(F.collect_list(F.struct("friend_id", item.alias("s")))).alias("_l")
    body = F.concat(F.lit("{"), F.array_join(F.col("_l.s"), ","), F.lit("}"))
    user = F.col("user_id").cast("string")
    if chunk_items is None:
        return edges.groupBy("user_id").agg(items).select(F.concat_ws("\t", user, body).alias("value"))
    from linkgraph.operators.skew import join_per_key
    deg = edges.groupBy("user_id").agg(F.count(F.lit(1)).alias("_deg"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("_deg") / F.lit(chunk_items)))
    keyed = join_per_key(edges, deg, "user_id", "inner", counts=deg).withColumn(
        "_chunk", F.pmod(F.xxhash64("friend_id"), chunks))
    lists = keyed.groupBy("user_id", "_chunk").agg(items)
    return lists.select(F.concat_ws("\t", user, F.col("_chunk").cast("string"), body).alias("value"))


# ---- S3 / S4 / S5: demography TSV -------------------------------------------------------
DEMOGRAPHY_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("create_date", T.LongType()),
    T.StructField("birth_date", T.LongType()),
    T.StructField("gender", T.IntegerType()),
    T.StructField("country_id", T.IntegerType()),
    T.StructField("location_id", T.IntegerType()),
    T.StructField("login_region", T.IntegerType()),
])


def read_demography(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated demography, 7 columns; an empty birth date and a
    missing last column read as NULL (defaults are applied by the feature
    step).  Side files starting with '.' or '_' are skipped by the reader."""
    return (spark.read.csv(path, sep="\t", schema=DEMOGRAPHY_SCHEMA, mode="PERMISSIVE",
                           ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
            .where(F.col("user_id").isNotNull()))


def render_demography(profile: DataFrame) -> DataFrame:
    """TSV lines; NULL birth date -> empty field, NULL login region -> the
    line has 6 columns (both cases of the reference's input)."""
    def s(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in profile.columns else F.lit("")
    return profile.select(F.concat_ws("\t", s("user_id"), s("create_date"), s("birth_date"), s("gender"),
                                      s("country_id"), s("location_id"),
                                      F.col("login_region").cast("string")).alias("value"))


# ---- S12 / K4: 2-hop tuples ------------------------------------------------------------------
TWOHOP_STATS = ["max_common", "linked_pairs", "max_ratio_maxdeg", "max_ratio_mindeg"]


def render_twohop(twohop: DataFrame) -> DataFrame:
    """`((p1,p2),(max_common,links,max_ratio_maxdeg,max_ratio_mindeg))`."""
    vals = F.concat_ws(",", *[F.col(c).cast("string") for c in TWOHOP_STATS])
    return twohop.select(F.concat(F.lit("(("), F.col("p1").cast("string"), F.lit(","),
                                  F.col("p2").cast("string"), F.lit("),("), vals, F.lit("))")).alias("value"))


def parse_twohop(lines: DataFrame, col: str = "value") -> DataFrame:
    """Strip parentheses, split on commas: pair ids, then 4 doubles."""
    v = F.split(F.regexp_replace(F.col(col), r"[()]", ""), ",")
    return lines.select(_try(F.get(v, F.lit(0)), "bigint").alias("p1"), _try(F.get(v, F.lit(1)), "bigint").alias("p2"),
                        *[_try(F.get(v, F.lit(i + 2)), "double").alias(c) for i, c in enumerate(TWOHOP_STATS)])


# ---- S14 / K3: ranked lists --------------------------------------------------------------------
def parse_ranked_lists(lines: DataFrame, col: str = "value") -> DataFrame:
    """S14 + P14: `user c1 c2 ...` split on whitespace -> (user_id, rank,
    candidate_id); empty lines and user 0 are dropped."""
    toks = F.split(F.trim(F.col(col)), r"\s+")
    return (lines.where(F.length(F.trim(F.col(col))) > 0)
            .select(_try(toks.getItem(0), "bigint").alias("user_id"),
                    F.posexplode(F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0)))).alias("_i", "_c"))
            .where(F.col("user_id").isNotNull() & (F.col("user_id") != 0))
            .select("user_id", (F.col("_i") + 1).cast("int").alias("rank"),
                    _try(F.col("_c"), "bigint").alias("candidate_id")))


# ---- S15 / K8: hidden edges ----------------------------------------------------------------------
def render_pairs(pairs: DataFrame) -> DataFrame:
    """K8 + O3 layout `(p1,p2)`, key-descending (range-partitioned sort)."""
    return (pairs.orderBy(F.desc("p1"), F.desc("p2"))
            .select(F.concat(F.lit("("), F.col("p1").cast("string"), F.lit(","),
                             F.col("p2").cast("string"), F.lit(")")).alias("value")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, value): the lines of a text folder, numbered from 1 through its
    files in the order of their names.  Lines are numbered within each file; the
    offsets come from one row per file."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"),
                                         F.monotonically_increasing_id().alias("at"))
    lines = materialize(lines, "lines")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    out = lines.withColumn("inside", inside).join(sizes, "file")
    return out.select((F.col("before") + F.col("inside")).cast("bigint").alias("position"), "value")


def parse_pairs(lines: DataFrame, col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """`(a,b)` -> (p1, p2), with the columns `keep` of the lines in front."""
    m = r"^\s*\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)\s*$"
    return (lines.select(*(keep or []), _try(F.regexp_extract(col, m, 1), "bigint").alias("p1"),
                         _try(F.regexp_extract(col, m, 2), "bigint").alias("p2"))
            .where(F.col("p1").isNotNull() & F.col("p2").isNotNull()))


# ---- writing ---------------------------------------------------------------------------------------
def write_lines(lines: DataFrame, path: str, gzip: bool = True, col: str = "value") -> None:
    w = lines.select(col).write.mode("overwrite")
    if gzip:
        w = w.option("compression", "gzip")
    w.text(path)


def roundtrip(lines: DataFrame, name: str, gzip: bool = True) -> DataFrame:
    """Write lines to a fresh stage folder and read them back as text."""
    path = stage_path(lines, name)
    write_lines(lines, path, gzip)
    return lines.sparkSession.read.text(path)
