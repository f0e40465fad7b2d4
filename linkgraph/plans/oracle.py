"""Independent SQL oracles (DuckDB dialect, also valid Spark SQL where noted).

The driver registers only the raw tables, so every oracle starts with the
fixture definitions of FIXTURES.md as CTEs.  `with_views(body, names)` emits
the needed CTEs (with their dependencies, in order) in front of `body`.
Doubles are rounded to 6 places on both sides; integer division is avoided.
"""

from __future__ import annotations

from linkgraph.config import FIXTURE
from linkgraph.functions.hashing import hash_unit_sql

P = FIXTURE

# read several times by later CTEs: computed once
KEPT = {"edges", "kept", "candidates", "labelled", "train", "hist", "hold", "hanti", "ftrain", "cov"}

# name -> (sql, dependencies)
CTE: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTE[name] = (sql.strip(), deps)


cte("edges", """
SELECT o_custkey AS user_id, l_partkey AS friend_id,
  CAST(bit_or(CASE WHEN l_returnflag = 'N' THEN 0
       ELSE CAST(pow(2, CAST(floor(l_quantity) AS INT) % 21) AS BIGINT) END) AS BIGINT) AS mask
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey""")
cte("profile", """
SELECT c_custkey AS user_id,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(c_acctbal) AS BIGINT) END AS birth_date,
  CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS gender,
  c_nationkey AS location_id, NULLIF(n_regionkey, 0) AS login_region
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
cte("degree", "SELECT user_id, count(*) AS deg FROM edges GROUP BY user_id", "edges")
cte("dband", f"""
SELECT e.user_id, e.friend_id, e.mask FROM edges e JOIN degree d ON e.user_id = d.user_id
WHERE d.deg BETWEEN {P.min_degree} AND {P.max_degree}""", "edges", "degree")
cte("kept", f"""
SELECT user_id, friend_id, mask FROM (
  SELECT user_id, friend_id, mask, count(*) OVER (PARTITION BY friend_id) AS n FROM dband) t
WHERE n BETWEEN {P.min_in_list} AND {P.max_in_list}""", "dband")
cte("pairs", """
SELECT a.user_id AS p1, b.user_id AS p2, a.friend_id, a.mask AS mask1, b.mask AS mask2
FROM kept a JOIN kept b ON a.friend_id = b.friend_id AND a.user_id < b.user_id""", "kept")
cte("candidates", f"""
SELECT p1, p2, count(*) AS common_cnt FROM pairs GROUP BY p1, p2 HAVING count(*) > {P.min_support}""",
    "pairs")
cte("positives", """
SELECT user_id AS p1, friend_id AS p2 FROM edges
WHERE friend_id > user_id AND friend_id IN (SELECT user_id FROM edges)""", "edges")
cte("labelled", """
SELECT c.p1, c.p2, c.common_cnt, CASE WHEN p.p1 IS NULL THEN 0 ELSE 1 END AS label,
  d1.deg AS deg1, d2.deg AS deg2,
  round(c.common_cnt / CAST(d1.deg + d2.deg - c.common_cnt AS DOUBLE), 6) AS score
FROM candidates c LEFT JOIN positives p ON c.p1 = p.p1 AND c.p2 = p.p2
JOIN degree d1 ON c.p1 = d1.user_id JOIN degree d2 ON c.p2 = d2.user_id""",
    "candidates", "positives", "degree")
M, T7, H6 = P.modulus, P.test_residue, P.holdout_residue
cte("score_pop", f"""
SELECT p1, p2, score FROM labelled
WHERE (p1 % {M} = {T7} OR p2 % {M} = {T7}) AND label = 0""", "labelled")
cte("flipped", """
SELECT p1 AS user_id, p2 AS candidate_id, score FROM score_pop
UNION ALL SELECT p2 AS user_id, p1 AS candidate_id, score FROM score_pop""", "score_pop")
cte("topk", f"""
SELECT user_id, CAST(rank AS INTEGER) AS rank, candidate_id, score FROM (
  SELECT user_id, candidate_id, score,
    row_number() OVER (PARTITION BY user_id ORDER BY score DESC, candidate_id) AS rank
  FROM flipped WHERE user_id % {M} = {T7} AND score >= {P.threshold}) t
WHERE rank <= {P.top_k}""", "flipped")


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in CTE[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str) -> str:
    parts = [f"{n} AS {'MATERIALIZED ' if n in KEPT else ''}(\n{CTE[n][0]}\n)" for n in _order(names)]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def hsql(p1: str, p2: str, salt_name: str) -> str:
    return hash_unit_sql(p1, p2, P.salts[salt_name])


ORACLE: dict[str, str] = {}


def oracle(name: str, body: str, *views: str) -> None:
    ORACLE[name] = with_views(body, *views) if views else body.strip()


# ---- graph -------------------------------------------------------------------
oracle("user_degree", "SELECT user_id, deg FROM degree", "degree")
oracle("distinct_users", "SELECT DISTINCT user_id FROM edges", "edges")
oracle("degree_band", "SELECT user_id, friend_id, mask FROM dband", "dband")
oracle("reverse_edges", "SELECT friend_id, user_id, mask FROM dband", "dband")
oracle("reverse_band", "SELECT user_id, friend_id, mask FROM kept", "kept")
oracle("reverse_adjacency", """
SELECT friend_id, CAST(count(*) AS BIGINT) AS n_users,
  string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS users
FROM kept GROUP BY friend_id""", "kept")
oracle("positives", "SELECT p1, p2 FROM positives", "positives")
# ---- candidates ----------------------------------------------------------------
oracle("common_friends", "SELECT p1, p2, common_cnt FROM candidates", "candidates")
oracle("label_candidates", "SELECT p1, p2, common_cnt, label FROM labelled", "labelled")
oracle("score_population", "SELECT p1, p2, score FROM score_pop", "score_pop")
# ---- ranking -------------------------------------------------------------------
oracle("flip_scores", "SELECT user_id, candidate_id, score FROM flipped", "flipped")
oracle("topk_recommend", "SELECT user_id, rank, candidate_id, score FROM topk", "topk")

# ---- more fixture views --------------------------------------------------------------
cte("ratios", """
SELECT p1, p2, common_cnt, label, deg1, deg2,
  round(common_cnt / CAST(greatest(deg1, deg2) AS DOUBLE), 6) AS ratio_max,
  round(common_cnt / CAST(least(deg1, deg2) AS DOUBLE), 6) AS ratio_min
FROM labelled""", "labelled")
cte("pf", """
SELECT p.p1, p.p2, p.friend_id FROM pairs p JOIN candidates c ON p.p1 = c.p1 AND p.p2 = c.p2""",
    "pairs", "candidates")
cte("twohop", """
SELECT a.p1, a.p2, max(r.common_cnt) AS max_common, CAST(sum(r.label) AS BIGINT) AS linked_pairs,
  max(r.ratio_max) AS max_ratio_maxdeg, max(r.ratio_min) AS max_ratio_mindeg
FROM pf a JOIN pf b ON a.p1 = b.p1 AND a.p2 = b.p2 AND a.friend_id < b.friend_id
JOIN ratios r ON r.p1 = a.friend_id AND r.p2 = b.friend_id
GROUP BY a.p1, a.p2""", "pf", "ratios")
cte("twohop_all", """
SELECT a.p1, a.p2, max(r.common_cnt) AS max_common, CAST(sum(r.label) AS BIGINT) AS linked_pairs,
  max(r.ratio_max) AS max_ratio_maxdeg, max(r.ratio_min) AS max_ratio_mindeg
FROM pairs a JOIN pairs b ON a.p1 = b.p1 AND a.p2 = b.p2 AND a.friend_id < b.friend_id
JOIN ratios r ON r.p1 = a.friend_id AND r.p2 = b.friend_id
GROUP BY a.p1, a.p2""", "pairs", "ratios")
cte("attrs", """
SELECT coalesce(d.user_id, p.user_id) AS user_id, d.deg, p.age, p.sex, p.city, p.region, p.known
FROM degree d FULL JOIN (
  SELECT user_id, CAST(coalesce(birth_date, 0) AS BIGINT) AS age, coalesce(gender, 0) AS sex,
    location_id AS city, coalesce(login_region, 0) AS region, TRUE AS known FROM profile) p
ON d.user_id = p.user_id""", "degree", "profile")
cte("pos", """
SELECT m.mask, coalesce(r.i, 0) AS i
FROM (SELECT DISTINCT mask FROM edges) m
LEFT JOIN (SELECT range AS i FROM range(1, 22)) r ON ((m.mask >> (r.i - 1)) & 1) = 1""", "edges")
CELL = "greatest(a.i, b.i) + 22 * least(a.i, b.i) - (least(a.i, b.i) * (least(a.i, b.i) + 1)) // 2"
cte("hist", f"""
SELECT h.p1, h.p2, h.cell, h.cnt FROM (
  SELECT p1, p2, cell, count(*) AS cnt FROM (
    SELECT DISTINCT pr.p1, pr.p2, pr.friend_id, {CELL} AS cell
    FROM pairs pr JOIN pos a ON a.mask = pr.mask1 JOIN pos b ON b.mask = pr.mask2) x
  WHERE cell >= 1 GROUP BY p1, p2, cell) h
JOIN (SELECT p1, p2 FROM pairs GROUP BY p1, p2 HAVING count(*) > {P.hist_min_support}) s
  ON h.p1 = s.p1 AND h.p2 = s.p2""", "pairs", "pos")
cte("pm", """
SELECT user_id AS p1, friend_id AS p2, mask FROM edges
WHERE friend_id > user_id AND friend_id IN (SELECT user_id FROM edges)""", "edges")

H1 = hsql("p1", "p2", "stratified")
H2 = hsql("p1", "p2", "bernoulli")
H3 = hsql("p1", "p2", "split")
H4 = hsql("p1", "p2", "thinning")
TRAIN_G = f"p1 % {M} <> {T7} AND p2 % {M} <> {T7}"
TEST_G = f"(p1 % {M} = {T7} OR p2 % {M} = {T7})"
HOLD_G = f"(p1 % {M} <> {T7} OR p2 % {M} <> {T7}) AND (p1 % {M} = {H6} OR p2 % {M} = {H6})"
cte("tdata", f"""
SELECT p1, p2, label, score FROM labelled
WHERE {TRAIN_G} AND (label = 1 OR {H1} < {P.negative_fraction!r}) AND {H2} <= {P.row_sample_rate!r}""",
    "labelled")
cte("train", f"SELECT * FROM tdata WHERE {H3} < {P.train_fraction!r}", "tdata")
cte("valid", f"SELECT * FROM tdata WHERE {H3} >= {P.train_fraction!r}", "tdata")
cte("hanti", f"""
SELECT l.p1, l.p2, l.label, l.score FROM labelled l ANTI JOIN train t ON t.p1 = l.p1 AND t.p2 = l.p2
WHERE (l.p1 % {M} <> {T7} OR l.p2 % {M} <> {T7}) AND (l.p1 % {M} = {H6} OR l.p2 % {M} = {H6})""", "labelled", "train")
cte("hold", f"SELECT * FROM hanti WHERE label = 0 OR {H4} < {P.holdout_positive_fraction!r}", "hanti")
cte("sc", """
SELECT CAST(score AS DOUBLE) AS threshold,
  CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
  CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg
FROM valid GROUP BY score""", "valid")
cte("curve", """
SELECT threshold, pos, neg,
  CAST(sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp,
  CAST(sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp,
  CAST(sum(pos) OVER () AS BIGINT) AS P_all, CAST(sum(neg) OVER () AS BIGINT) AS N_all
FROM sc""", "sc")
B2 = P.beta * P.beta
cte("fb", f"""
SELECT threshold,
  CASE WHEN tp + fp = 0 THEN CAST(1.0 AS DOUBLE) ELSE tp / CAST(tp + fp AS DOUBLE) END AS prec,
  CASE WHEN P_all = 0 THEN CAST(0.0 AS DOUBLE) ELSE tp / CAST(P_all AS DOUBLE) END AS rec
FROM curve""", "curve")
cte("fbeta", f"""
SELECT threshold, prec, rec,
  CASE WHEN prec + rec = 0 THEN CAST(0.0 AS DOUBLE)
       ELSE {1 + B2!r} * prec * rec / ({B2!r} * prec + rec) END AS f
FROM fb""", "fb")
cte("truth", """
SELECT p1 AS user_id, p2 AS neighbour_id FROM hold WHERE label = 1
UNION ALL SELECT p2 AS user_id, p1 AS neighbour_id FROM hold WHERE label = 1""", "hold")
cte("hrank", f"""
SELECT user_id, candidate_id, rank FROM (
  SELECT user_id, candidate_id,
    row_number() OVER (PARTITION BY user_id ORDER BY score DESC, candidate_id) AS rank
  FROM (SELECT p1 AS user_id, p2 AS candidate_id, score FROM hold
        UNION ALL SELECT p2 AS user_id, p1 AS candidate_id, score FROM hold) f
  WHERE score >= {P.threshold}) t
WHERE rank <= {P.top_k}""", "hold")

DEG_FEATS = """
  CASE WHEN coalesce(deg1, 0) <> 0 AND coalesce(deg2, 0) <> 0
       THEN round(common_cnt / CAST(greatest(coalesce(deg1, 0), coalesce(deg2, 0)) AS DOUBLE), 6)
       ELSE CAST(0.0 AS DOUBLE) END AS share_max,
  CASE WHEN coalesce(deg1, 0) <> 0 AND coalesce(deg2, 0) <> 0
       THEN round(common_cnt / CAST(least(coalesce(deg1, 0), coalesce(deg2, 0)) AS DOUBLE), 6)
       ELSE CAST(0.0 AS DOUBLE) END AS share_min,
  round(common_cnt / CAST(coalesce(deg2, 999999) AS DOUBLE), 6) AS share2_default"""
DEG_ALL = f"""
  round(ln(CAST(common_cnt AS DOUBLE)), 6) AS log_common,
  CASE WHEN coalesce(deg1, 0) <> 0 THEN round(common_cnt / CAST(deg1 AS DOUBLE), 6) ELSE CAST(0.0 AS DOUBLE) END AS share1,
  CASE WHEN coalesce(deg2, 0) <> 0 THEN round(common_cnt / CAST(deg2 AS DOUBLE), 6) ELSE CAST(0.0 AS DOUBLE) END AS share2,
  {DEG_FEATS},
  CAST(greatest(coalesce(deg1, 0), coalesce(deg2, 0)) AS BIGINT) AS deg_max,
  CAST(least(coalesce(deg1, 0), coalesce(deg2, 0)) AS BIGINT) AS deg_min"""
PROF_FEATS = """
  CAST(abs(coalesce(age1, 0) - coalesce(age2, 0)) AS BIGINT) AS age_gap,
  CAST(coalesce(sex1, 0) = coalesce(sex2, 0) AND coalesce(sex1, 0) <> 0 AS INTEGER) AS same_sex,
  CAST(coalesce(city1, -1) = coalesce(city2, -1) AND coalesce(city1, -1) <> -1 AS INTEGER) AS same_city,
  CAST((CASE WHEN known1 IS NULL THEN -1 ELSE region1 END) = (CASE WHEN known2 IS NULL THEN -1 ELSE region2 END)
       AND (CASE WHEN known1 IS NULL THEN -1 ELSE region1 END) <> -1 AS INTEGER) AS same_region"""
ATTR_JOIN = """
  LEFT JOIN (SELECT user_id AS u1, deg AS deg1, age AS age1, sex AS sex1, city AS city1, region AS region1,
                    known AS known1 FROM attrs) a1 ON x.p1 = a1.u1
  LEFT JOIN (SELECT user_id AS u2, deg AS deg2, age AS age2, sex AS sex2, city AS city2, region AS region2,
                    known AS known2 FROM attrs) a2 ON x.p2 = a2.u2"""

# ---- candidates (cont.) ----------------------------------------------------------------
oracle("common_friend_ids", """
SELECT p1, p2, CAST(count(*) AS BIGINT) AS n_common,
  string_agg(CAST(friend_id AS VARCHAR), ',' ORDER BY friend_id) AS friend_ids
FROM pf GROUP BY p1, p2""", "pf")
oracle("candidate_ratios", "SELECT * FROM ratios", "ratios")
# ---- features ----------------------------------------------------------------------------
oracle("degree_features", f"""
SELECT p1, p2, common_cnt, deg1, deg2,
  {DEG_ALL}
FROM (SELECT c.p1, c.p2, c.common_cnt, d1.deg AS deg1, d2.deg AS deg2 FROM candidates c
      LEFT JOIN degree d1 ON c.p1 = d1.user_id LEFT JOIN degree d2 ON c.p2 = d2.user_id) t""",
       "candidates", "degree")
oracle("profile_features", f"""
SELECT x.p1, x.p2, {PROF_FEATS}
FROM candidates x {ATTR_JOIN}""", "candidates", "attrs")
oracle("feature_table", f"""
SELECT p1, p2, label, common_cnt, {DEG_ALL}, {PROF_FEATS},
  CAST(coalesce(max_common, 0) AS BIGINT) AS max_common,
  CAST(coalesce(linked_pairs, 0) AS BIGINT) AS linked_pairs,
  coalesce(max_ratio_maxdeg, CAST(0.0 AS DOUBLE)) AS max_ratio_maxdeg,
  coalesce(max_ratio_mindeg, CAST(0.0 AS DOUBLE)) AS max_ratio_mindeg
FROM (SELECT l.p1, l.p2, l.label, l.common_cnt, t.max_common, t.linked_pairs, t.max_ratio_maxdeg,
             t.max_ratio_mindeg FROM labelled l LEFT JOIN twohop t ON l.p1 = t.p1 AND l.p2 = t.p2) x
{ATTR_JOIN}""", "labelled", "twohop", "attrs")
# ---- masks --------------------------------------------------------------------------------
oracle("mask_to_bits", "SELECT DISTINCT mask, lpad(bin(mask & 2097151), 21, '0') AS bits FROM edges", "edges")
oracle("mask_positions", """
SELECT mask, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS positions FROM pos GROUP BY mask""", "pos")
oracle("mask_pair_cells", f"""
SELECT mask1, mask2, string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) AS cells FROM (
  SELECT DISTINCT c.mask1, c.mask2, {CELL} AS cell
  FROM (SELECT DISTINCT mask1, mask2 FROM pairs) c JOIN pos a ON a.mask = c.mask1 JOIN pos b ON b.mask = c.mask2) t
GROUP BY mask1, mask2""", "pairs", "pos")
oracle("mask_pair_hist", "SELECT p1, p2, CAST(cell AS INTEGER) AS cell, cnt FROM hist", "hist")
oracle("mask_diag_counts", """
SELECT h.p1, h.p2, CAST(d.i AS INTEGER) AS type, h.cnt FROM hist h
JOIN (SELECT range AS i, range + 1 + 22 * range - (range * (range + 1)) // 2 AS cell FROM range(0, 21)) d
  ON h.cell = d.cell""", "hist")
oracle("edge_mask_bits", """
SELECT c.p1, c.p2, coalesce(lpad(bin(pm.mask & 2097151), 21, '0'), '000000000000000000000') AS bits
FROM candidates c LEFT JOIN pm ON c.p1 = pm.p1 AND c.p2 = pm.p2""", "candidates", "pm")
# ---- 2-hop ------------------------------------------------------------------------------------
oracle("twohop_stats", "SELECT * FROM twohop", "twohop")
oracle("twohop_all_pairs", "SELECT * FROM twohop_all", "twohop_all")
# ---- groups, samples, splits ----------------------------------------------------------------
oracle("train_group", f"SELECT p1, p2, label FROM labelled WHERE {TRAIN_G}", "labelled")
oracle("test_group", f"SELECT p1, p2, label FROM labelled WHERE {TEST_G}", "labelled")
oracle("holdout_group", f"SELECT p1, p2, label FROM labelled WHERE {HOLD_G}", "labelled")
oracle("holdout_anti", "SELECT p1, p2, label FROM hanti", "hanti")
oracle("holdout_thinning", "SELECT p1, p2, label FROM hold", "hold")
oracle("stratified_sample", f"""
SELECT p1, p2, label FROM labelled WHERE label = 1 OR {H1} < {P.negative_fraction!r}""", "labelled")
oracle("bernoulli_sample", f"SELECT p1, p2, label FROM labelled WHERE {H2} <= {P.row_sample_rate!r}",
       "labelled")
oracle("train_valid_split", f"""
SELECT p1, p2, label, CASE WHEN {H3} < {P.train_fraction!r} THEN 'train' ELSE 'valid' END AS part
FROM tdata""", "tdata")
oracle("class_balance", """
SELECT label, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share
FROM train GROUP BY label""", "train")
# ---- metrics -----------------------------------------------------------------------------------
oracle("roc_curve", """
SELECT threshold, pos, neg, tp, fp,
  CASE WHEN P_all = 0 THEN NULL ELSE round(tp / CAST(P_all AS DOUBLE), 6) END AS tpr,
  CASE WHEN N_all = 0 THEN NULL ELSE round(fp / CAST(N_all AS DOUBLE), 6) END AS fpr FROM curve""", "curve")
oracle("auc", """
SELECT round(sum(neg * (tp - pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS auc
FROM curve""", "curve")
oracle("roc_binned", """
SELECT bin, pos, neg,
  CAST(sum(pos) OVER (ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp,
  CAST(sum(neg) OVER (ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp
FROM (SELECT CAST(floor(score * 100) AS INTEGER) AS bin,
        CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
        CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg
      FROM valid GROUP BY 1) t""", "valid")
oracle("fbeta_by_threshold", """
SELECT threshold, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f, 6) AS fbeta FROM fbeta""",
       "fbeta")
oracle("best_threshold", """
SELECT threshold, round(f, 6) AS fbeta FROM fbeta ORDER BY f DESC, threshold DESC LIMIT 1""", "fbeta")
oracle("hidden_neighbours", "SELECT user_id, neighbour_id FROM truth", "truth")
oracle("ndcg", """
SELECT round(sum(coalesce(d.dcg, 0.0) / i.idcg) / count(*) * 1000.0, 6) AS ndcg_x1000,
  count(*) AS truth_users
FROM (SELECT user_id, count(*) AS n FROM truth GROUP BY user_id) nt
LEFT JOIN (SELECT r.user_id, sum(1.0 / log2(r.rank + 1.0)) AS dcg FROM hrank r
           JOIN truth t ON r.user_id = t.user_id AND r.candidate_id = t.neighbour_id GROUP BY r.user_id) d
  ON nt.user_id = d.user_id
JOIN (SELECT i AS n, sum(1.0 / log2(i + 1.0)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS idcg
      FROM (SELECT DISTINCT row_number() OVER (PARTITION BY user_id ORDER BY neighbour_id) AS i FROM truth) s) i
  ON i.n = nt.n""", "truth", "hrank")

# ---- sources and sinks --------------------------------------------------------------------
oracle("edges_from_adjacency", "SELECT user_id, friend_id, mask FROM edges", "edges")
oracle("demography_roundtrip", """
SELECT user_id, birth_date, CAST(gender AS INTEGER) AS gender, CAST(location_id AS INTEGER) AS location_id,
  CAST(login_region AS INTEGER) AS login_region FROM profile""", "profile")
oracle("candidates_scan", "SELECT p1, p2, common_cnt FROM candidates", "candidates")
oracle("candidates_bucket", f"SELECT p1, p2, common_cnt FROM candidates WHERE p1 % {P.n_buckets} = 33",
       "candidates")
oracle("reversed_lists_roundtrip", "SELECT user_id, friend_id, mask FROM kept", "kept")
oracle("table_preview", "SELECT user_id, friend_id, mask FROM edges ORDER BY user_id, friend_id LIMIT 50",
       "edges")
_SUMMARY_COLS = ["birth_date", "gender", "location_id", "login_region"]
oracle("profile_summary", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg(CAST({c} AS DOUBLE)), 6) AS mean,
  round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS stddev, CAST(min({c}) AS DOUBLE) AS min_value,
  CAST(max({c}) AS DOUBLE) AS max_value FROM profile""" for c in _SUMMARY_COLS), "profile")
oracle("log_degree_hist", """
SELECT bin, CAST(bin AS DOUBLE) * 0.5 AS bin_start, count(*) AS n
FROM (SELECT CAST(floor(ln(CAST(deg AS DOUBLE)) / 0.5) AS INTEGER) AS bin FROM degree) t GROUP BY bin""",
       "degree")
oracle("ranked_list_text", """
SELECT user_id, CAST(user_id AS VARCHAR) || chr(9) ||
  string_agg(CAST(candidate_id AS VARCHAR), chr(9) ORDER BY rank) AS line
FROM topk GROUP BY user_id""", "topk")
oracle("ranked_list_parse", "SELECT user_id, rank, candidate_id FROM topk WHERE user_id <> 0", "topk")
oracle("twohop_text_roundtrip", """
SELECT p1, p2, CAST(max_common AS DOUBLE) AS max_common, CAST(linked_pairs AS DOUBLE) AS linked_pairs,
  max_ratio_maxdeg, max_ratio_mindeg FROM twohop_all""", "twohop_all")
oracle("hidden_edges_text", "SELECT p1, p2 FROM hold WHERE label = 1", "hold")
oracle("probabilities_roundtrip", "SELECT user_id, candidate_id, score FROM flipped", "flipped")

# ---- ML (the scaler is checkable in SQL; the fitted models are rows-only) ------------------
from linkgraph.operators.features import FEATURE_COLS as _FC  # noqa: E402

cte("ftab", ORACLE["feature_table"][ORACLE["feature_table"].index("SELECT p1, p2, label, common_cnt,"):],
    "labelled", "twohop", "attrs")
cte("ftrain", f"""
SELECT * FROM ftab WHERE {TRAIN_G} AND (label = 1 OR {H1} < {P.negative_fraction!r})
  AND {H2} <= {P.row_sample_rate!r} AND {H3} < {P.train_fraction!r}""", "ftab")
oracle("scaled_features", "SELECT p1, p2, " + ", ".join(
    f"CASE WHEN sd_{c} IS NULL OR sd_{c} = 0 THEN CAST(0.0 AS DOUBLE) "
    f"ELSE round(CAST({c} AS DOUBLE) / sd_{c}, 6) END AS {c}" for c in _FC) +
    "\nFROM ftrain, (SELECT " + ", ".join(f"stddev_samp(CAST({c} AS DOUBLE)) AS sd_{c}" for c in _FC) +
    " FROM ftrain) s", "ftrain")

# ---- vectors of the job generations, ML inputs, run counts ----------------------------------
cte("fall", f"""
SELECT x.*, {DEG_ALL},
  {PROF_FEATS}, coalesce(lpad(bin(pm.mask & 2097151), 21, '0'), '000000000000000000000') AS bits
FROM (SELECT l.p1, l.p2, l.common_cnt, coalesce(t.max_common, 0) AS max_common,
        coalesce(t.linked_pairs, 0) AS linked_pairs, coalesce(t.max_ratio_maxdeg, 0.0) AS max_ratio_maxdeg,
        coalesce(t.max_ratio_mindeg, 0.0) AS max_ratio_mindeg
      FROM labelled l LEFT JOIN twohop t ON l.p1 = t.p1 AND l.p2 = t.p2) x
{ATTR_JOIN} LEFT JOIN pm ON x.p1 = pm.p1 AND x.p2 = pm.p2""", "labelled", "twohop", "attrs", "pm")
from linkgraph.operators.features import FEATURE_SETS as _FS  # noqa: E402

for _name in ("baseline", "extended", "short", "holdout"):
    _fs = _FS[_name]
    _cols = [f"CAST({c} AS DOUBLE)" for c in _fs.scalars]
    _cols += [f"CAST(substr(bits, {i + 1}, 1) AS DOUBLE)" for i in range(21)] if _fs.edge_bits else []
    oracle(f"vector_{_name}", "SELECT p1, p2, " + ", ".join(f"{c} AS x{i}" for i, c in enumerate(_cols)) + " FROM fall",
           "fall")
cte("diag", """
SELECT h.p1, h.p2, CAST(d.i AS INTEGER) AS type, h.cnt FROM hist h
JOIN (SELECT range AS i, range + 1 + 22 * range - (range * (range + 1)) // 2 AS cell FROM range(0, 21)) d
  ON h.cell = d.cell""", "hist")
oracle("type_shares", """
SELECT c.p1, c.p2, d.type, CAST(d.cnt AS DOUBLE) AS cnt,
  round(d.cnt / CAST(greatest(1, c.common_cnt) AS DOUBLE), 6) AS share
FROM candidates c JOIN diag d ON c.p1 = d.p1 AND c.p2 = d.p2""", "candidates", "diag")
cte("cov", """
SELECT g.x, g.y, (coalesce(b.sxy, 0.0) - coalesce(o1.s, 0.0) * coalesce(o2.s, 0.0) / nullif(n.n, 0)) / nullif(n.n - 1, 0) AS cov
FROM (SELECT CAST(x AS INTEGER) AS x, CAST(unnest(range(x, 253)) AS INTEGER) AS y FROM (SELECT range AS x FROM range(1, 253)) r) g
LEFT JOIN (SELECT CAST(a.cell AS INTEGER) AS x, CAST(c.cell AS INTEGER) AS y, CAST(sum(a.cnt * c.cnt) AS DOUBLE) AS sxy
      FROM hist a JOIN hist c ON a.p1 = c.p1 AND a.p2 = c.p2 AND a.cell <= c.cell GROUP BY 1, 2) b ON g.x = b.x AND g.y = b.y
LEFT JOIN (SELECT cell, CAST(sum(cnt) AS DOUBLE) AS s FROM hist GROUP BY cell) o1 ON g.x = o1.cell
LEFT JOIN (SELECT cell, CAST(sum(cnt) AS DOUBLE) AS s FROM hist GROUP BY cell) o2 ON g.y = o2.cell,
(SELECT CAST(count(*) AS DOUBLE) AS n FROM (SELECT DISTINCT p1, p2 FROM hist) t) n""", "hist")
oracle("mask_covariance", "SELECT x, y, round(cov, 6) + 0.0 AS cov FROM cov", "cov")
# a right projection leaves nothing but the traces of the covariance's powers
oracle("pca_certificate", f"""
, sym AS MATERIALIZED (SELECT x, y, cov FROM cov UNION ALL SELECT y, x, cov FROM cov WHERE x < y),
sq AS (SELECT a.x, b.y, sum(a.cov * b.cov) AS cov FROM sym a JOIN sym b ON a.y = b.x GROUP BY a.x, b.y)
SELECT 'residual' AS part, CAST(range AS INTEGER) AS i, CAST(0.0 AS DOUBLE) AS value FROM range(1, {_FS[P.feature_set].pca + 1})
UNION ALL SELECT unnest(['orthonormal', 'off_diagonal', 'order', 'leading']), 0, 0.0
UNION ALL SELECT 'moment', 1, round(sum(cov), 5) FROM sym WHERE x = y
UNION ALL SELECT 'moment', 2, round(sum(cov * cov), 5) FROM sym
UNION ALL SELECT 'moment', 3, round(sum(q.cov * s.cov), 5) FROM sq q JOIN sym s ON q.x = s.y AND q.y = s.x""", "cov")
_GS = _FS[P.feature_set]
oracle("model_gradient", "SELECT -1 AS term, round(CAST(sum(label) AS DOUBLE), 4) AS observed, TRUE AS at_optimum FROM ftrain\n"
       + "\n".join(f"UNION ALL SELECT {i}, round(sum(label * CAST({c} AS DOUBLE)), 4), TRUE FROM ftrain"
                   for i, c in enumerate(_GS.scalars))
       + f"\nUNION ALL SELECT CAST(range AS INTEGER), NULL, TRUE FROM range({len(_GS.scalars)}, {_GS.width})", "ftrain")
oracle("model_reload", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_differing FROM valid", "valid")
oracle("job_candidates", "SELECT p1, p2, common_cnt FROM candidates", "candidates")
oracle("job_hist", "SELECT p1, p2, CAST(cell AS INTEGER) AS cell, cnt FROM hist", "hist")
oracle("job_twohop", "SELECT * FROM twohop_all", "twohop_all")
oracle("job_train", "SELECT p1, p2, label FROM train", "train")
oracle("job_recommendations", "SELECT p1, p2 FROM score_pop", "score_pop")
oracle("job_holdout", "SELECT p1, p2, label FROM hold", "hold")
oracle("hidden_edges_order", """
SELECT row_number() OVER (ORDER BY p1 DESC, p2 DESC) AS position, p1, p2 FROM hold WHERE label = 1""", "hold")
oracle("prediction_labels", """
SELECT 'training' AS part, CAST(1 AS BIGINT) AS files, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM train
UNION ALL SELECT 'validation', 4, count(*), CAST(sum(label) AS BIGINT) FROM valid
UNION ALL SELECT 'test', 8, count(*), CAST(0 AS BIGINT) FROM score_pop""", "train", "valid", "score_pop")
oracle("run_counts", """
SELECT 'train' AS part, count(*) AS n, CAST(coalesce(sum(label), 0) AS BIGINT) AS positives FROM train
UNION ALL SELECT 'valid', count(*), CAST(coalesce(sum(label), 0) AS BIGINT) FROM valid
UNION ALL SELECT 'holdout', count(*), CAST(coalesce(sum(label), 0) AS BIGINT) FROM hold""", "train", "valid", "hold")
oracle("model_keys", """
SELECT DISTINCT 'pca' AS part, p1, p2 FROM hist UNION ALL SELECT 'scores', p1, p2 FROM valid""", "hist", "valid")
# ---- layouts ---------------------------------------------------------------------------------
oracle("edges_without_masks", "SELECT user_id, friend_id FROM edges", "edges")
oracle("edges_from_chunks", "SELECT user_id, friend_id, mask FROM edges", "edges")
oracle("adjacency_rejects", """
SELECT count(*) AS items, CAST(count(*) FILTER (friend_id % 10 = 0) AS BIGINT) AS rejected_items,
  CAST(count(*) FILTER (friend_id % 7 = 0 AND friend_id % 10 <> 0) AS BIGINT) AS unreadable_masks FROM edges""", "edges")
oracle("reversed_plain_roundtrip", "SELECT user_id, friend_id FROM kept", "kept")
for _n in ("hist_vectors_roundtrip", "hist_vectors_older_layout"):
    oracle(_n, "SELECT p1, p2, CAST(cell AS INTEGER) AS cell, cnt FROM hist", "hist")
oracle("roc_grouped", """
SELECT run, threshold, pos, neg,
  CAST(sum(pos) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp,
  CAST(sum(neg) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp
FROM (SELECT CAST((k - 1) // greatest(1, n // 100) AS INTEGER) AS run, max(threshold) AS threshold,
        CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg
      FROM (SELECT *, row_number() OVER (ORDER BY threshold DESC) AS k, count(*) OVER () AS n FROM sc) t GROUP BY 1) g""", "sc")
oracle("offline_lists", "SELECT user_id, rank, candidate_id FROM topk", "topk")
