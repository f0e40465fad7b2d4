"""DuckDB SQL with the same results as the queries, where SQL can say them."""

from __future__ import annotations

from itertools import permutations

ORACLE: dict[str, str] = {}

SPACE_WORDS = r"[^\x20\x09-\x0D]+"
ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


MIX_PLAN = f"""
sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '{SPACE_WORDS}')), 0)::BIGINT AS size FROM {{docs}}),
per AS (SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM sized GROUP BY source),
caps AS (SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / w,
    source NULLS LAST) AS k FROM per),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
fit AS (SELECT arg_min(level, k) AS level FROM levels WHERE level <= cap / w),
targets AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM fit) * w), cap) AS target FROM levels),
rates AS (SELECT d.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT *, floor(rate)::BIGINT + CASE WHEN
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM rates)"""

ORACLE["op7_mix_sources"] = f"""WITH {MIX_PLAN.format(docs='documents')}
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM mixed"""

HITS = f"""
dw AS (SELECT doc_id, coalesce(regexp_extract_all({lower('text')}, '{ALNUM_WORDS}'), []) AS w FROM {{docs}}),
iw AS (SELECT item_id, regexp_extract_all({lower('text')}, '{ALNUM_WORDS}') AS w FROM benchmark),
pats AS (SELECT DISTINCT item_id, m, list_slice(w, i, i + m - 1) AS pat FROM
    (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
     FROM iw WHERE len(w) > 0)),
wins AS (SELECT doc_id, i, m, list_slice(w, i, i + m - 1) AS pat FROM
    (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM pats) WHERE len(w) >= m)),
occ AS (SELECT x.doc_id, x.i, x.m, p.item_id FROM wins x JOIN pats p ON x.m = p.m AND x.pat = p.pat),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM
    (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
    (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)"""

ORACLE["op8_decontaminate"] = f"""WITH {HITS.format(docs='documents')}
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
    coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
    coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN its t ON d.doc_id = t.doc_id"""

ORACLE["op4_embedding_near_dup"] = """WITH RECURSIVE
ok AS (SELECT DISTINCT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM ok UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(DISTINCT b) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
  e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN comp c ON e.vec_id = c.a LEFT JOIN deg d ON e.vec_id = d.a"""


def groups_sql(docs: str, width: int, percent: int) -> str:
    """CTEs up to comp(doc_id, n_shingles, component_id) of documents in `docs`."""
    return f"""
jw AS (SELECT doc_id, coalesce(regexp_extract_all({lower('text')}, '{SPACE_WORDS}'), []) AS w FROM {docs}),
js AS (SELECT DISTINCT doc_id, list_slice(w, i, i + {width - 1}) AS s FROM
    (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS i FROM jw WHERE len(w) > 0)),
jn AS (SELECT doc_id, count(*) AS n FROM js GROUP BY doc_id),
ji AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM js a JOIN js b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
jl AS (SELECT i.a, i.b FROM ji i JOIN jn x ON i.a = x.doc_id JOIN jn y ON i.b = y.doc_id
  WHERE 100 * i.k >= {percent} * (x.n + y.n - i.k)),
jr AS (SELECT a, a AS b FROM jl UNION SELECT jr.a, jl.b FROM jr JOIN jl ON jr.b = jl.a),
jc AS (SELECT a, min(b) AS c FROM jr GROUP BY a),
comp AS (SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
  FROM jw d LEFT JOIN jn n ON d.doc_id = n.doc_id LEFT JOIN jc c ON d.doc_id = c.a)"""


ORACLE["op10_jaccard_join"] = f"WITH RECURSIVE {groups_sql('documents', 4, 85)} SELECT * FROM comp"

ORACLE["op2_substring_dedup"] = f"""WITH
w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '{SPACE_WORDS}'), []) AS w FROM documents),
win AS (SELECT r, i, list_slice(w, i, i + 34) AS x FROM
    (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
rep AS (SELECT x FROM win GROUP BY x HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN rep ON win.x = rep.x),
word AS (SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM w)),
kept AS (SELECT a.r, string_agg(a.x, ' ' ORDER BY a.p) AS t FROM word a ANTI JOIN gone g ON a.r = g.r AND a.p = g.p GROUP BY a.r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN n ON w.r = n.r LEFT JOIN kept k ON w.r = k.r"""

# bytes are counted from 1; windows are told apart by their MD5
ORACLE["op9_suffix_array_dedup"] = """WITH
b AS (SELECT row_number() OVER () AS r, doc_id, coalesce(encode(text), ''::BLOB) AS b FROM documents),
win AS (SELECT r, i, md5(array_slice(b, i, i + 399)) AS x FROM
    (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM b WHERE octet_length(b) >= 400)),
rep AS (SELECT x FROM win GROUP BY x HAVING count(*) > 1),
hit AS (SELECT win.r, win.i FROM win JOIN rep ON win.x = rep.x),
edge AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT r, k, min(i) AS lo, max(i) + 399 AS hi FROM
    (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM edge) GROUP BY r, k),
n AS (SELECT r, sum(hi - lo + 1)::BIGINT AS n, count(*) AS spans, max(hi) AS last FROM run GROUP BY r),
piece AS (SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) + 1 AS lo, lo - 1 AS hi FROM run
  UNION ALL SELECT b.r, coalesce(n.last, 0) + 1 AS lo, octet_length(b.b) AS hi FROM b LEFT JOIN n ON b.r = n.r),
kept AS (SELECT p.r, string_agg(hex(array_slice(b.b, p.lo, p.hi)), '' ORDER BY p.lo) AS t
  FROM piece p JOIN b ON p.r = b.r WHERE p.lo <= p.hi GROUP BY p.r)
SELECT b.doc_id, octet_length(b.b)::BIGINT AS n_bytes, coalesce(n.n, 0)::BIGINT AS n_removed,
  coalesce(n.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.t, ''))) AS kept_sha256
FROM b LEFT JOIN n ON b.r = n.r LEFT JOIN kept k ON b.r = k.r"""

ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations("ABCDE"))

# every order walked step by step, its removals summed order by order
ORACLE["op11_filter_audit"] = f"""WITH
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x,
    coalesce(regexp_extract_all(text, '{SPACE_WORDS}'), []) AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN min(doc_id) OVER (PARTITION BY x) < doc_id THEN 16 ELSE 0 END AS m FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (l.good) AS good, count(*) FILTER (l.toxic) AS toxic
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, m),
o AS (SELECT o, unnest(range(1, 6)) AS step FROM (VALUES {ORDERS}) v(o)),
s AS (SELECT o, step, substr(o, step, 1) AS name, list_sum(list_transform(range(1, step), lambda i:
    (1 << (ascii(substr(o, i, 1)) - 65)))) AS bits FROM o),
b AS (SELECT o, step, name, coalesce(bits, 0)::INTEGER AS before, (1 << (ascii(name) - 65))::INTEGER AS bit FROM s),
r AS (SELECT c.part, b.o AS filter_order, b.step::INTEGER AS step, b.name,
    coalesce(sum(n) FILTER (m & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (m & before = 0 AND m & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (m & before <> 0 AND m & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (m = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (m & before = 0 AND m & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (m & before = 0 AND m & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM c, b GROUP BY c.part, b.o, b.step, b.name)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley FROM r"""


def _crc32_table() -> str:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)  # the reflected CRC-32 polynomial
        out.append(f"{x}::BIGINT")
    return "[" + ", ".join(out) + "]"


ORACLE["op13_importance_resampling"] = f"""WITH
d AS (SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all({lower('text')}, '{ALNUM_WORDS}'), []) AS w FROM documents),
i AS (SELECT coalesce(regexp_extract_all({lower('text')}, '{ALNUM_WORDS}'), []) AS w FROM benchmark),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
iw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM i) GROUP BY ALL),
tab AS (SELECT {_crc32_table()} AS tab),
words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM iw)),
hashed AS MATERIALIZED (SELECT w, xor(list_reduce([4294967295] || list_transform(range(0, len(h) // 2),
    lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1])),
    4294967295) % 10000 AS b FROM words, tab),
s AS (SELECT b, sum(n) AS n FROM dw JOIN hashed USING (w) GROUP BY b),
t AS (SELECT b, sum(n) AS n FROM iw JOIN hashed USING (w) GROUP BY b),
tot AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t),
g AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (tot.s + 10000)
    / ((s.n + 1)::DOUBLE * (tot.t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t ON s.b = t.b, tot),
w AS (SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM dw JOIN hashed USING (w) JOIN g USING (b) GROUP BY r),
sc AS (SELECT d.r, doc_id, len(d.w)::BIGINT AS n_features, CASE WHEN w.n IS NULL THEN 0
      ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296.0::DOUBLE)))::BIGINT AS noise FROM d LEFT JOIN w ON d.r = w.r),
able AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST) AS k,
    count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank
FROM sc LEFT JOIN able ON sc.r = able.r"""
