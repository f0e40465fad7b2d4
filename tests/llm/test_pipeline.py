"""The pipeline stage by stage on the nasty fixture, against brute force, with
extra columns whose names clash with the operators' own."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from linkgraph.llm import quality

CLASH = ["row", "size", "k", "j", "m", "spans", "key", "node", "copies", "score", "_text", "_row", "kept", "label"]


@pytest.fixture(scope="module")
def stages(spark, nasty):
    docs = spark.read.parquet(f"{nasty}/documents.parquet").withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})
    docs = docs.unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    out = [("documents", docs.collect())]
    for name, f in P.STAGES:
        docs = spark.createDataFrame(f(spark, docs, nasty).collect(), docs.schema)
        out.append((name, docs.collect()))
        assert docs.columns == out[0][1][0].__fields__
    return out


def lowered(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def test_quality_keeps_whole_rows(spark, stages, nasty):
    before, after = stages[0][1], stages[1][1]
    assert not Counter(map(repr, after)) - Counter(map(repr, before))
    assert 0 < len(after) < len(before)
    assert quality.DECISION == 0.7


def test_near_duplicates_leave_one_of_each_group(stages):
    before, after = stages[1][1], stages[2][1]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    rows = {r.doc_id: shingles(r.text) for r in before if r.doc_id is not None}
    root = {d: d for d in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for a in rows:
        for b in rows:
            both = len(rows[a] & rows[b])
            if a < b and both and 100 * both >= 80 * len(rows[a] | rows[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    keep = {d for d in rows if find(d) == d}
    assert Counter(r.doc_id for r in after) == Counter([*keep, *[None for r in before if r.doc_id is None]])
    assert not Counter(map(repr, after)) - Counter(map(repr, before))


def test_substring_stage_removes_repeated_windows(stages):
    before, after = stages[2][1], stages[3][1]
    ws = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in before]
    seen = Counter(tuple(w[i: i + 35]) for w in ws for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(before, ws, strict=True):
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i: i + 35])] > 1 for k in range(i, i + 35)}
        want[(r.doc_id, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r.text)] += 1
    assert Counter((r.doc_id, r.text) for r in after) == want


def test_decontamination_drops_documents_with_hits(stages, spark, nasty):
    before, after = stages[3][1], stages[4][1]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    pats = set()
    for r in spark.read.parquet(f"{nasty}/benchmark.parquet").collect():
        w = words(r.text)
        m = min(10, len(w))
        pats |= {tuple(w[i: i + m]) for i in range(len(w) - m + 1) if m}

    def hit(t):
        w = words(t)
        return any(tuple(w[i: i + len(p)]) == p for p in pats for i in range(len(w) - len(p) + 1))
    assert Counter(map(repr, after)) == Counter(repr(r) for r in before if not hit(r.text))


def test_mixing_repeats_rows(stages):
    before, after = stages[4][1], stages[5][1]
    kinds, got = Counter(map(repr, before)), Counter(map(repr, after))
    assert set(got) <= set(kinds) and all(got[k] <= 2 * n for k, n in kinds.items())


def test_pipeline_on_empty_tables(spark, nothing):
    assert P.run(spark, nothing).collect() == []
