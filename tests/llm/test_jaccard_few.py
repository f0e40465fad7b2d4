"""Shared keys of a few nodes leave the rounds and are compared whole, once."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkgraph.llm import jaccard


@pytest.mark.parametrize("batch", [3, 1000])
def test_few_nodes_of_a_key_are_told_apart(spark, batch):
    rng = random.Random(4)
    rows = [(k, n) for k in range(300) for n in rng.sample(range(90), rng.choice([1, 1, 2, 3, 8, 9, 40]))]
    want = defaultdict(set)
    for k, n in rows:
        want[k].add(n)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(rows + rows[::3], "key long, node long")
        got = [(r.key, r.node, r.few) for r in jaccard.shared(df).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(got) == len(set(got)) == len({x[:2] for x in got})
    by = defaultdict(set)
    flags = defaultdict(set)
    for k, n, few in got:
        by[k].add(n)
        flags[k].add(few)
    for k, nodes in want.items():
        assert by.get(k, set()) == nodes or (len(nodes) == 1 and k not in by), k
        if len(nodes) > jaccard.WHOLE:
            assert flags[k] == {False}
        assert len(flags[k]) <= 1
    # only keys at the edges of the partitions are treated as large ones without need
    edges = [k for k, nodes in want.items() if len(nodes) <= jaccard.WHOLE and flags[k] == {False}]
    assert len(edges) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_keys_of_two_texts_take_no_part_in_the_rounds(spark, monkeypatch):
    """Texts that share a passage share keys: the rounds' semi join must not list these."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for k in range(120):
        passage = [rng.choice(words) for _ in range(60)]
        rows += [(3 * k + j, " ".join(passage + [rng.choice(words) for _ in range(60)])) for j in range(2)]
        rows.append((3 * k + 2, " ".join(passage + rows[-1][1].split()[60:-1])))  # all words but the last
    seen = []
    real = jaccard.still_open
    monkeypatch.setattr(jaccard, "still_open", lambda m, c: seen.append((m.count(), real(m, c))) or seen[-1][1])
    monkeypatch.setattr(jaccard, "partners", lambda *a, real=jaccard.partners: seen.append((a[0].count(),)) or real(*a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.joined(docs, 4, 85).collect()}
    assert got == {d: d - 1 if d % 3 == 2 else d for d, _ in rows}
    pieces = jaccard.described(docs, 4, 85).select("node", F.explode("keys").alias("key"))
    assert jaccard.shared(pieces).count() > 1000
    assert max(x[0] for x in seen) < 100  # what stands at the tasks' edges
