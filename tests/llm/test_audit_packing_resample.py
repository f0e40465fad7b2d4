"""The filter audit, the packing and the resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from linkgraph.llm import audit, packing, resample
from linkgraph.llm.queries import QUERIES, tokenizer_file


def texts(path):
    t = pq.read_table(f"{path}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], t["lang"], strict=True))


# ---- filter audit ---------------------------------------------------------------------------
@pytest.mark.parametrize("names", ["A", "AB", "ABCD", "ABCDE"])
def test_lattice_counts_orders(names):
    edges = audit.lattice(names)
    every = ["".join(o) for o in permutations(names)]
    assert len(edges) == len(names) << (len(names) - 1)
    for e in edges:
        assert e["paths"] == len(e["orders"]) == len(set(e["orders"]))
        for o in e["orders"]:
            before = sum(1 << names.index(c) for c in o[:e["step"] - 1])
            assert before == e["state"] and o[e["step"] - 1] == e["name"]
    assert Counter((o, e["step"]) for e in edges for o in e["orders"]) == Counter(
        (o, k) for o in every for k in range(1, len(names) + 1))


def test_op11_against_walking_every_order(spark, nasty):
    rows = texts(nasty)
    lab = pq.read_table(f"{nasty}/labels.parquet").to_pydict()
    good = {d for d, q in zip(lab["doc_id"], lab["quality"], strict=True) if q == 1}
    toxic = {d for d, q in zip(lab["doc_id"], lab["toxic"], strict=True) if q == 1}
    first = {}
    for d, t, _ in rows:
        first[t or ""] = min(d, first.get(t or "", d))
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": first[t] < d}
        docs.append((lang or "", d, {f for f in fails if fails[f]}))
    want, shapley = {}, Counter()
    for part in {p for p, _, _ in docs}:
        for order in permutations("ABCDE"):
            left = [x for x in docs if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                out = [x for x in left if f in x[2]]
                left = [x for x in left if f not in x[2]]
                redundant = sum(f in x[2] for x in gone)
                gone += out
                shapley[part, f] += len(out)
                want[part, "".join(order), step] = (
                    len(left), len(out), redundant, sum(x[2] == {f} for x in docs if x[0] == part),
                    sum(x[1] in good for x in out), sum(x[1] in toxic for x in out))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in QUERIES["op11_filter_audit"](spark, nasty).collect()}
    assert got == {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_audit_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "a", "x", 1), (None, "a", "x", 1), (5, "a", "x", 1), (5, "a", None, 1),
                                  (7, "a", "x", 1), (8, None, "x", 1), (9, "", "x", 1)],
                                 "doc_id long, text string, lang string, mask int")
    labels = spark.createDataFrame([(5, 0, None), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    letters, counted = audit.masks(docs, labels)
    assert letters == "ABCDE"
    got = {(r["part"], r["mask"]): (r["n"], r["n_good"], r["n_toxic"]) for r in counted.collect()}
    # 5 is first of its text in both its rows, 7 repeats it; ids that are null are never repeats; 9 repeats 8
    assert {k: v for k, v in got.items() if v[0]} == {("x", 1): (4, 1, 0), ("x", 17): (2, 0, 0), ("", 1): (1, 1, 0)}


# ---- packing --------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_file())
    t.encode_special_tokens = True
    return t


def test_encoder_equals_whole_texts(tokenizer):
    rng = random.Random(5)
    odd = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u200b", "\u180e",
           "\ufeff", "a", "Ab", "don't", "'s", "123", "!?", "é", "漢字", "🙂", "<|endoftext|>", "_", "-"]
    enc = packing.Encoder(tokenizer_file())
    for _ in range(3000):
        t = "".join(rng.choice(odd) for _ in range(rng.randrange(1, 12)))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for x in t:
        assert np.frombuffer(enc.encode(x or ""), "<u4").tolist() == tokenizer.encode(x or "", add_special_tokens=False).ids


def plain_best_fit(histogram, capacity):
    """Piece by piece; the number of sequences and how full they are."""
    bins = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [r for r in bins if r >= length]
            room = min(fits) if fits else capacity
            if fits:
                bins.remove(room)
            bins.append(room - length)
    return Counter(bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 64, 100])
    hist = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 25))}
    plan = packing.best_fit(hist, capacity)
    used, ranks = defaultdict(list), defaultdict(list)
    for length, first, n, sequence, each, place in plan:
        for k in range(n):
            used[sequence + k // each].append((place + k % each * length, length))
            ranks[length].append(first + k)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in hist.items()}
    rooms = Counter()
    for held in used.values():
        at = 0
        for place, length in sorted(held):
            assert place == at
            at += length
        rooms[capacity - at] += 1
    assert rooms == plain_best_fit(hist, capacity)
    assert len(plan) <= 4 * capacity * (math.log2(capacity) + 1)


def test_plan_size_follows_the_capacity_not_the_corpus():
    rng = random.Random(1)
    hist = {n: rng.randint(1, 10 ** 9) for n in range(1, 2049)}
    plan = packing.best_fit(hist)
    assert len(plan) <= 4 * 2048 * 12
    assert sum(n for _, _, n, _, _, _ in plan) == sum(hist.values())


@pytest.mark.parametrize("group", [3, 2000])
def test_op12_places_every_piece(spark, nasty, tokenizer, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    want = Counter()
    total = 0
    for d, t, _ in texts(nasty):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = QUERIES["op12_best_fit_packing"](spark, nasty).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) == sum(plain_best_fit(Counter(r.length for r in rows), 2048).values())
    assert len(held) <= 1.05 * math.ceil(total / 2048) + 1


def test_sequences_hold_the_documents_ids(spark, tokenizer):
    docs = spark.createDataFrame([(i, "some words here " * i, "clash") for i in range(40)], "doc_id int, text string, ids string")
    rows = packing.packed(docs, tokenizer_file(), capacity=50, with_ids=True)
    assert dict(rows.dtypes)["doc_id"] == "int"
    found = defaultdict(dict)
    seqs = {r.sequence_id: r.ids for r in packing.sequences(rows).collect()}
    for r in rows.collect():
        found[r.doc_id][r.start] = seqs[r.sequence_id][r.offset: r.offset + r.length]
    for i in range(40):
        ids = [x for _, part in sorted(found[i].items()) for x in part]
        assert ids == tokenizer.encode("some words here " * i, add_special_tokens=False).ids + [0]


# ---- resampling -----------------------------------------------------------------------------
def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_against_plain_counts(spark, nasty, longest):
    rows = [(d, t) for d, t, _ in texts(nasty)]
    target = pq.read_table(f"{nasty}/benchmark.parquet")["text"].to_pylist()

    def feats(t):
        w = plain_words(t)
        return [zlib.crc32(" ".join(w[i: i + n]).encode()) % 10000 for n in range(1, longest + 1)
                for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in rows for b in feats(x)), Counter(b for x in target for b in feats(x))
    ns, nt = sum(s.values()), sum(t.values())
    want = []
    for d, x in rows:
        g = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in feats(x)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        want.append((d, len(plain_words(x)), len(g), weight,
                     weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0]))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score int, _row int")
    items = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample.resample(docs, items, longest=longest).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    drawn = sorted((r.rank, r.doc_id, r.score) for r in got if r["rank"] is not None)
    assert drawn == [(i, w[0], w[4]) for i, w in enumerate(able[:len(able) * 10 // 100], 1)]


@pytest.mark.parametrize("probes", [1, 2, 15])
def test_cut_by_bisection(spark, monkeypatch, probes):
    monkeypatch.setattr(resample, "PROBES", probes)
    rng = random.Random(probes)
    rows = [(rng.randint(-3, 3) if rng.random() < 0.8 else rng.randint(-10 ** 6, 10 ** 6), rng.choice([1, 2, -(1 << 63)]), i)
            for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for want in (0, 1, 2, 57, 150, 299, 300):
        got = df.where(resample.cut(df, ["a", "b", "c"], want)).collect()
        assert sorted(map(tuple, got), reverse=True) == sorted(rows, reverse=True)[:want]


def test_ranks_of_repeated_rows_and_null_ids(spark):
    text = "word " * 25
    docs = spark.createDataFrame([(None, text)] * 3 + [(1, text)] * 10 + [(i, text) for i in range(100, 187)],
                                 "doc_id long, text string")
    out = resample.resample(docs, docs.select("text").limit(0), percent=50).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 51))
    scores = [(r["rank"], r["score"]) for r in out if r["rank"]]
    assert [s for _, s in sorted(scores)] == sorted((s for _, s in scores), reverse=True)
    worst = min(s for _, s in scores)
    assert all(r["score"] <= worst for r in out if not r["rank"])


def test_numbered_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(resample, "ROWS_PER_RANGE", 7)
    df = spark.range(100).select((F.col("id") % 10).alias("a"), F.col("id").alias("b"))
    got = resample.numbered(df, ["a", "b"], 100).collect()
    want = sorted(((i % 10, i) for i in range(100)), reverse=True)
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 101))


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, "word " * (20 + i), i) for i in range(30)], "doc_id long, text string, rank long")
    out = resample.drawn_documents(docs, resample.resample(docs, docs.select("text")))
    rows = out.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and all(r["row"]["rank"] == r["row"]["doc_id"] for r in rows)


def test_features_of_bytes():
    n, at = resample.features("Ab é-ÉÉ\x00z9", 1, 10000)
    assert n == 4 and at.tolist() == [zlib.crc32(w.encode()) % 10000 for w in ("ab", "é", "ÉÉ", "z9")]
    assert pa.array(at).type == pa.int64()
