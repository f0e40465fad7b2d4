"""The parts of the operators against brute force."""

import itertools
import math

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from linkgraph.llm import fmindex, jaccard, langid, lm, mixing, quality, repeats, toxicity, vectors, wumanber
from linkgraph.llm import text as T
from linkgraph.llm.components import components


# ---- FM-index --------------------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200), st.integers(0, 9))
def test_wavelet_rank(symbols, s):
    x = np.array(symbols)
    t = fmindex.WaveletTree(x, 10)
    i = np.arange(len(x) + 1)
    assert t.rank(np.full(len(i), s), i).tolist() == [int((x[:k] == s).sum()) for k in i]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(2, 4), min_size=1, max_size=12), min_size=1, max_size=8), st.integers(1, 4))
def test_stretches_cover_the_repeated_windows(segs, window):
    text = np.array([x for s in segs for x in [*s, 0]])
    size = np.array([len(s) for s in segs])
    begin = np.cumsum(size + 1) - (size + 1)
    index = fmindex.FmIndex(text, 5, int(size.max()) + 1)
    seen = {}
    for s in segs:
        for i in range(len(s) - window + 1):
            seen[tuple(s[i: i + window])] = seen.get(tuple(s[i: i + window]), 0) + 1
    want = {(k, i) for k, s in enumerate(segs) for i in range(len(s) - window + 1) if seen[tuple(s[i: i + window])] > 1}
    got = set()
    for k, a, b in zip(*fmindex.stretches(index, text, begin, size, np.ones(len(segs), np.int64), window), strict=True):
        got |= {(int(k), i) for i in range(int(a), int(b) - window + 1)}
    assert got == want


# ---- the repeat frame --------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab  \n")), max_size=60), min_size=1, max_size=4),
       st.sampled_from([(5, 3), (8, 4), (6, 6)]), st.booleans())
def test_equal_windows_have_equal_anchors(texts, sizes, by_words):
    window, gram = sizes
    units = repeats.word_units if by_words else repeats.byte_units
    buf, offs = T.raw(pa.array(texts))
    u = units(buf, offs, gram)
    s = repeats.segments(u, window, gram)
    assert s.count.sum() == np.maximum(np.diff(u.first) - window + 1, 0).sum()
    if by_words:
        flat = [t.split() for t in texts]
    else:
        flat = [list(t.encode()) for t in texts]
    seen = {}
    for d, at, n, key, solo in zip(s.doc, s.start, s.count, s.key, s.solo, strict=True):
        for i in range(at, at + n):
            seen.setdefault(tuple(flat[d][i: i + window]), set()).add((int(key), bool(solo)))
    assert all(len(x) == 1 for x in seen.values())


# ---- parity sketches -----------------------------------------------------------------------
def random_sets(rng, n, j):
    """Two sets of hashes with a Jaccard similarity of at least j."""
    a = rng.integers(1, 1 << 62, n).astype(np.uint64)
    drop = rng.integers(0, int(n * (1 - j)) + 1)
    b = a[drop:]
    add = int(max(0, (len(b) / j - n) * rng.random()))
    return np.unique(a), np.unique(np.append(b, rng.integers(1, 1 << 62, add).astype(np.uint64)))


def test_linked_sets_share_a_key_and_the_hamming_bound_holds():
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 100, 300, 540, 2000, 7000]:
        for _ in range(8 if n < 1000 else 2):
            a, b = random_sets(rng, n, 0.85)
            both = len(np.intersect1d(a, b))
            union = len(a) + len(b) - both
            if 100 * both < 85 * union:
                continue
            first, h = np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b])
            doc, key = jaccard.keys_of(first, h, 85)
            if union > both:  # equal sets need no key
                assert len(np.intersect1d(key[doc == 0], key[doc == 1])), n
            x, y = (np.frombuffer(s, np.uint64) for s in jaccard.sketches(first, h))
            w = min(len(x), len(y))
            far = int(np.bitwise_count(jaccard.fold(x, w) ^ jaccard.fold(y, w)).sum())
            assert far <= union - both <= jaccard.hamming_bound(len(a), len(b), 85)


def test_large_groups_are_compared_in_blocks():
    rng = np.random.default_rng(2)
    base = rng.integers(1, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.append(base[: 200 - k % 5], rng.integers(1, 1 << 62, 3 + 60 * (k % 3)).astype(np.uint64)))
            for k in range(30)]
    first = np.append(0, np.cumsum([len(s) for s in sets]))
    sk = jaccard.sketches(first, np.concatenate(sets))
    rows = pa.table({"i": [0] * 30, "j": [1] * 30, "own": [k % 2 for k in range(30)], "node": list(range(30)),
                     "comp": [k % 7 for k in range(30)], "n": [len(s) for s in sets], "sketch": sk})
    got = {tuple(x) for x in jaccard.compared(rows, 85).tolist()}
    for a, b in itertools.combinations(range(30), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        linked = 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both)
        if linked and a % 2 != b % 2 and a % 7 != b % 7:
            assert (a, b) in got


# ---- Wu-Manber ---------------------------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=400), st.sets(st.tuples(*[st.integers(0, 3)] * 4), min_size=1, max_size=5))
def test_wu_manber_finds_every_occurrence(ids, patterns):
    pats = sorted(patterns)
    length = wumanber.Length(np.array(pats), [np.array([k]) for k in range(len(pats))])
    pos, who = length.search(np.array(ids, np.int64))
    want = {(i + 3, k) for i in range(len(ids) - 3) for k, p in enumerate(pats) if tuple(ids[i: i + 4]) == p}
    assert set(zip(pos.tolist(), who.tolist(), strict=True)) == want


def test_benchmark_in_several_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x y"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(k, t) for k, t in enumerate(["a b c", "c d e", "y", "q r s", "E F"])],
                                  "item_id long, text string")
    one = sorted(map(repr, wumanber.contamination(docs, items, 3).drop("row").collect()))
    monkeypatch.setattr(wumanber, "BLOCK_WORDS", 1)
    assert len(list(wumanber._blocks(items, 3))) > 2
    assert sorted(map(repr, wumanber.contamination(docs, items, 3).drop("row").collect())) == one


# ---- line field ----------------------------------------------------------------------------------
def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    first = np.array([0, 4, 4, 5, 8])
    emit, start, trans = rng.normal(size=8), 0.7, rng.normal(size=(2, 2))
    good, counts, log_z = quality.marginals(first, emit, start, trans)
    want, want_counts, want_z = np.zeros(8), np.zeros((2, 2)), 0.0
    for a, b in itertools.pairwise(first):
        total, acc, cnt = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            s = sum(e for e, v in zip(emit[a:b], y, strict=True) if v) + (start if y and y[0] else 0)
            s += sum(trans[i, j] for i, j in itertools.pairwise(y))
            p = math.exp(s)
            total += p
            acc += p * np.array(y)
            for i, j in itertools.pairwise(y):
                cnt[i, j] += p
        if b > a:
            want[a:b], want_z = acc / total, want_z + math.log(total)
            want_counts += cnt / total
    assert np.allclose(good, want) and np.allclose(counts, want_counts) and abs(log_z - want_z) < 1e-9


def test_lines_without_words_count_for_nothing():
    buf, offs = T.raw(pa.array(["one two\n\n \nthree", "", None, "x"]))
    x = quality.lines(buf, offs)
    assert x.first.tolist() == [0, 2, 2, 2, 3] and x.size.tolist() == [7, 5, 1]


# ---- language model --------------------------------------------------------------------------------
def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    params = lm.Parameters(*(rng.normal(size=(n, lm.DIM)) for n in (lm.CONTEXTS, lm.CONTEXTS, lm.CLASSES)),
                           rng.normal(size=lm.CLASSES))
    model = lm.normalised(params, None)
    for c1, c2 in ((0, 0), (5, lm.CONTEXTS - 1), (lm.CONTEXTS - 1, lm.CONTEXTS - 1)):
        assert abs(np.exp(model.class_ln(c1, c2, np.arange(lm.CLASSES))).sum() - 1) < 1e-9
    again = lm.Parameters.unpack(params.pack())
    assert np.allclose(again.q, params.q, atol=1e-6)


def test_shares_in_a_class_sum_to_one(spark):
    rows = [(k, n) for k, n in zip(range(64 * 100, 64 * 100 + 5000), itertools.cycle((1, 1, 2, 3, 40)))]
    rows = [(k, n) for k, n in rows if k % 64 in (3, 7)] + [(lm.END_KEY, 9)]
    v = lm.vocabulary(spark.createDataFrame(rows, "key long, n long"))
    assert v.tokens == sum(n for _, n in rows) and v.types == len(rows)
    count, klass = v.find(np.array([k for k, _ in rows], np.uint64))
    assert count.tolist() == [n for _, n in rows]
    for s in (3, 7):
        mine = klass == lm.TOP + s
        if mine.any():
            total = np.exp(v.within(count[mine], klass[mine])).sum()
            total += np.exp(v.within(np.zeros(1), np.array([lm.TOP + s])))[0]
            assert abs(total - 1) < 1e-9


# ---- the others ---------------------------------------------------------------------------------------
def test_nnpu_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(1)
    sets = lambda n, p: [np.unique(np.append(rng.integers(100, 2000, 30), rng.integers(0, 10, 3) if rng.random() < p else []))
                         .astype(np.int64) for _ in range(n)]
    model = toxicity.fit(sets(400, 1), sets(2000, 0.2), 0.2)
    dense = np.zeros(toxicity.DIMS)
    dense[model.features] = model.weights
    f = lambda s: dense[s].sum() + model.bias
    assert np.mean([f(s) > 0 for s in sets(300, 1)]) > 0.95
    assert np.mean([f(s) > 0 for s in sets(300, 0)]) < 0.05


def test_rare_marked_words_are_features():
    rng = np.random.default_rng(2)
    text = lambda *marked: np.unique(np.append(rng.integers(1000, 3000, 30), marked)).astype(np.int64)
    positive = [text(i // 16) for i in range(4000)]  # 250 words, each in 0.4% of them
    unlabelled = [text(*(rng.integers(0, 250, 1) if rng.random() < 0.1 else ())) for _ in range(12_000)]
    model = toxicity.fit(positive, unlabelled, 0.1)
    dense = np.zeros(toxicity.DIMS)
    dense[model.features] = model.weights
    assert np.mean([dense[text(i)].sum() + model.bias > 0 for i in range(250)]) > 0.9
    assert np.mean([dense[text()].sum() + model.bias > 0 for _ in range(500)]) < 0.05


def test_language_normal_form():
    assert langid.normal("HE%% llo\n42 é".lower().encode()) == "he llo é".encode()


def test_languages_of_long_texts_are_learned(spark):
    rng = np.random.default_rng(9)

    def text(letters):
        words = ["".join(rng.choice(list(letters), 5)) for _ in range(40)]
        return lambda n: " ".join(rng.choice(words, n // 6 + 1))[:n]

    a, b, c = text("abcdefgh"), text("ijklmnop"), text("qrstuvwx")
    rows = [(i, a(20_000 + i), "long") for i in range(5)] + [(10 + i, b(12_000), "mid") for i in range(64)]
    rows += [(100 + i, c(300), "short") for i in range(3)] + [(200, "7 " * 50_000 + a(50), "odd")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.learn(train)
    assert list(got) == ["long", "mid", "odd", "short"]
    assert all(len(d) <= langid.DICT_BYTES for d in got.values())
    own = {lang: [langid.normal(t.encode()) for _, t, x in rows if x == lang] for lang in got}
    share = (langid.DICT_BYTES - langid.DOCS_PER_LANG) // 64
    assert all(t[:share] in got["mid"] for t in own["mid"])
    assert all(t[: 19_000] in got["long"] for t in own["long"])
    assert all(t in got["short"] for t in own["short"]) and got["odd"] == own["odd"][0]
    docs = spark.createDataFrame([(1, a(900)), (2, b(900)), (3, c(900))], "doc_id long, text string")
    del got["odd"]
    pred = {r.row.doc_id: r.lang_pred for r in langid.predict(docs, got).collect()}
    assert pred == {1: "long", 2: "mid", 3: "short"}


def test_components_on_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 4000), (4000, 4000)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[k] == 1000 for k in range(1000, 1400))
    assert got[4000] == got[5000] == 4000 and len(got) == 301 + 400 + 2
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_vector_passes_reach_the_recall(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(120, 32))
    x = np.concatenate([c + rng.normal(size=(8, 32)) * s for c, s in zip(centre, np.linspace(0.05, 0.35, 120), strict=True)])
    reps = spark.createDataFrame([(i, 1, 0, v.tolist()) for i, v in enumerate(x)],
                                 "rep long, copies long, label int, embedding array<double>")
    got = {(r.a, r.b) for r in vectors.links(reps, 0.93).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.93, 1))
    want = set(zip(a.tolist(), b.tolist(), strict=True))
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 500


def linked_rows(x, threshold=0.93):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T >= threshold


def test_vector_group_larger_than_a_partition(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART_ROWS", 100)
    rng = np.random.default_rng(6)
    base = rng.normal(size=32)
    x = np.concatenate([rng.normal(size=(300, 32)), base + rng.normal(size=(300, 32)) * 1e-3,
                        base * np.arange(1, 601)[:, None]])
    reps = spark.createDataFrame([(i, 1, 0, v.tolist()) for i, v in enumerate(x)],
                                 "rep long, copies long, label int, embedding array<double>")
    got = {(r.a, r.b) for r in vectors.links(reps, 0.93, passes=2).collect()}
    a, b = np.nonzero(np.triu(linked_rows(x), 1))
    assert len(a) >= 900 * 899 // 2 and got == set(zip(a.tolist(), b.tolist(), strict=True))


def test_scaled_copies_are_one_cell(spark):
    rng = np.random.default_rng(8)
    a, b, c = rng.normal(size=(3, 32))
    b -= a * (a @ b) / (a @ a)
    b *= np.linalg.norm(a) / np.linalg.norm(b)
    edge = [k * a + np.sqrt(1 - k * k) * b for k in (0.93 - 1e-3, 0.93 - 5e-7, 0.93 + 5e-7, 0.93 + 1e-3)]
    x = np.concatenate([v * np.arange(1, n + 1)[:, None] for v, n in ((a, 2000), (c, 500), *((e, 7) for e in edge))])
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)],
                                 "vec_id long, embedding array<float>, label int")
    _, reps = vectors.classes(rows)
    assert vectors.cells(reps).select("cell").distinct().count() < 100
    want = linked_rows(x.astype(np.float64)).sum(1) - 1
    got = {r.vec_id: r for r in vectors.near_duplicates(rows).collect()}
    assert [got[i].n_links for i in range(len(x))] == want.tolist()
    assert {got[i].component_id for i in range(2000)} == {0} and {got[i].component_id for i in range(2000, 2500)} == {2000}
    assert sum(r.kept for r in got.values()) == len({r.component_id for r in got.values()})


def test_mix_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i % 50), ("a", "b", "c", None)[i % 4] if i % 3 else "a") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = mixing.plan(docs).toPandas()
    per = p.groupby(p["source"].fillna("~")).agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"))
    assert abs(per.target.sum() - 1.5 * per["size"].sum()) < 1e-6 * per["size"].sum()
    assert (per.target <= 2 * per["size"]).all() and (abs(per.taken - per.target) < 0.06 * per.target + 100).all()
    assert (p.taken <= 2 * p["size"]).all()
    out = mixing.emit(mixing.plan(docs))
    assert out.columns == docs.columns and out.count() == p.copies.sum()


def test_salted_join_gives_the_same_plan(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x y z"[: 1 + i % 5], "s" if i % 3 else None) for i in range(60)],
                                 "doc_id long, text string, source string")
    one = sorted(map(repr, mixing.plan(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, mixing.plan(docs).collect())) == one
