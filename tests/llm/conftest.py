"""Small tables with every nasty case, written as Parquet for the queries."""

import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = [a + b for a in ("ta", "lo", "mi", "re", "su", "ba") for b in ("n", "rk", "st", "de", "qu", "é", "Z.")]
BAD = ["%%%", "$$$", "|", "###"]
TOXIC = ["vile", "rotten", "filth"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n))


def documents(rng):
    """(doc_id, text, lang, source, quality, toxic)"""
    rows = []

    def add(text, lang="en", source="s1", quality=1, toxic=0):
        rows.append((len(rows), text, lang, source, quality, toxic))

    passage = sentence(rng, 70)
    for i in range(60):
        lang = ("en", "xx")[i % 2]
        base = sentence(rng, int(rng.integers(20, 160)))
        if lang == "xx":
            base = base.translate(str.maketrans("tlmrsb", "zvwxkj"))
        if i % 5 == 0:
            base = base + "\n" + passage + "\n" + sentence(rng, 12)
        if i % 4 == 1:
            base = " ".join(w + BAD[k % 4] for k, w in enumerate(base.split()))
        if i % 6 == 2:
            base += " " + " ".join(rng.choice(TOXIC, 3))
        add(base, lang, f"s{i % 4}", 0 if i % 4 == 1 else 1, int(i % 6 == 2))
    for i in (3, 3, 3, 7, 10, 15):
        add(rows[i][1], source="s0")                      # exact copies
    for i in (2, 4, 6, 8, 14, 16):
        w = rows[i][1].split()
        w[len(w) // 2] = "altered"
        add(" ".join(w), source=None)                     # near copies
    add(None)
    add("")
    add(" \t\n ")
    add("one")
    add("one")
    add("two words", None, "")
    add("ha " * 300)
    add("ha " * 300 + "ho " * 250 + sentence(rng, 40))
    add("Ha " * 30 + "ha " * 40)
    add("xy" * 900)                                       # one long word
    add(sentence(rng, 6000), source="s2")                 # a very long text
    add("漢字 " * 50 + "é" * 500)
    add("123 456 !!")
    return rows


def write(path, rows, rng, dup=True):
    os.makedirs(path, exist_ok=True)
    if dup and rows:
        rows = rows + [rows[5], rows[5]]                  # repeated rows
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    pq.write_table(pa.table({"doc_id": pa.array(cols[0], pa.int64()), "text": pa.array(cols[1], pa.string()),
                             "lang": pa.array(cols[2], pa.string()), "source": pa.array(cols[3], pa.string()),
                             "n_chars": pa.array([len(t or "") for t in cols[1]], pa.int64())}),
                   f"{path}/documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(cols[0], pa.int64()), "quality": pa.array(cols[4], pa.int32()),
                             "toxic": pa.array(cols[5], pa.int32())}), f"{path}/labels.parquet")
    items = []
    for i, r in enumerate(rows[:12:3]):
        w = r[1].split()
        items.append((100 + i, " ".join(w[3:25]).upper() if i % 2 else " ".join(w[5:18])))
    if rows:
        items += [(9, "two words"), (10, None), (11, ""), (12, "one"), (12, "one"), (13, "never seen in any text"),
                  (14, "two words")]
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()),
                             "text": pa.array([t for _, t in items], pa.string())}), f"{path}/benchmark.parquet")
    vecs = []
    if rows:
        centre = rng.normal(size=(6, 16))
        for i in range(120):
            vecs.append((i, (centre[i % 6] + rng.normal(size=16) * (0.1 if i % 3 else 0.6)).tolist(), i % 4 % 3))
        vecs += [(120, vecs[0][1], 0), (121, vecs[0][1], 1), (122, vecs[0][1], None), (123, None, 0),
                 (124, [0.0] * 16, 0), (125, [float("nan")] + [1.0] * 15, 0), (126, [None] + [1.0] * 15, 0),
                 (127, [float("inf")] + [1.0] * 15, 0), (128, [], 0), (129, [-2 * x for x in vecs[0][1]], 0),
                 (130, [3 * x for x in vecs[0][1]], 0), vecs[0], (131, [1.0, 2.0], 0), (132, [2.0, 4.0], 0)]
    pq.write_table(pa.table({"vec_id": pa.array([v[0] for v in vecs], pa.int64()),
                             "embedding": pa.array([v[1] for v in vecs], pa.list_(pa.float32())),
                             "label": pa.array([v[2] for v in vecs], pa.int32())}), f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="session")
def nasty():
    rng = np.random.default_rng(7)
    return write(tempfile.mkdtemp(prefix="llm-fixture-"), documents(rng), rng)


@pytest.fixture(scope="session")
def nothing():
    return write(tempfile.mkdtemp(prefix="llm-empty-"), [], np.random.default_rng(0))
