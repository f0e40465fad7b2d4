"""Tokenising and hashing helpers against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from linkgraph.llm import text as T

TEXTS = st.lists(st.text(alphabet=st.sampled_from(list("aAbZ 09|.\n\t\x0b\x1cé漢 ")), max_size=40), max_size=8)


def cut(texts, kind, lower):
    buf, offs = T.raw(pa.array(texts, pa.string()))
    w = T.words(buf, offs, kind, lower)
    return [[w.buf[w.start[k]: w.end[k]].tobytes().decode() for k in range(w.first[i], w.first[i + 1])]
            for i in range(len(texts))], w


def lowered(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    assert cut(texts, T.SPACE, False)[0] == [re.findall(r"[^\x20\x09-\x0D]+", s) for s in texts]
    assert cut(texts, T.ALNUM, True)[0] == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(s)) for s in texts]


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 3))
def test_equal_grams_have_equal_hashes(texts, n):
    got, w = cut(texts, T.SPACE, False)
    start, h = T.ngram_hash(w, n)
    flat = [x for t in got for x in t]
    grams = [tuple(flat[i: i + n]) for i in start.tolist()]
    assert len(grams) == sum(max(0, len(t) - n + 1) for t in got)
    by = dict(zip(h.tolist(), grams, strict=True))
    assert all(by[x] == g for x, g in zip(h.tolist(), grams, strict=True))
    assert len(by) == len(set(grams))


def test_null_counts_as_empty_and_slices_keep_their_offsets():
    arr = pa.array(["ab c", None, "", "d"]).slice(1)
    buf, offs = T.raw(arr)
    assert bytes(buf) == b"d" and offs.tolist() == [0, 0, 0, 1]
    assert T.raw(pa.array([], pa.string()))[1].tolist() in ([0], [])


def test_chunks_keep_every_row_and_long_texts_whole():
    texts = ["x" * 10, "y" * 5000, "", None, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(5))], names=["text", "id"])
    out = [(p.column("id").to_pylist(), bytes(b)) for p, b, _ in T.chunks(iter([batch]), "text", 100)]
    assert [i for ids, _ in out for i in ids] == [0, 1, 2, 3, 4]
    assert b"".join(b for _, b in out).decode() == "".join(t or "" for t in texts)


def test_spread():
    assert T.spread(np.array([5, 9, 2]), np.array([2, 0, 3])).tolist() == [5, 6, 2, 3, 4]
