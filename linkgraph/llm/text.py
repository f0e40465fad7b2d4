"""Vectorised tokenising of Arrow text columns (runs inside Spark tasks).

A batch's texts are handled as one byte buffer with offsets; words are found
by a byte-class table and hashed by a polynomial prefix sum, so no Python
object is made per word.  Work is cut into chunks of whole texts of about
`CHUNK` bytes, which bounds a task's memory by the chunk or, if larger, by
its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 20
BATCH_ROWS = 1_000

# Fixed byte classes.  SPACE: [\x20\x09-\x0D] separates, all else is a word.
# ALNUM: [\x00-\x2F\x3A-\x60\x7B-\x7F] separates (after lower-casing A-Z).
_BYTES = np.arange(256)
SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_P = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1, 0 if have is None else 2 * len(have))
        out = np.full(size, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _powers[name] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = hash of values[i:j] times P**i (modulo 2**64)."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * _power(_P, "up", len(values)), out=out[1:])
    return out


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, from a `prefix_hash`.  Equal
    contents at any place have equal hashes."""
    inv = _power(_P_INV, "down", len(h))
    return mix((h[end] - h[start]) * inv[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    buf: np.ndarray       # bytes the words were cut from (lower-cased if asked)
    start: np.ndarray     # first byte of each word
    end: np.ndarray       # byte after it
    first: np.ndarray     # text i has the words first[i]:first[i + 1]
    hash: np.ndarray      # 64-bit hash of each word

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]: offs[-1]], offs - offs[0]


def words(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray = SPACE, lower: bool = False) -> Words:
    """The words of the texts buf[offs[i]:offs[i + 1]]; no word spans two texts."""
    b = LOWER[buf] if lower else buf
    n = len(b)
    w = kind[b]
    edge = offs[:-1][offs[:-1] < n]
    before = np.empty(n, bool)
    before[1:] = w[:-1]
    before[edge] = False
    start = np.flatnonzero(w & ~before)
    after = np.empty(n, bool)
    after[:-1] = w[1:]
    after[n - 1:] = False
    after[edge[edge > 0] - 1] = False
    end = np.flatnonzero(w & ~after) + 1
    h = range_hash(prefix_hash(b + np.uint16(1)), start, end) if n else np.zeros(0, np.uint64)
    return Words(b, start, end, np.searchsorted(start, offs), h)


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same table; Arrow batches to Python hold at most BATCH_ROWS rows from
    now on, as a batch of whole texts is held at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) \
        -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about `limit` bytes of text: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offs = raw(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i), buf[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
            i = j


def ngram_hash(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of every n consecutive words of one text."""
    h = prefix_hash(w.hash)
    count = np.maximum(np.diff(w.first) - n + 1, 0)
    start = spread(w.first[:-1], count)
    return start, range_hash(h, start, start + n)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] values for each i, concatenated."""
    total = int(count.sum())
    skip = np.cumsum(count) - count
    return np.repeat(np.asarray(first, np.int64) - skip, count) + np.arange(total)
