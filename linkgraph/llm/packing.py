"""Best-fit packing of tokenised documents into sequences of a fixed length.

`tokenised` turns each document into token ids with an end id behind, and cuts
those longer than a sequence into full pieces (the first piece takes what is left
over).  `best_fit` plans on the histogram of piece lengths alone: lengths from long
to short, each count poured into the open sequences with the least room that still
holds it, whole runs of equal sequences at a time.  Pieces then take the planned
slots by their rank among the pieces of their length.

Rows: a null text is empty, an empty text is its end id alone; repeated rows are
packed each for itself.  Empty tables give an empty result; other columns are not
looked at.  A text of any length is tokenised in parts that no token spans, so its ids
are those of the whole text; a task holds the ids of one text beside its chunk.

Scale: texts are tokenised once and never shuffled; the written pieces are narrow.
The driver sees the histogram, at most `capacity` rows.  The plan is as small: a
length splits at most one run of open sequences into three and opens at most two
new ones, and a run that is poured into keeps less than half its room, so the plan has at
most 4 * capacity * (log2(capacity) + 1) rows, whatever the corpus; it is broadcast.
Ranks come from groups of about `GROUP` pieces of one length, so that a length
that a third of all pieces have spreads over many tasks.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.llm.text import chunks, in_small_batches
from linkgraph.sources.store import materialize

CAPACITY = 2048
GROUP = 2_000
CACHE_BYTES = 48 << 20

# The public splitting rule of byte-level vocabularies, written out for Latin-1 texts,
# whose letters, digits and spaces are these in every version of Unicode (fixed values).
_LETTER, _DIGIT, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+"
                    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
# Other texts are cut before white space that follows a word, every 1,000 words; a text with white space
# that regular expression libraries do not agree on is not cut.
_WORDS = re.compile(r"(?:\s*\S+){1,1000}|\s+")
_UNSURE = re.compile("[^\\S\\t-\\r ]|[\\u180e\\u200b\\u2060\\ufeff]")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write byte b as the letter b if it is visible, else as
    the next letter from U+0100 on (fixed values)."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class Pieces(dict):
    """Ids of pieces of text, made by the tokenizer's model when first asked for."""

    def __init__(self, tokenizer):
        self.tokenize, self.held = tokenizer.model.tokenize, 0

    def __missing__(self, piece: str) -> bytes:
        written = piece.encode().decode("latin-1").translate(_LETTERS)
        ids = self[piece] = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(written)])
        self.held += 4 * len(piece) + len(ids)
        return ids


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, as the tokenizer in
    the file `path` gives them for the whole text.

    With a byte-level vocabulary no token spans two pieces of the splitting rule, so a
    Latin-1 text is cut into pieces and only new pieces go through the tokenizer; the
    table of pieces is emptied when it holds CACHE_BYTES.  Other texts are cut only
    between words, and with any other tokenizer texts go through whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = made.get("pre_tokenizer") or {}
        self.byte_level = (split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
                           and split.get("use_regex", True) and not made.get("normalizer"))
        self.pieces = Pieces(self.tokenizer)

    def whole(self, texts: list[str]) -> bytes:
        done = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return b"".join([np.array(e.ids, "<u4").tobytes() for e in done])

    def encode(self, text: str) -> bytes:
        if not self.byte_level:
            return self.whole([text])
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole([text] if _UNSURE.search(text) else _WORDS.findall(text))
        out = b"".join(map(self.pieces.__getitem__, _LATIN.findall(text)))
        if self.pieces.held > CACHE_BYTES:
            self.pieces = Pieces(self.tokenizer)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This Python worker's encoder; tasks that follow in it find its table."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0,
              with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]), one row per piece."""
    own = in_small_batches(docs.select(docs["doc_id"], docs["text"]))
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    if with_ids:
        schema += ", ids array<bigint>"
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for rows, _, _ in chunks(batches, "text"):
            of, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(rows.column("text").to_pylist()):
                data = (encode(text) if text else b"") + tail
                for k, (s, n) in enumerate(pieces(len(data) // 4, capacity)):
                    cut = data[4 * s: 4 * (s + n)]
                    of.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(cut))
                    if with_ids:
                        ids.append(np.frombuffer(cut, "<u4").astype(np.int64))
            cols = [rows.column("doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return own.mapInArrow(run, schema)


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first, n, sequence, each, place).

    The pieces of `length` with ranks first .. first + n - 1 go, `each` to a sequence,
    into the sequences from `sequence` on, one behind the other from `place` on.

    All open sequences with the same room behave alike, so they are kept as runs
    (first sequence, number) by room.  Of the rooms that hold a length the smallest, r,
    is the best fit, and stays so after a piece went in as long as the piece still fits;
    hence a sequence takes r // length pieces before the next one is touched."""
    runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    opened, plan = 0, []

    def put(room: int, sequence: int, number: int) -> None:
        if room and number:
            if not runs.setdefault(room, []):
                insort(rooms, room)
            runs[room].append((sequence, number))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            each = room // length
            if at < len(rooms):
                sequence, number = runs[room].pop()
                if not runs[room]:
                    rooms.pop(at)
            else:
                sequence, number = opened, -(-left // each)
                opened += number
            full = min(number, left // each)
            if full:
                plan.append((length, rank, full * each, sequence, each, capacity - room))
                put(room - each * length, sequence, full)
                rank, left = rank + full * each, left - full * each
            if full < number and left:  # the last pieces of this length, in one sequence
                plan.append((length, rank, left, sequence + full, left, capacity - room))
                put(room - left * length, sequence + full, 1)
                full, left = full + 1, 0
            put(room, sequence + full, number - full)
    return plan


def ranked(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """`rows` (a written table with a distinct _row) with `rank`, from 0 among the
    rows of equal length: the rows before in the group plus those of earlier groups."""
    spark = rows.sparkSession
    groups = [(n, -(-c // GROUP)) for n, c in histogram.items()]
    groups = spark.createDataFrame(groups, "length bigint, groups bigint")
    rows = rows.join(F.broadcast(groups), "length")  # at most `capacity` rows
    rows = rows.withColumn("g", F.pmod(F.xxhash64("_row"), F.col("groups"))).drop("groups")
    earlier = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("length", "g").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("length", "g", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("length", "g").orderBy("_row")) - 1
    rows = rows.withColumn("inside", inside).join(sizes, ["length", "g"])
    return rows.withColumn("rank", F.col("earlier") + F.col("inside")).drop("inside", "earlier", "g")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0,
           with_ids: bool = False) -> DataFrame:
    """The pieces with their place: doc_id, piece, start, length, ids_crc32[, ids],
    sequence_id, offset."""
    made = tokenised(docs, tokenizer, capacity, end, with_ids)
    rows = materialize(made.withColumn("_row", F.monotonically_increasing_id()), "packing-pieces")
    spark = rows.sparkSession
    histogram = {r["length"]: r["n"] for r in
                 rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(best_fit(histogram, capacity),
                                 "p_length bigint, first bigint, n bigint, sequence bigint, each bigint, place bigint")
    held = ((F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first"))
            & (F.col("rank") < F.col("first") + F.col("n")))
    out = ranked(rows, histogram).join(F.broadcast(plan), held)
    k = F.col("rank") - F.col("first")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []),
                      (F.col("sequence") + F.floor(k / F.col("each"))).cast("bigint").alias("sequence_id"),
                      (F.col("place") + F.pmod(k, F.col("each")) * F.col("length")).cast("bigint").alias("offset"))


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the token sequences themselves, from `packed` with
    ids; a sequence holds at most `capacity` ids, so a group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    out = rows.groupBy("sequence_id").agg(parts.alias("p"))
    return out.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
