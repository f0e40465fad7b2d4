"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of training texts.
Texts and dictionaries are brought to lower-case letters first (any other run
of ASCII bytes becomes one space), so that shouting, digits and symbols don't
count.  A text is compressed once with each of them; the language whose dictionary
gives the smallest output wins.  Texts are compressed in pieces of `PIECE`
bytes, so that the dictionary keeps its weight in long texts; every byte of
the text takes part.  Results with a margin below `min_margin` are marked as
rejected.

Scale: the dictionaries are a bounded sample: `DOCS_PER_LANG` texts of any
length per language share `DICT_BYTES`, each with as many first bytes as the
others or whole if it is shorter; so every language with a training text that
has a letter is learned.  Prediction is a map over the documents without any
shuffle.

Defined results: a null text or one without a letter gives `und` with score 0
and is rejected; ties go to the language that sorts first; null languages and
texts teach nothing; without any training text every result is `und`.  Other
columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.llm.text import chunks, in_small_batches

DOCS_PER_LANG = 64
DICT_BYTES = 96 << 10
PIECE = 4096
LEVEL = 3


# ASCII letters and non-ASCII bytes stay, the rest is a space; as patterns, and as a fixed byte map.
LETTER = r"[A-Za-z]|[^\x00-\x7f]"
OTHERS = r"[\x00-\x40\x5b-\x60\x7b-\x7f]+"
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def normal(text: bytes) -> bytes:
    """Lower-cased letters (the text is lower-cased before) with single spaces."""
    return b" ".join(text.translate(_LETTERS).split())


def learn(train: DataFrame) -> dict[str, bytes]:
    """Language -> dictionary, from rows with doc_id, text and lang (texts rank by
    a hash of doc_id; equal texts that were drawn count once)."""
    rows = (train.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
            .select("lang", "text", F.xxhash64("doc_id").alias("h")))
    first = Window.partitionBy("lang").orderBy("h", "text")
    rows = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= DOCS_PER_LANG)
    plain = F.trim(F.regexp_replace(F.lower("text"), OTHERS, " "))
    rows = rows.select("lang", "k", F.encode(plain, "UTF-8").alias("text")).groupBy("lang", "text").agg(
        F.min("k").alias("k")).withColumn("n", F.length("text"))
    # Shortest first, a text gets an even part of what the ones before it left; the largest part bounds the others.
    lang = Window.partitionBy("lang")
    before = lang.orderBy("n", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = DICT_BYTES - DOCS_PER_LANG - (F.sum("n").over(before) - F.col("n"))
    part = left / (F.count("*").over(lang) - F.count("*").over(before) + 1)
    rows = rows.withColumn("part", part).withColumn("part", F.floor(F.max("part").over(lang)).cast("int"))
    rows = rows.select("lang", "k", F.substring("text", F.lit(1), F.least("n", "part")).alias("text"))
    out: dict[str, list[bytes]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["k"])):
        out.setdefault(r["lang"], []).append(bytes(r["text"]))
    return {k: b" ".join(v) for k, v in out.items()}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.005) -> DataFrame:
    """row (the document's columns), lang_pred, score, rejected."""
    held = in_small_batches(docs).sparkSession.sparkContext.broadcast(dictionaries)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.when(F.col("row.text").rlike(r"\p{L}"), F.lower("row.text")).alias("_text"))
    schema = rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"),
                         F.lit(True).alias("rejected")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = list(held.value)
        makers = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(held.value[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            makers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False,
                                                   write_content_size=False, write_dict_id=False).compress)
        for part, buf, offs in chunks(batches, "_text"):
            data = buf.tobytes()
            n = part.num_rows
            size = np.zeros((n, max(1, len(langs))))
            bounds = offs.tolist()
            for i in range(n):
                text = normal(data[bounds[i]: bounds[i + 1]])
                for j in range(0, len(text), PIECE):
                    piece = text[j: j + PIECE]
                    for k, make in enumerate(makers):
                        size[i, k] += len(make(piece))
            best = size.argmin(1)
            low = size.min(1)
            gap = size - low[:, None]
            score = 1.0 / np.exp2(-np.minimum(gap, 1000.0)).sum(1)
            second = np.partition(size, 1, axis=1)[:, 1] if len(langs) > 1 else size[:, 0]
            margin = np.where(second > 0, (second - low) / np.maximum(second, 1), 0.0)
            known = np.asarray(part.column("_text").is_valid()) & (len(langs) > 0)
            names = np.array(langs or ["und"], object)[best]
            names[~known] = "und"
            out = [part.column("row"), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)),
                   pa.array(~known | ((margin < min_margin) & (len(langs) > 1)))]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(run, schema)
