"""Importance resampling towards a target distribution, on hashed word n-grams.

The bucket of an n-gram is the CRC-32 of its bytes.  A document, its words joined by
single spaces, is scanned once: the CRC of every prefix that ends a word is kept.
The CRC of any n-gram then follows from two of them, because the CRC is linear over
GF(2): crc(AB) = Z(crc(A), |B|) ^ crc(B), where Z appends |B| zero bytes.  Z is a power
of one linear map; its powers of two are tables, so all n-grams of a batch are
derived with a few vector operations, however many widths are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evledger.llm.common import arrow_map, as_bytes, slices
from evledger.llm.ranking import ranked
from evledger.session import materialize, ship_package

BUCKETS = 10_000
WIDTHS = 2
MIN_WORDS = 20
#: Reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Digits and a-z stay, A-Z are lower-cased, bytes beyond ASCII stay; the rest separates.
_NORMAL = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def _byte_steps() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(POLYNOMIAL), value >> 1)
    return value


_STEP = _byte_steps()


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given as tables of its values at each byte, at ``crc``."""
    out = tables[0][crc & 255]
    for k in (1, 2, 3):
        out = out ^ tables[k][crc >> np.uint32(8 * k) & np.uint32(255)]
    return out


def _zero_maps(most: int) -> list[np.ndarray]:
    """Maps that append 1, 2, 4, ... zero bytes, up to lengths of ``most``."""
    while 1 << len(_MAPS) <= most:
        _MAPS.append(np.stack([_apply(_MAPS[-1], row) for row in _MAPS[-1]]))
    return _MAPS


_ONES = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
_MAPS = [(_ONES >> np.uint32(8)) ^ _STEP[_ONES & 255]]


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The contribution of prefixes with ``crc`` once ``lengths`` bytes follow them."""
    crc = crc.copy()
    for k, tables in enumerate(_zero_maps(int(lengths.max(initial=0)))):
        chosen = np.flatnonzero(lengths >> k & 1)
        crc[chosen] = _apply(tables, crc[chosen])
    return crc


def ngram_crcs(texts: list[bytes], widths: int = WIDTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of every run of 1 to ``widths`` words: ``(crcs, document, words of each document)``.

    Repeats count; a run is its words joined by one space.  A text without a word has none.
    """
    ends: list[int] = []
    sizes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.translate(_NORMAL).split()
        if words:
            counts[i] = len(words)
            spaced = (b" " + b"\0 ".join(words)).split(b"\0")  # each word with the space before it
            ends.extend(accumulate(spaced, lambda crc, word: crc32(word, crc), initial=0))
            sizes.extend(map(len, spaced))
    length = np.array(sizes, np.int64) - 1
    document = np.repeat(np.arange(len(texts)), counts)
    # ``ends`` has one entry more for each document with words: its empty prefix.
    shift = np.cumsum(counts > 0)[document] if len(length) else np.empty(0, np.int64)
    at = np.arange(len(length)) + shift
    prefix = np.array(ends, np.uint32)
    before = ~prefix[at - 1] if len(length) else np.empty(0, np.uint32)
    before = ~((before >> np.uint32(8)) ^ _STEP[(before ^ np.uint32(32)) & np.uint32(255)])  # the space is passed
    crcs, owners = [], []
    span = length
    for width in range(1, widths + 1):
        if width > 1:  # one word longer, where the document goes on
            span = span[:-1] + 1 + length[width - 1 :]
        total = len(span)
        same = document[:total] == document[width - 1 :] if total else np.empty(0, bool)
        first = np.flatnonzero(same)
        crcs.append(prefix[at[first + width - 1]] ^ shifted(before[first], span[first]))
        owners.append(document[first])
    return np.concatenate(crcs), np.concatenate(owners), counts


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, widths: int = WIDTHS) -> DataFrame:
    """``(bucket, n)``: features of all texts of ``docs``; buckets without any are absent."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                crcs, _, _ = ngram_crcs(as_bytes(part.column("text")), widths)
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, widths: int = WIDTHS) -> np.ndarray:
    """Gain of each bucket, in thousandths of a natural logarithm.

    Two tables of ``buckets`` rows are summed on the executors; that many numbers
    reach the driver, at any size of the corpus.
    """
    raw = {r["bucket"]: r["n"] for r in bucket_counts(docs, buckets, widths).collect()}
    wanted = {r["bucket"]: r["n"] for r in bucket_counts(target, buckets, widths).collect()}
    held, sought = sum(raw.values()) + buckets, sum(wanted.values()) + buckets

    def gain(bucket: int) -> int:
        s, t = raw.get(bucket, 0), wanted.get(bucket, 0)
        return math.floor(1000 * math.log(float(t + 1) * float(held) / (float(s + 1) * float(sought))))

    return np.array([gain(b) for b in range(buckets)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, widths: int = WIDTHS) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` per row; the weight is the floored mean gain."""
    kept = docs.select("doc_id", "text")
    schema = T.StructType([kept.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        crcs, owner, words = ngram_crcs(as_bytes(batch.column("text")), widths)
        features = np.bincount(owner, minlength=batch.num_rows)
        total = np.zeros(batch.num_rows, np.int64)
        np.add.at(total, owner, gain[crcs % np.uint32(len(gain))])
        weight = total // np.maximum(features, 1)
        return {"doc_id": batch.column("doc_id"), "n_words": words, "n_features": features, "weight": weight}

    return arrow_map(kept, schema, each, sized_by="text")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document in thousandths, from a hash of ``seed`` and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = MIN_WORDS, seed: int = 7,
    buckets: int = BUCKETS, widths: int = WIDTHS,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)``: one row per row of ``docs``.

    Of the rows with ``min_words`` words or more, the ``percent`` per cent with the
    highest ``score`` (weight and Gumbel noise of the id) are drawn and ranked from 1;
    ties go to the smaller ``doc_id`` (null first), then by the place in the table.
    The others have a null ``rank``.  A null text counts as empty, a text without
    words has weight 0, a null ``doc_id`` hashes as empty text.  Repeated rows are
    rows of their own.  Other columns are not read.  Empty tables give an empty
    result; with an empty ``target`` all its counts are zero.
    """
    rows = weighed(docs, gains(docs, target, buckets, widths), widths)
    rows = rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows = materialize(rows, "weighed").withColumn("_fit", (F.col("n_words") >= min_words).cast("int"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    placed = ranked(rows, "_fit", order)
    drawn = (F.col("_fit") == 1) & (F.col("rank") < F.floor(F.col("total") * percent / F.lit(100)))
    rank = F.when(drawn, F.col("rank") + 1).cast("long").alias("rank")
    return placed.select("doc_id", "n_features", "weight", "score", rank)
