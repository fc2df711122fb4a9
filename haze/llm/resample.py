"""Importance resampling towards a target corpus by hashed features, with length-bucketed CRC matrices.

A text's features are its runs of one to ``longest`` words.  All features of a block of texts are spans of one
byte buffer with single spaces between words.  Spans of equal length form a two-dimensional uint8 array; its
distinct rows are hashed together, one table look-up per column for all of them, and the buckets are
scattered back to the places the features stand at.  A feature longer than ``MATRIX_BYTES`` is
hashed on its own by the same polynomial.

1. One scan of the texts writes each document's buckets (two bytes a feature).  2. Bucket counts of
the corpus and the target are small sums per task, added by Spark; the gain of a bucket is a floored
log-ratio of smoothed frequencies.  3. A document's weight is the sum of its features' gains, read from the
buckets.  4. Gumbel noise from a hash of the id is added, and the highest scores are drawn: rows are
range-partitioned by (score, id, row number), numbered inside partitions and shifted by the partitions before.
The driver sees one row per bucket and one per partition.

Defined cases: a null or empty text has no features and weight 0; an empty target or corpus gives smoothed
gains only; repeated rows are rows of their own (each counts, and equal ones get ranks next to each
other); a null id has the noise of the text ``null`` and comes last among equal scores; an empty table gives
an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haze.llm._bytes import BLOCK, row_blocks
from haze.session import ship_package, written

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
MATRIX_BYTES = 256

# word bytes after lower-casing: digits, a-z and everything beyond ASCII
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_TABLE = _crc_table()


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a uint8 matrix, column by column for all rows at once."""
    c = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in rows.T:
        c = _TABLE[(c ^ column) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    return c ^ np.uint32(0xFFFFFFFF)


def span_crcs(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of every span of ``raw``: per length a matrix of its distinct byte strings."""
    out = np.zeros(len(start), np.uint32)
    size = end - start
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        n = int(size[at[0]])
        if n > MATRIX_BYTES:
            out[at] = [zlib.crc32(raw[a:a + n].tobytes()) for a in start[at].tolist()]
            continue
        rows = np.lib.stride_tricks.sliding_window_view(raw, n)[start[at]]
        distinct, back = np.unique(rows.view(f"V{n}").ravel(), return_inverse=True)
        out[at] = crc_matrix(distinct.view(np.uint8).reshape(-1, n))[back.ravel()]
    return out


def features(texts: list[bytes], longest: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC of every feature of all texts, the text it belongs to, and the number of words of each text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    raw = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    edge = np.diff(np.concatenate([[0], _WORD[raw].view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    owner = np.searchsorted(begin, start, "right") - 1
    words = np.bincount(owner, minlength=len(texts))
    # the words one after another, a single space behind each: a run of words is one span of it
    keep = _WORD[raw]
    keep[end] = True  # the byte behind a word is there (a line feed follows every text) and never part of one
    flat = raw[keep]
    size = end - start
    start = np.cumsum(size + 1) - (size + 1)
    end = start + size
    flat[end] = 32
    crc, who = [], []
    for k in range(1, longest + 1):
        first = np.arange(len(start) - k + 1)
        first = first[owner[first] == owner[first + k - 1]] if len(first) else first
        crc.append(span_crcs(flat, start[first], end[first + k - 1]))
        who.append(owner[first])
    crc, who = np.concatenate(crc), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return crc[order], who[order], words


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucketed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the bucket of every feature (packed unsigned integers) of every row; written."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def scan(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in row_blocks([len(t) + 1 for t in texts], BLOCK):
                crc, who, words = features(texts[a:b], longest)
                packed = (crc % np.uint32(buckets)).astype(_kind(buckets)).tobytes()
                n = np.bincount(who, minlength=b - a)
                cut = (np.concatenate([[0], np.cumsum(n)]) * np.dtype(_kind(buckets)).itemsize).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array(words, pa.int64()), pa.array(n, pa.int64()),
                     pa.array([packed[x:y] for x, y in zip(cut, cut[1:])], pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(scan, f"doc_id {kind}, n_words long, n_features long, buckets binary"), "rs-buckets")


def _joined(column: pa.Array, kind: str):
    """The packed buckets of consecutive rows as one array, with the bounds of each row; about ``BLOCK`` bytes at a time."""
    packed = column.to_pylist()
    for a, b in row_blocks([len(x) + 1 for x in packed], BLOCK):
        cut = np.concatenate([[0], np.cumsum([len(x) for x in packed[a:b]])]) // np.dtype(kind).itemsize
        yield np.frombuffer(b"".join(packed[a:b]), kind), cut


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows."""
    kind = _kind(buckets)

    def gather(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for flat, _ in _joined(b.column("buckets"), kind):
                total += np.bincount(flat, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = rows.select("buckets").mapInArrow(gather, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r["bucket"] for r in found]] = [r["n"] for r in found]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    b, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((x + 1.0) * (s + b) / ((y + 1.0) * (t + b))))
                     for x, y in zip(target.tolist(), corpus.tolist())], np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    shared, kind = rows.sparkSession.sparkContext.broadcast(gain), _kind(len(gain))

    def weigh(batches):
        for b in batches:
            values = [np.diff(np.concatenate([[0], np.cumsum(shared.value[flat])])[cut]) for flat, cut in _joined(b.column("buckets"), kind)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "n_words", "n_features")],
                                              pa.array(np.concatenate([np.zeros(0, np.int64), *values]))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    kept = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"doc_id {kept}, n_words long, n_features long, weight long")


def _noise(doc_id: str, seed: int):
    """floor(-1000 ln(-ln u)) of a uniform u in (0, 1) from the first 32 bits of a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text",
              longest: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row."""
    spark = docs.sparkSession
    rows = bucketed(docs, text, doc_id, longest, buckets)
    aim = bucketed(target.withColumn("_id", F.lit(0)), target_text, "_id", longest, buckets)
    gain = gains(bucket_counts(rows, buckets), bucket_counts(aim, buckets))
    scored = written(weighted(rows, gain).withColumn("score", F.col("weight") + _noise("doc_id", seed)).withColumn(
        "seq", F.monotonically_increasing_id()), "rs-scored")
    able = scored.where(F.col("n_words") >= min_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("seq")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(able.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "rs-ranged")
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = sum(sizes.values()) * percent // 100
    before, upto = {}, 0
    for p in sorted(sizes):
        before[p], upto = upto, upto + sizes[p]
    shift = spark.createDataFrame(list(before.items()), "part int, base long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("base")
    ranked = ranged.join(F.broadcast(shift), "part").withColumn("rank", place.cast("long")).withColumn(
        "rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*cols).unionByName(rest.select(*cols))
