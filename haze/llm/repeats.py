"""Exact removal of long repeated substrings, one bucket of suffixes at a time.

Only the first ``LENGTH`` bytes of a suffix matter: a byte goes if it lies in a ``LENGTH``-byte window
that also starts anywhere else.  A cover sample of text positions makes windows comparable without a
suffix array of the whole corpus: of the ``GRAM``-byte strings inside a window, the one with the
smallest hash (leftmost of equals) is its sample position.  Equal windows have it at the same offset,
so it takes the part of a difference cover, but it is chosen by content: about 2 in 300 positions
are sampled, where a modular difference cover of period 181 would sample 16 in 181.

1. Windows with one sample position form a run.  The run's bucket is its sampled string, its rank a
   name of all the bytes that the run spans.
2. Buckets with one run hold nothing repeated.  Buckets whose runs all have one rank are one long tie,
   resolved by the rank alone: every window of theirs is repeated.
3. In the other buckets each distinct rank is opened once: its windows are named, sorted and matched at
   equal distance from the sample, each with the number of runs that share the rank.  Buckets of up to
   ``BUCKET_RANKS`` ranks come by bucket and are sorted as packed arrays; the windows of larger
   buckets are rows of their own, spread by name.

A worker holds, beside one Arrow batch, ``BLOCK`` bytes of text or one longer text, and in the sort ``MATCH`` windows
and one bucket of up to ``BUCKET_RANKS`` runs, however large its partition; Spark's shuffles bound the rest.  A passage that a
third of all documents share is a bucket with many runs but few ranks, counted before the shuffle.

Names and buckets are 62-bit hashes under random keys of the run; strings are taken as equal only if bucket, offset and name
all agree, which unlike strings of L bytes do with probability (L / 2**31)**2 at most, whoever wrote them.  Defined
cases: an empty table gives an empty result; null is empty text; texts below ``LENGTH`` bytes keep all bytes;
copies of a text repeat each other; repeated rows are copies; other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm._bytes import FIXED, Hashes, Key, draw_key, row_blocks
from haze.session import ship_package, written

LENGTH, GRAM = 400, 64
BUCKET_RANKS = 4096
BLOCK = 1 << 17  # bytes of text at a time in a worker
MATCH = 1 << 18  # windows sorted at a time, to the end of a bucket
Keys = tuple[Key, Key]  # of sampled strings, and of names


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, keys: Keys = (FIXED, FIXED)):
    """(text, bucket, rank, first window, last window, sample position) of every run of every text."""
    step = max(BLOCK, 4 * length)
    pieces = [(i, at, t[at:at + step + length - 1]) for i, t in enumerate(texts)
              for at in range(0, max(0, len(t) - length + 1), step)]
    for a, b in row_blocks([len(p) for _, _, p in pieces], BLOCK):
        part = pieces[a:b]
        raw = np.frombuffer(b"".join(p for _, _, p in part), np.uint8)
        sizes = np.array([len(p) for _, _, p in part])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.arange(len(raw) - gram + 1)
        grams = Hashes(raw, keys[0]).sliding(gram)
        key = (grams >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
        low = (_sliding_min(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        count = sizes - length + 1
        owner = np.repeat(np.arange(len(part)), count)
        offset = np.concatenate([[0], np.cumsum(count)[:-1]])
        window = np.arange(len(owner)) - offset[owner] + begin[owner]
        pos = low[window]
        new = np.ones(len(pos), bool)
        new[1:] = (pos[1:] != pos[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(pos)]]) - 1
        lo, hi, who = window[first], window[last], owner[first]
        rank = Hashes(raw, keys[1]).of(lo, hi + length)
        shift = np.array([x[1] for x in part])[who] - begin[who]
        yield (np.array([x[0] for x in part])[who], grams[pos[first]], rank, lo + shift, hi + shift, pos[first] + shift)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _parts(batches):
    """The rows of the batches, about ``BLOCK`` bytes of text at a time."""
    for batch in batches:
        for a, b in row_blocks(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist(), BLOCK):
            yield batch.slice(a, b - a)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def text_runs(docs: DataFrame, text: str, length: int, gram: int, keys: Keys) -> DataFrame:
    """key (digest of the text), bucket, rank, lo, hi, at of every run of every row."""
    def scan(batches):
        for batch in _parts(batches):
            texts = _bytes(batch.column("text"))
            for who, bucket, rank, lo, hi, at in runs(texts, length, gram, keys):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(who)), _signed(bucket), _signed(rank),
                     *[pa.array(x, pa.int32()) for x in (lo, hi, at)]], ["key", "bucket", "rank", "lo", "hi", "at"])

    rows = docs.select(_key(text).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, "key binary, bucket long, rank long, lo int, hi int, at int")


def _key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def window_names(text: bytes, lo: int, hi: int, length: int, key: Key) -> np.ndarray:
    return Hashes(np.frombuffer(text[lo:hi + length], np.uint8), key).sliding(length)


def _matched(batches):
    """(id, offs) of the windows that occur twice in a bucket, of packed runs that come by bucket."""
    held, total, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column("bucket").to_numpy()
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("names")).to_numpy() // 8)])
        begin = 0
        for a in [0, *(np.flatnonzero(np.diff(bucket)) + 1)]:
            if bucket[a] != last and total + ends[a] - ends[begin] >= MATCH:
                yield _twice([*held, batch.slice(begin, a - begin)])
                held, total, begin = [], 0, a
            last = bucket[a]
        held.append(batch.slice(begin))
        total += ends[-1] - ends[begin]
    if held:
        yield _twice(held)


def _twice(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(id, offs) of the windows that occur twice among packed runs of whole buckets."""
    table = pa.Table.from_batches(parts)
    ids, bucket, c, first = (table.column(k).to_numpy() for k in ("id", "bucket", "c", "dist"))
    blobs = table.column("names").to_pylist()
    size = np.array([len(x) // 8 for x in blobs])
    names = np.frombuffer(b"".join(blobs), np.uint64)
    row = np.repeat(np.arange(len(size)), size)
    off = np.arange(len(names)) - np.repeat(np.cumsum(size) - size, size)
    dist = first[row] - off
    order = np.lexsort((dist, bucket[row], names))
    n, b, d = names[order], bucket[row[order]], dist[order]
    new = np.ones(len(order), bool)
    new[1:] = (n[1:] != n[:-1]) | (b[1:] != b[:-1]) | (d[1:] != d[:-1])
    group = np.cumsum(new) - 1
    twice = np.zeros(len(names), bool)
    twice[order] = np.bincount(group, weights=c[row[order]])[group] > 1.5
    hit = np.flatnonzero(twice)
    at, count = np.unique(row[hit], return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[at]), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32),
                                                     pa.array(off[hit], pa.int32()))], ["id", "offs"])


def repeated_windows(docs: DataFrame, text: str = "text", length: int = LENGTH,
                     gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(key, windows) with the repeated window starts of each distinct text, and (key, text)."""
    spark = docs.sparkSession
    ship_package(spark)
    keys = (draw_key(), draw_key())
    rows = text_runs(docs, text, length, gram, keys)
    # both written on their own, so that the join between them may split a bucket that many runs share
    shared = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("bucket"), "rp-shared")
    held = written(rows.join(shared, "bucket"), "rp-held")
    span = F.col("hi") - F.col("lo")
    found = written(held.groupBy("key", "bucket", "rank", "lo", "hi", "at").agg(F.count(F.lit(1)).alias("c")), "rp-found")
    ranks = found.groupBy("bucket", "rank", span.alias("span")).agg(
        F.sum("c").alias("c"), F.min(F.struct("key", "lo", "at")).alias("rep"))
    ranks = written(ranks.withColumn("id", F.monotonically_increasing_id()), "rp-ranks")
    # written on its own, so that the join may split a bucket of many ranks
    size = written(ranks.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1), "rp-size")
    mixed = written(ranks.join(size, "bucket"), "rp-mixed")

    found_keys = found.select("key").distinct()
    open_ = mixed.select("rep.key", F.struct("id", "bucket", "c", "span", "rep.lo", (F.col("rep.at") - F.col("rep.lo")).alias("dist"),
                                             (F.col("k") > BUCKET_RANKS).alias("large")).alias("run"))
    open_ = open_.groupBy("key").agg(F.collect_list("run").alias("runs"))
    # one text of each key first, reduced before the shuffle: a text with a million copies is one row in the join
    one = docs.select(_key(text).alias("key"), F.col(text).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    texts = written(one.join(found_keys.join(open_, "key", "left"), "key"), "rp-texts")

    def opened(batches):
        for batch in _parts(batches):
            for body, listed in zip(_bytes(batch.column("text")), batch.column("runs").to_pylist()):
                for a, b in row_blocks([r["span"] + 1 for r in listed], BLOCK // 2):
                    part = listed[a:b]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[k] for r in part], pa.int64()) for k in ("id", "bucket", "c", "dist")]
                        + [pa.array([window_names(body, r["lo"], r["lo"] + r["span"], length, keys[1]).tobytes() for r in part], pa.binary())],
                        ["id", "bucket", "c", "dist", "names"])

    def named(large: bool) -> DataFrame:
        """The windows of the runs in large buckets, or of those in others; texts without any stay closed."""
        runs = F.filter("runs", lambda r: r["large"] if large else ~r["large"])
        return texts.select("text", runs.alias("runs")).where(F.size("runs") > 0).mapInArrow(
            opened, "id long, bucket long, c long, dist long, names binary")

    offs = named(False).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_matched, "id long, offs array<int>")

    def spread(batches):
        for batch in batches:
            for i, bucket, c, dist, names in zip(*[batch.column(k).to_pylist() for k in batch.schema.names]):
                w = np.frombuffer(names, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(w), i)), pa.array(np.full(len(w), bucket)), pa.array(np.full(len(w), c)),
                     pa.array(np.arange(len(w)), pa.int32()), pa.array(dist - np.arange(len(w)), pa.int64()), pa.array(w)],
                    ["id", "bucket", "c", "off", "dist", "w"])

    if not mixed.where(F.col("k") > BUCKET_RANKS).isEmpty():
        one = written(named(True).mapInArrow(spread, "id long, bucket long, c long, off int, dist long, w long"), "rp-windows")
        twice = one.groupBy("w", "bucket", "dist").agg(F.sum("c").alias("s")).where(F.col("s") > 1).drop("s")
        offs = offs.unionByName(one.join(twice, ["w", "bucket", "dist"]).groupBy("id").agg(F.collect_list("off").alias("offs")))
    resolved = mixed.join(written(offs, "rp-offs"), "id").select("bucket", "rank", "span", "offs")
    alone = ranks.join(size, "bucket", "left_anti").where(F.col("c") > 1).select(
        "bucket", "rank", "span", F.lit(None).cast("array<int>").alias("offs"))
    hits = found.withColumn("span", span).join(resolved.unionByName(alone), ["bucket", "rank", "span"]).groupBy("key").agg(
        F.collect_list(F.struct("lo", "hi", "offs")).alias("windows"))
    return hits, texts.select("key", "text")


def spans_of(windows: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the windows that start at the given places."""
    starts = np.sort(np.concatenate([
        np.arange(w["lo"], w["hi"] + 1) if w["offs"] is None else np.asarray(w["offs"], np.int64) + w["lo"]
        for w in windows]))
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(),
                    (starts[np.concatenate([cut, [len(starts) - 1]])] + length).tolist()))


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key, spans [(start, end) in bytes], n_removed and kept (the remaining bytes) of each text that loses bytes."""
    hits, texts = repeated_windows(docs, text, length, gram)

    def cut(batches):
        for batch in _parts(batches):
            out = []
            for body, windows in zip(_bytes(batch.column("text")), batch.column("windows").to_pylist()):
                spans = spans_of(windows, length)
                edges = [0, *[x for s in spans for x in s], len(body)]
                out.append((spans, sum(b - a for a, b in spans),
                            b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([[{"start": a, "end": b} for a, b in o[0]] for o in out],
                                               pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())],
                ["key", "spans", "n_removed", "kept"])

    return texts.join(hits, "key").mapInArrow(
        cut, "key binary, spans array<struct<start:bigint,end:bigint>>, n_removed long, kept binary")


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` as struct ``row`` with n_bytes, n_removed, spans and kept (binary: a cut may split a character)."""
    spans = repeated_spans(docs, text, length, gram)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(text).alias("doc_key"),
                       body.alias("body"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return rows.join(spans, F.col("doc_key") == F.col("key"), "left").select(
        "row", F.octet_length("body").cast("long").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("spans", none).alias("spans"),
        F.coalesce("kept", "body").alias("kept"))


def removal_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH,
                   gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: the digest of ``without_repeats``, moving digests and not texts."""
    spans = repeated_spans(docs, text, length, gram).select(
        "key", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("cut_sha256"))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), _key(text).alias("doc_key"),
                       F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("whole_sha256"))
    return rows.join(spans, F.col("doc_key") == F.col("key"), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))
