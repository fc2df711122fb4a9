"""Hierarchical best-fit packing of tokenised documents into fixed-length sequences.

Level 0: each scan task cuts its documents into pieces of at most ``capacity`` tokens and packs its
own pieces, longest first, each into the fullest bin that still takes it.  Bins with at most ``slack``
free tokens are final.  The others become items of their fill for the next level, where groups of
them meet and are packed best-fit again; the number of groups falls by ``FAN_IN`` a level until one
group is left or a level saves less than one bin in ``WORTH``.  An item never opens up
again, so a level ships one row per underfull bin, and the tree of (bin -> parent bin, offset) is
folded into final places by small joins.

A task holds one scan split's piece lengths, or one group of at most ``GROUP_ITEMS`` items, whichever
hot source or long document there is.  Every level is written to the shared scratch folder before it
is read, so a lost executor reruns tasks against fixed inputs and bin numbers stay what they are.

Defined cases: a null or empty text is one piece that holds the end id alone; repeated rows and null
ids are packed like any other row; only documents longer than ``capacity`` are cut; an empty table gives no sequences;
other columns, whatever their names, are not read.  Words are cached by 124-bit hashes under random keys of the worker.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm._bytes import row_blocks
from haze.llm._tokens import BLOCK as TOKEN_BLOCK
from haze.llm._tokens import encoder
from haze.session import ship_package, written

CAPACITY, END_ID = 4096, 1
SLACK = 8
FAN_IN, GROUP_ITEMS, WORTH = 8, 100_000, 200


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin; longest first into the tightest bin."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    fills: list[int] = []
    free: list[int] = []               # sorted distinct free sizes that occur
    having: dict[int, list[int]] = {}  # free size -> its bins
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        k = bisect.bisect_left(free, need)
        if k < len(free):
            room = free[k]
            b = having[room].pop()
            if not having[room]:
                del having[room], free[k]
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, capacity - room
        fills[b] += need
        left = room - need
        if left:
            if left not in having:
                bisect.insort(free, left)
                having[left] = []
            having[left].append(b)
    return bins, offsets, np.asarray(fills, np.int64)


def _pieces(batches, path: str, capacity: int, end_id: int, keep_ids: bool):
    """(keys, piece, start, length, crc32[, ids]) of every text, a batch at a time."""
    end = np.asarray([end_id], "<u4").tobytes()
    width = 4 * capacity
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        for a, b in row_blocks([len(t) for t in texts], TOKEN_BLOCK):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, body in enumerate(encoder(path).encode(texts[a:b]), a):
                body += end
                for k, at in enumerate(range(0, len(body), width)):
                    cut = body[at:at + width]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    ids.append(cut if keep_ids else None)
            keys = batch.select([c for c in batch.schema.names if c != "text"]).take(pa.array(row))
            yield keys, np.asarray(piece), np.asarray(start), np.asarray(length), np.asarray(crc), ids


def tokenised_pieces(docs: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",),
                     capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their place in the bins of their own scan task (bin, bin_offset, fill)."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(*keys, F.col(text).alias("text")) if "text" not in keys else docs.select(*keys)
    fields = [f for f in rows.schema.fields if f.name in keys and f.name != "text"]
    schema = rows.select(*[f.name for f in fields]).schema.simpleString()[7:-1].replace(":", " ")
    schema += ", piece int, start long, length long, ids_crc32 long, ids binary, bin long, bin_offset long, fill long"

    def pack(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        parts = list(_pieces(batches, path, capacity, end_id, keep_ids))
        if not parts:
            return
        bins, offsets, fills = best_fit(np.concatenate([p[3] for p in parts]), capacity)
        at = 0
        for keys_, piece, start, length, crc, ids in parts:
            b, o = bins[at:at + len(piece)], offsets[at:at + len(piece)]
            at += len(piece)
            yield pa.RecordBatch.from_arrays(
                [*keys_.columns, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array(ids, pa.binary()), pa.array((task << 32) + b, pa.int64()),
                 pa.array(o, pa.int64()), pa.array(fills[b], pa.int64())],
                [*keys_.schema.names, "piece", "start", "length", "ids_crc32", "ids", "bin", "bin_offset", "fill"])

    return written(rows.mapInArrow(pack, schema), "pack-pieces")


def _merged(items: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """One best-fit round: item -> (parent, parent_offset, parent_fill)."""
    def pack(frame):
        bins, offsets, fills = best_fit(frame["fill"].to_numpy(), capacity)
        base = (level << 56) + (int(frame["grp"].iloc[0]) << 32)
        return frame.assign(parent=base + bins, parent_offset=offsets, parent_fill=fills[bins])[
            ["item", "parent", "parent_offset", "parent_fill"]]

    dealt = items.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)).cast("int"))
    return written(dealt.groupBy("grp").applyInPandas(
        pack, "item long, parent long, parent_offset long, parent_fill long"), f"pack-level{level}")


def packed(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """``pieces`` with final ``sequence_id`` and ``offset``."""
    bins = pieces.groupBy("bin").agg(F.max("fill").alias("fill")).select(F.col("bin").alias("item"), "fill")
    rest = written(bins.where(F.col("fill") < capacity - slack), "pack-rest")
    place = rest.select(F.col("item").alias("bin0"), F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("shift"))
    n, level = rest.count(), 1
    groups = max(1, -(-n // GROUP_ITEMS), min(n // 64, 256) // FAN_IN)
    moved = False
    while n > 1:
        step = _merged(rest, groups, capacity, level)
        place = written(place.join(step, F.col("sequence_id") == F.col("item"), "left").select(
            "bin0", F.coalesce("parent", "sequence_id").alias("sequence_id"),
            (F.col("shift") + F.coalesce("parent_offset", F.lit(0))).alias("shift")), "pack-place")
        moved = True
        parents = step.groupBy(F.col("parent").alias("item")).agg(F.max("parent_fill").alias("fill"))
        counted = written(parents, "pack-parents")
        made = counted.count()
        rest = counted.where(F.col("fill") < capacity - slack)
        left = rest.count()
        if (groups == 1 or n - made < n / WORTH) and groups <= max(1, -(-left // GROUP_ITEMS)):
            break
        n, level = left, level + 1
        groups = max(-(-n // GROUP_ITEMS), groups // FAN_IN, 1)
    if not moved:
        return pieces.withColumns({"sequence_id": F.col("bin"), "offset": F.col("bin_offset")}).drop(
            "bin", "bin_offset", "fill")
    joined = pieces.join(place, F.col("bin") == F.col("bin0"), "left")
    return joined.withColumn("offset", F.col("bin_offset") + F.coalesce("shift", F.lit(0))).withColumn(
        "sequence_id", F.coalesce("sequence_id", "bin")).drop("bin", "bin_offset", "fill", "bin0", "shift")
