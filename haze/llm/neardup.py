"""Near-duplicate documents: SuperMinHash signatures, banding, verification, connected components.

Each shingle draws one permutation of the ``SLOTS`` signature slots and one fraction per rank; a slot
keeps the smallest rank + fraction that falls on it.  Ranks within an element are all different, so
slots are negatively correlated and the estimate varies less than with independent hashes.  Ranks are
worked off together for all shingles of a text and stop as soon as every slot holds a value below the
next rank.  The permutation is an affine map modulo the prime ``SLOTS``: any two slots take any two
ranks equally often, which is all that the variance depends on.

Texts with equal shingle sets form one class; only one text of a class goes on.  Classes that share a
band are candidates.  Within a band a hub is compared with the others, not all with all: members that
a hub already joined need no further test among themselves.  The hub of a band is its member with the
most band mates, which in a group of altered copies is their original.  Members of bands that then
still hold several components meet once more in an exact prefix-filter join, which finds every
pair above the threshold without listing the pairs of a group; so no link of a band is lost.  Links
are confirmed on whole shingle sets.  Two sets at the
threshold 0.8 miss each other in all bands with probability (1 - 0.8**ROWS)**BANDS = 4e-6.

Defined cases: a null text, or one without words, has an empty set, links with nothing and stands for
itself; shorter texts have their whole word sequence as the one shingle; repeated rows are equal
texts; null ids are larger than any other when the smallest id names a component; an empty table gives an
empty result; other columns, whatever their names, are not read (``deduplicated`` carries them in a struct).
Shingles are compared by 64-bit hashes under a random key of the run; unlike words of L letters share a hash with probability
(L / 2**31)**2, so no texts can be written that count as equal without being so.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm import graph
from haze.llm._bytes import Key, draw_key, mix, row_blocks, shingle_sets
from haze.session import ship_package, written

SLOTS = 251  # prime
BANDS, ROWS = 41, 6


def signatures(shingles: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values (rank << 32 | fraction) of each run of ``shingles``; -1 for an empty run."""
    n = np.diff(bounds)
    out = np.full((len(n), slots), np.iinfo(np.int64).max, np.int64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(n)), n)
    seed = mix(shingles)
    first = (seed % np.uint64(slots)).astype(np.int64)
    step = ((seed >> np.uint64(32)) % np.uint64(slots - 1)).astype(np.int64) + 1
    for rank in range(slots):
        if not len(owner):
            break
        part = mix(seed + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(32)
        np.minimum.at(flat, owner * slots + first, part.astype(np.int64) | (rank << 32))
        first += step
        first[first >= slots] -= slots
        open_ = out.max(axis=1) >= (rank + 1) << 32
        live = open_[owner]
        if not live.all():
            owner, seed, first, step = owner[live], seed[live], first[live], step[live]
    out[n == 0] = -1
    return out


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    cells = sig[:, :bands * rows].astype(np.uint64).reshape(len(sig), bands, rows)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
    for k in range(rows):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + cells[:, :, k])
    return h.view(np.int64)


def _encoded(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def sketches(docs: DataFrame, text: str, doc_id: str, width: int, key: Key) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (digest of the shingle set) and bands of every row."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("text_key"),
                       F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sketch(batches):
        for batch in batches:
            texts = _encoded(batch.column("text"))
            for a, b in row_blocks([len(t) for t in texts]):
                s, bounds = shingle_sets(texts[a:b], width, key)
                n = np.diff(bounds)
                raw = [hashlib.blake2b(s[x:y].tobytes(), digest_size=16).digest() if y > x else None
                       for x, y in zip(bounds[:-1], bounds[1:])]
                bands = band_hashes(signatures(s, bounds))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], batch.column("text_key")[a:b], pa.array(n, pa.int64()),
                     pa.array(raw, pa.binary()),
                     pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * BANDS, pa.array(bands.reshape(-1)))],
                    ["doc_id", "text_key", "n_shingles", "set_key", "bands"])

    return written(rows.mapInArrow(
        sketch, f"doc_id {kind}, text_key binary, n_shingles long, set_key binary, bands array<bigint>"), "nd-sketch")


def _sets(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str, width: int, key: Key) -> DataFrame:
    """The whole shingle sets (set_key, shingles) of the ``wanted`` (set_key, doc_id, text_key) representatives."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("_key"),
                       F.col(text).alias("text"))
    found = rows.join(wanted, (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select(
        "set_key", "text")

    def whole(batches):
        for batch in batches:
            texts = _encoded(batch.column("text"))
            for a, b in row_blocks([len(t) for t in texts]):
                s, bounds = shingle_sets(texts[a:b], width, key)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("set_key")[a:b],
                     pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(s.view(np.int64)))], ["set_key", "shingles"])

    return found.mapInArrow(whole, "set_key binary, shingles array<bigint>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets reach the threshold."""
    x = sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.select("a", "b").join(x, "a").join(y, "b").select(
        "a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("n")).where(
        100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def links(docs: DataFrame, classes: DataFrame, text: str, doc_id: str, width: int, percent: int, key: Key) -> DataFrame:
    """Confirmed links (a, b) between set classes, enough to connect every pair above the threshold."""
    members = classes.select("set_key", "n_shingles", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("n_shingles").alias("least")).where(
        F.col("size") > 1)
    shared = written(members.join(sizes, "band"), "nd-shared")
    ends = shared.groupBy("set_key").agg(F.sum(F.col("size") - 1).alias("degree"))
    wanted = classes.join(ends, "set_key", "left_semi").select("set_key", "doc_id", "text_key")
    sets = written(_sets(docs, wanted, text, doc_id, width, key).dropDuplicates(["set_key"]), "nd-sets")

    rows = shared.join(ends, "set_key")
    hubs = rows.groupBy("band").agg(F.max(F.struct("degree", "set_key", "n_shingles")).alias("hub"))
    n = F.col("n_shingles")
    pairs = written(rows.join(hubs, "band").where(
        (F.col("set_key") != F.col("hub.set_key"))
        & (100 * F.least(n, F.col("hub.n_shingles")) >= percent * F.greatest(n, F.col("hub.n_shingles")))).select(
        F.least("set_key", "hub.set_key").alias("a"), F.greatest("set_key", "hub.set_key").alias("b")).distinct(), "nd-pairs")
    found = written(_linked(pairs, sets, percent), "nd-links")

    # bands that still hold several components: an exact join of their members finds what hubs did not
    comp = graph.components(found)
    named = written(shared.select("band", "set_key", "n_shingles", "least").join(
        comp, F.col("set_key") == F.col("node"), "left").select(
        "band", "set_key", "n_shingles", "least", F.coalesce("component", "set_key").alias("component")), "nd-named")
    mixed = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(
        F.col("low") != F.col("high")).select("band")
    left = written(named.join(mixed, "band").groupBy("set_key").agg(
        F.first("n_shingles").alias("n"), F.min("least").alias("least"), F.first("component").alias("component")), "nd-open")
    new = _prefix_pairs(left, sets, percent).join(pairs, ["a", "b"], "left_anti")
    more = _linked(written(new, "nd-pairs"), sets, percent)
    return written(found.unionByName(more), "nd-links")


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (set_key, n, least, component) in different components that can reach the threshold.

    Exact: two sets of sizes n and m need ``percent * (n + m) / (100 + percent)`` shingles in common, so
    with all shingles in one order, rarest first, they share one of the first ``n - that + 1``; and the
    first one they share must leave enough behind it on both sides.  ``least`` is the smallest size of
    any possible partner.
    """
    need = lambda n, m: F.ceil(F.lit(percent) * (n + m) / F.lit(100.0 + percent) - 1e-9)
    parts = members.join(sets, "set_key").select("set_key", F.explode("shingles").alias("s"))
    often = parts.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    n, m = F.col("n"), F.greatest(F.col("least"), F.ceil(F.lit(percent) * F.col("n") / 100))
    order = parts.join(often, "s").groupBy("set_key").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("order"))
    head = order.join(members, "set_key").select(
        "set_key", "n", "component", F.posexplode(F.slice("order", F.lit(1), F.greatest(
            F.lit(0), n - need(n, m) + 1).cast("int"))).alias("pos", "e")).where(F.col("e.df") > 1)
    head = written(head.select("set_key", "n", "component", "pos", F.col("e.s").alias("s")), "nd-prefix")
    x = head.select("s", *[F.col(c).alias(f"{c}_x") for c in ("set_key", "n", "component", "pos")])
    y = head.select("s", *[F.col(c).alias(f"{c}_y") for c in ("set_key", "n", "component", "pos")])
    nx, ny = F.col("n_x"), F.col("n_y")
    able = (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (
        F.least(nx - F.col("pos_x"), ny - F.col("pos_y")) >= need(nx, ny))
    return x.join(y, "s").where((F.col("set_key_x") < F.col("set_key_y")) & (F.col("component_x") != F.col("component_y"))
                                & able).select(F.col("set_key_x").alias("a"), F.col("set_key_y").alias("b")).distinct()


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5,
           percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id (the smallest id of the component) of every row of ``docs``."""
    key = draw_key()  # both readings of the texts hash under it
    rows = sketches(docs, text, doc_id, width, key)
    classes = written(rows.where(F.col("n_shingles") > 0).groupBy("set_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("rep"),
        F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")).select(
        "set_key", "rep.doc_id", "rep.text_key", "n_shingles", "bands"), "nd-classes")
    comp = graph.components(links(docs, classes, text, doc_id, width, percent, key))
    named = classes.select("set_key", "doc_id").join(comp, F.col("set_key") == F.col("node"), "left").select(
        "set_key", "doc_id", F.coalesce("component", "set_key").alias("component"))
    named = written(named, "nd-components")
    # written on its own, so that the join may split a component that many classes share
    smallest = written(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "nd-smallest")
    label = named.join(smallest, "component").select("set_key", "component", "component_id")
    return rows.drop("bands").join(label, "set_key", "left").withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5,
                 percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id (texts without words all stay)."""
    found = groups(docs, text, doc_id, width, percent)
    best = found.where(F.col("n_shingles") > 0).groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("rep")).select("rep.doc_id", "rep.text_key")
    empty = found.where(F.col("n_shingles") == 0).select("text_key").distinct()
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(doc_id).alias("_id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("_key"))
    kept = inner.join(best, (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    once = kept.dropDuplicates(["_id", "_key"]).select("row.*")
    wordless = inner.where(F.col("_key").isNull()).select("row.*").unionByName(
        inner.join(empty.where(F.col("text_key").isNotNull()), F.col("_key") == F.col("text_key"), "left_semi").select("row.*"))
    return once.unionByName(wordless)
