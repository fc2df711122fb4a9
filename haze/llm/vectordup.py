"""Near-duplicate vectors by cosine: a pigeonhole join over blocks of rotated coordinates, exact.

Unit vectors with cosine c are ``2 - 2c`` apart in squared distance.  Vectors are turned by one fixed random
rotation and cut into ``BLOCKS`` blocks of coordinates.  The squared distance is the sum of the blocks',
so a pair at or above the cosine is within its share of the budget in at least one block.  Each block is a
range join of its own; the pairs it finds are candidates, and every candidate is confirmed by the cosine
of the vectors themselves, in double precision.  No link is missed and none is found below the threshold.

Range join of one block.  A bounded sample of vectors are pivots; a vector is at home with its nearest one, and
homes are dealt into units of about ``UNIT`` vectors, a crowded home into several.  By the
triangle inequality a vector within radius r of something at home with another pivot lies at most r beyond
the plane between the two pivots, and at most r outside the ball around the home.  It visits the units of
those homes alone, and only units before its own, so that each pair meets once per block.  A task holds one unit and
streams its visitors past it; block distances are matrix products, and a pair is counted
in the first block that admits it.

Units are dealt and met in rounds of at most ``DEALT`` of vectors times blocks (one unit may be more), each in its own shuffle whose files go at
its end: the disk in use follows the input, whatever the visits; each further round reads the vectors again.

Nothing is emitted per pair: a unit gives link counts per vector and a spanning forest of its links.  Equal vectors
are one class with a count, so copies cost one row.

What stays quadratic: for vectors without any structure in a block the planes prune little, and a vector visits up to
half of all units (n / ``UNIT`` / 2 copies of it in each block); within one crowded home every pair of
units meets.  Both are spread evenly over tasks.

Defined cases: vectors that are null, zero or hold null, NaN or infinite entries, and vectors not of the table's
commonest length, link with nothing and stand for themselves; repeated rows are linked copies; null ids are
larger than any other when the smallest id names a component; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm import graph
from haze.llm._vectors import common_length, finite, matrix
from haze.session import scratch_dir, ship_package, written

COSINE = 0.9
BLOCKS = 4
UNIT = 4096
PIVOTS = 256  # at most so many pivots per block, the vectors with the smallest hashes
SLACK = 1e-5  # single precision in the distances of a block never loses a pair
DEALT, LEAST = 0.5, 1 << 18  # rows dealt in a round: this share of vectors times blocks, and no less than so many
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
STRIP = 1024  # visitors compared at a time


def rotation(d: int, seed: int = 11) -> np.ndarray:
    """A fixed random orthonormal matrix; column ranges of it are the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def block_edges(d: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    cuts = np.linspace(0, d, min(blocks, d) + 1).round().astype(int).tolist()
    return list(zip(cuts, cuts[1:]))


def unit_length(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by the largest entry first, so that no square overflows."""
    m = m.astype(float)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class Space:
    """The rotation, the blocks' radii, and per block the pivots, ball radii and first units: what tasks share."""

    def __init__(self, d: int, cosine: float, pivots: np.ndarray, blocks: int = BLOCKS):
        self.turn, self.edges, self.cosine = rotation(d), block_edges(d, blocks), cosine
        self.budget = [(2 - 2 * cosine) * (b - a) / d for a, b in self.edges]
        turned = pivots @ self.turn
        self.pivots = [turned[:, a:b] for a, b in self.edges]
        self.radius = self.first = self.units = None

    def far(self, y: np.ndarray, k: int) -> np.ndarray:
        """Squared distances of block coordinates to the block's pivots."""
        a, b = self.edges[k]
        z, p = y[:, a:b], self.pivots[k]
        return np.maximum((z * z).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * z @ p.T, 0.0)

    def reached(self, far: np.ndarray, home: np.ndarray, k: int) -> np.ndarray:
        """Which homes may hold something within the block's radius of each vector."""
        r = np.sqrt(self.budget[k]) + SLACK
        p = self.pivots[k]
        apart = np.sqrt(np.maximum((p * p).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * p @ p.T, 0.0))[home]
        nearest = np.take_along_axis(far, home[:, None], axis=1)
        plane = (far - nearest) <= 2 * (r + SLACK) * apart + SLACK
        return plane & (np.sqrt(far) <= self.radius[k][None, :] + r + SLACK)


def _classes(docs: DataFrame, vector: str, doc_id: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc_id, v or null) and distinct vectors (v, copies, class); both written."""
    good = finite(vector) & F.exists(F.col(vector), lambda c: c != 0)
    d = common_length(docs.where(good), vector)
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), F.when(good & (F.size(vector) == d), F.col(vector)).alias("v")), "vd-rows")
    classes = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"))
    return rows, written(classes.withColumn("class", F.monotonically_increasing_id()), "vd-classes"), d


def _homes(space: Space):
    """(block, home, count, largest distance) of the vectors of a task."""
    def scan(batches):
        count = [np.zeros(len(p), np.int64) for p in space.pivots]
        most = [np.zeros(len(p)) for p in space.pivots]
        for b in batches:
            if b.num_rows:
                y = unit_length(matrix(b.column("v"), len(space.turn))) @ space.turn
                for k in range(len(space.edges)):
                    far = space.far(y, k)
                    home = far.argmin(axis=1)
                    count[k] += np.bincount(home, minlength=len(count[k]))
                    np.maximum.at(most[k], home, far[np.arange(len(far)), home])
        for k in range(len(space.edges)):
            at = np.flatnonzero(count[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)),
                                              pa.array(count[k][at]), pa.array(most[k][at])], ["block", "home", "n", "far"])
    return scan


def _visits(space: Space, far: np.ndarray, ids: np.ndarray, k: int):
    """Of one block: the vectors' own units, and (row, unit) of the earlier units they have to visit."""
    home = far.argmin(axis=1)
    first, units = space.first[k], space.units[k]
    own = first[home] + ids % units[home]
    owner = np.repeat(np.arange(len(units)), units)  # home of each unit
    return own, np.nonzero(space.reached(far, home, k)[:, owner] & (np.arange(len(owner))[None, :] < own[:, None]))


def _sizes(space: Space):
    """(block, unit, count) of the rows that a task deals."""
    def scan(batches):
        total = [np.zeros(int(u.sum()), np.int64) for u in space.units]
        for b in batches:
            if b.num_rows:
                ids, y = b.column("class").to_numpy(), unit_length(matrix(b.column("v"), len(space.turn))) @ space.turn
                for k, mine in enumerate(total):
                    own, (_, unit) = _visits(space, space.far(y, k), ids, k)
                    mine += np.bincount(own, minlength=len(mine)) + np.bincount(unit, minlength=len(mine))
        for k, mine in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), k, np.int32)), pa.array(np.arange(len(mine))), pa.array(mine)],
                                             ["block", "unit", "n"])
    return scan


def _rounds(sizes: list[tuple[int, int, int]], most: int) -> list[dict[int, tuple[int, int]]]:
    """Runs of units (block -> first, last) that are dealt together: at most ``most`` rows, or one unit."""
    out, held = [], 0
    for block, unit, n in sorted(sizes):
        if not out or held + n > most:
            out.append({})
            held = 0
        held += n
        out[-1][block] = (out[-1].get(block, (unit, unit))[0], unit)
    return out


def _dealt(space: Space, these: dict[int, tuple[int, int]]):
    """Each vector once for its own unit of every block and once for every earlier unit it has to visit, of the units of a round."""
    def scan(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, copies, v = b.column("class").to_numpy(), b.column("copies"), b.column("v")
            y = unit_length(matrix(v, len(space.turn))) @ space.turn
            for k, (low, high) in these.items():
                own, (row, unit) = _visits(space, space.far(y, k), ids, k)
                row = np.concatenate([np.arange(len(ids)), row])
                unit = np.concatenate([own, unit])
                guest = np.arange(len(row)) >= len(ids)
                use = (unit >= low) & (unit <= high)
                row, unit, guest = row[use], unit[use], guest[use]
                for a in range(0, len(row), 8192):
                    part = pa.array(row[a:a + 8192])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), k, np.int32)), pa.array(unit[a:a + 8192].astype(np.int64)), pa.array(guest[a:a + 8192]),
                         pa.array(ids).take(part), copies.take(part), v.take(part)], ["block", "unit", "guest", "class", "copies", "v"])
    return scan


class _Unit:
    """The vectors at home in one unit of a block; guests are compared as they come."""

    def __init__(self, space: Space, block: int):
        self.space, self.block = space, block
        self.rows, self.ids, self.copies = [], [], []
        self.vectors = None

    def add(self, v: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> None:
        self.rows.append(v)
        self.ids.append(ids)
        self.copies.append(copies)

    def close(self):
        """No more residents: links among themselves."""
        none = np.zeros(0, np.int64)
        self.vectors = np.concatenate([np.zeros((0, len(self.space.turn))), *self.rows])
        self.ids, self.copies = np.concatenate([none, *self.ids]), np.concatenate([none, *self.copies])
        self.rows, self.links, self.label = None, np.zeros(len(self.ids), np.int64), np.arange(len(self.ids))
        self.turned = self._turned(self.vectors)
        for a in range(0, len(self.ids), STRIP):
            yield from self._compare(self.vectors[a:a + STRIP], self.turned[a:a + STRIP], self.ids[a:a + STRIP], self.copies[a:a + STRIP], a)

    def _turned(self, v: np.ndarray) -> np.ndarray:
        a, b = self.space.edges[self.block]
        return (v @ self.space.turn[:, a:b]).astype(np.float32)

    def guests(self, v: np.ndarray, ids: np.ndarray, copies: np.ndarray):
        turned = self._turned(v)
        for a in range(0, len(ids), STRIP):
            yield from self._compare(v[a:a + STRIP], turned[a:a + STRIP], ids[a:a + STRIP], copies[a:a + STRIP], None)

    def _compare(self, v, turned, ids, copies, start):
        """Confirmed links of a strip with the residents; ``start``: where the strip stands among them."""
        mine = self.turned if start is None else self.turned[start:]
        shift = start or 0
        half = (mine * mine).sum(axis=1) / 2
        own = (turned * turned).sum(axis=1) / 2
        near = turned @ mine.T >= own[:, None] + half[None, :] - np.float32((self.space.budget[self.block] + SLACK) / 2)
        g, r = np.nonzero(near)
        r = r + shift
        if start is not None:
            keep = r > g + start
            g, r = g[keep], r[keep]
        for a in range(0, len(g), 1 << 15):
            x, y = v[g[a:a + (1 << 15)]], self.vectors[r[a:a + (1 << 15)]]
            good = np.einsum("ij,ij->i", x, y) >= self.space.cosine
            at = np.flatnonzero(good)
            if len(at):  # the pair belongs to the first block that admits it, decided in double precision
                diff = ((x[at] - y[at]) @ self.space.turn) ** 2
                within = [diff[:, lo:hi].sum(axis=1) <= b + 1e-9 for (lo, hi), b in zip(self.space.edges, self.space.budget)]
                good[at] = (np.stack(within).argmax(axis=0) == self.block) & within[self.block]
            gg, rr = g[a:a + (1 << 15)][good], r[a:a + (1 << 15)][good]
            if len(gg):
                yield from self._linked(gg, rr, ids, copies, start)

    def _linked(self, g, r, ids, copies, start):
        self.links += np.bincount(r, weights=copies[g], minlength=len(self.links)).astype(np.int64)
        found = np.bincount(g, weights=self.copies[r], minlength=len(ids)).astype(np.int64)
        at = np.flatnonzero(found)
        if start is not None:
            self.links[at + start] += found[at]
            self._join(g + start, r)
        else:
            one = np.full(len(ids), -1)
            one[g[::-1]] = r[::-1]
            yield ids[at], self.ids[one[at]], found[at]
            self._join(one[g], r)

    def _join(self, a, b):
        """Residents a and b are connected: labels sink to the smallest, round by round."""
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                down = self.label[self.label]
                if np.array_equal(down, self.label):
                    break
                self.label = down

    def end(self):
        at = np.flatnonzero((self.links > 0) | (self.label != np.arange(len(self.label))))
        if len(at):
            yield self.ids[at], self.ids[self.label[at]], self.links[at]


def _met(space: Space):
    """(a, b, links): class a has so many links here, and is connected with class b."""
    def scan(batches):
        unit, key = None, None

        def out(parts):
            for a, b, n in parts:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            block, number, guest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "unit", "guest"))
            change = np.flatnonzero((np.diff(block) != 0) | (np.diff(number) != 0) | (np.diff(guest.astype(np.int8)) != 0)) + 1
            cuts = [0, *change.tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                part = batch.slice(x, y - x)
                v = unit_length(matrix(part.column("v"), len(space.turn)))
                ids, copies = part.column("class").to_numpy(), part.column("copies").to_numpy()
                if (block[x], number[x]) != key:
                    if unit is not None:
                        if unit.vectors is None:
                            yield from out(unit.close())
                        yield from out(unit.end())
                    key, unit = (block[x], number[x]), _Unit(space, int(block[x]))
                if not guest[x]:
                    unit.add(v, ids, copies)
                else:
                    if unit.vectors is None:
                        yield from out(unit.close())
                    yield from out(unit.guests(v, ids, copies))
        if unit is not None:
            if unit.vectors is None:
                yield from out(unit.close())
            yield from out(unit.end())
    return scan


def links(classes: DataFrame, d: int, cosine: float = COSINE, unit: int = UNIT, pivots: int = PIVOTS) -> DataFrame:
    """(a, b, links) rows: their sum per a is the links of class a with other classes, weighted by copies; the
    pairs (a, b) connect what is linked."""
    spark = classes.sparkSession
    ship_package(spark)
    n = classes.count()
    p = max(1, min(pivots, n // unit))
    chosen = classes.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(p).collect()
    space = Space(d, cosine, unit_length(np.array([r["v"] for r in chosen], float)))
    found = classes.select("v").mapInArrow(_homes(space), "block int, home int, n long, far double").groupBy("block", "home").agg(
        F.sum("n").alias("n"), F.max("far").alias("far")).collect()  # at most PIVOTS rows a block
    space.radius, space.first, space.units = [], [], []
    for k in range(len(space.edges)):
        size, far = np.zeros(p, np.int64), np.full(p, -1.0)
        for r in found:
            if r["block"] == k:
                size[r["home"]], far[r["home"]] = r["n"], r["far"] ** 0.5
        units = -(-size // unit)
        space.units.append(units)
        space.first.append(np.concatenate([[0], np.cumsum(units)[:-1]]))
        space.radius.append(far)
    sizes = [tuple(r) for r in classes.select("class", "v").mapInArrow(_sizes(space), "block int, unit long, n long").groupBy("block", "unit").agg(
        F.sum("n").alias("n")).collect()]  # one row a unit
    schema = f"block int, unit long, guest boolean, class long, copies long, v {classes.schema['v'].dataType.simpleString()}"
    root, found = scratch_dir(spark, "vd-links"), "a long, b long, links long"
    kept = spark.conf.get(CLEANED, None)
    for i, these in enumerate(_rounds(sizes, max(int(DEALT * len(space.edges) * n), LEAST))):
        dealt = classes.select("class", "copies", "v").mapInArrow(_dealt(space, these), schema)
        units = sum(high - low + 1 for low, high in these.values())
        spread = max(units, int(spark.conf.get("spark.sql.shuffle.partitions")))
        met = dealt.repartition(spread, "block", "unit").sortWithinPartitions("block", "unit", "guest").mapInArrow(_met(space), found)
        try:
            spark.conf.set(CLEANED, "true")  # a round's shuffle files go when its links are written
            met.write.parquet(f"{root}/round={i}")
        finally:
            spark.conf.unset(CLEANED) if kept is None else spark.conf.set(CLEANED, kept)
    return spark.read.schema(found).parquet(f"{root}/*") if sizes else spark.createDataFrame([], found)


def groups(docs: DataFrame, vector: str = "embedding", doc_id: str = "vec_id", cosine: float = COSINE, unit: int = UNIT) -> DataFrame:
    """doc_id, n_links (other vectors linked directly) and component_id (the smallest id reachable) of every row."""
    rows, classes, d = _classes(docs, vector, doc_id)
    if not d:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    met = links(classes, d, cosine, unit)
    count = met.groupBy("a").agg(F.sum("links").alias("links"))
    comp = graph.components(met)
    named = classes.join(count, F.col("class") == F.col("a"), "left").join(comp, F.col("class") == F.col("node"), "left").select(
        "v", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component"))
    named = written(named, "vd-named")
    # written on its own, so that the join may split a component that many classes share
    smallest = written(named.groupBy("component").agg(F.min("low").alias("component_id")), "vd-smallest")
    label = written(named.join(smallest, "component").select("v", "n_links", "component_id"), "vd-label")
    alone = rows.where(F.col("v").isNull()).select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return rows.where(F.col("v").isNotNull()).join(label, "v").select("doc_id", "n_links", "component_id").unionByName(alone)
