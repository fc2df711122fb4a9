"""Deep trees and forests: large nodes split in shared scans, small ones finished where their rows are.

Spark's learner keeps a full table of split statistics for every open node, however few rows the node has, and sends it
from every partition; a deep tree has about as many nodes as rows.  Here only nodes of more than ``LOCAL`` rows are split that way
(one scan a level, all trees together).  Then the rows move once, packed, to the task of their node, which grows the rest of
that tree level by level in memory bounded by ``LOCAL`` rows.

The rules are Spark's: at most ``maxBins`` bins a feature, splits by variance or Gini gain over bins, Poisson bootstrap, feature subsets
per node, ``minInstancesPerNode``, leaves of one prediction merged (classes), importances as gain times rows,
normalised per tree.  Bins come from a summary of all rows (Spark: of about 10,000 drawn rows).  Draws are hashes of row number,
tree and seed, so a task that is run again draws the same.
"""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.operators.quantile import summaries
from haze.session import ship_package, written

LOCAL = 1 << 17       # rows of a node that one task finishes
SMALL = 10_000        # up to here Spark's learner is used: it takes its bins from all rows
DEEP = 10             # shallower trees have few nodes
PACK = 1 << 14        # rows of a node in one packed row
TASK = 250_000        # rows that a task of Spark's ensembles holds
UNITS = 400           # shuffle partitions of the packed rows, at most
_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])


@dataclass(frozen=True)
class Spec:
    trees: int
    depth: int
    least: int            # rows a child needs
    gain: float
    classes: int          # 0: regression
    subset: int           # features looked at per node
    bootstrap: bool
    seed: int
    bins: int


def takes(est) -> bool:
    """Forests of classes stay with Spark's learner: their nodes soon hold one class, so they have few."""
    return isinstance(est, (DecisionTreeClassifier, DecisionTreeRegressor, RandomForestRegressor))


def spec_of(est, d: int, classes: int) -> Spec:
    forest = isinstance(est, (RandomForestClassifier, RandomForestRegressor))
    trees = est.getNumTrees() if forest else 1
    rule = est.getFeatureSubsetStrategy() if forest else "all"
    if rule == "auto":
        rule = "all" if trees == 1 else "sqrt" if classes else "onethird"
    subset = {"all": d, "sqrt": math.ceil(math.sqrt(d)), "onethird": math.ceil(d / 3), "log2": max(1, math.ceil(math.log2(d)))}[rule]
    return Spec(trees, est.getMaxDepth(), est.getMinInstancesPerNode(), est.getMinInfoGain(), classes, subset,
                forest and est.getBootstrap(), est.getSeed(), est.getMaxBins())


def thresholds(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Spark's rule: midpoints between neighbours, or about equal weights between cuts where there are too many."""
    value, inverse = np.unique(values, return_inverse=True)
    count = np.bincount(inverse, weights=weights)
    middle = (value[:-1] + value[1:]) / 2
    if len(middle) <= most:
        return middle
    upto, stride = np.cumsum(count), count.sum() / (most + 1)
    out, target = [], stride
    for i in range(1, len(value)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def draws(row: np.ndarray, tree: int, spec: Spec) -> np.ndarray:
    """How often each row is in the sample of a tree."""
    if not spec.bootstrap:
        return np.ones(len(row), np.uint8)
    x = row.astype(np.uint64) + np.uint64(((tree + 1) * 0x9E3779B97F4A7C15 + spec.seed * 0xD1B54A32D192ED03) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)).astype(float) / 2.0**53, side="right").astype(np.uint8)


def _subset(ids: np.ndarray, tree: int, d: int, spec: Spec) -> np.ndarray:
    """nodes x subset: the features each node looks at, drawn from its path number, in the order in which equal gains are
    settled.  As in Spark a reservoir: the first features stand until later ones take their places."""
    k = min(spec.subset, d)
    order = np.tile(np.arange(k), (len(ids), 1))
    if k == d:
        return order
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, d - k + 1, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
    x += np.uint64((spec.seed * 0x165667B19E3779F9 + tree * 0x27D4EB2F165667C5) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    place = ((x >> np.uint64(11)).astype(float) / 2.0**53 * np.arange(k + 1, d + 1)[None, :]).astype(int)
    for i in range(d - k):
        hit = np.flatnonzero(place[:, i] < k)
        order[hit, place[hit, i]] = k + i
    return order


def stats_of(y: np.ndarray, w: np.ndarray, spec: Spec) -> np.ndarray:
    """Columns that add up: rows, and sums and squares of y, or rows of each class."""
    w = w.astype(float)
    if spec.classes:
        return np.concatenate([w[:, None], w[:, None] * (y[:, None] == np.arange(spec.classes)[None, :])], axis=1)
    return np.stack([w, w * y, w * y * y], axis=1)


def impurity(s: np.ndarray, spec: Spec) -> np.ndarray:
    n = np.maximum(s[..., 0], 1.0)  # rows: whole numbers
    if spec.classes:
        return 1.0 - ((s[..., 1:] / n[..., None]) ** 2).sum(axis=-1)
    return np.maximum(s[..., 2] / n - (s[..., 1] / n) ** 2, 0.0)


def _gains(left: np.ndarray, total: np.ndarray, spec: Spec) -> np.ndarray:
    """Gain of splits with the given left sums; -inf where a side has too few rows."""
    right = total - left
    n = np.maximum(total[..., 0], 1.0)
    gain = impurity(total, spec) - (left[..., 0] * impurity(left, spec) + right[..., 0] * impurity(right, spec)) / n
    return np.where((left[..., 0] >= max(spec.least, 1)) & (right[..., 0] >= max(spec.least, 1)), gain, -np.inf)


def best_of(hist: np.ndarray, order: np.ndarray, spec: Spec) -> tuple:
    """(gain, feature, bin, left sums) of the best split of each node; hist: nodes x features x bins x sums."""
    left = hist.cumsum(axis=2)
    gain = _gains(left[:, :, :-1], left[:, :1, -1:], spec)
    flat = np.take_along_axis(gain, order[:, :, None], axis=1).reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    place, b = np.divmod(at, gain.shape[2])
    k = np.arange(len(at))
    f = order[k, place]
    return flat[k, at], f, b, left[k, f, b]


def _best_sparse(bins: np.ndarray, s: np.ndarray, node: np.ndarray, total: np.ndarray, order: np.ndarray, width: int, spec: Spec) -> tuple:
    """As ``best_of`` for many small nodes, from sorted rows: no table of all bins."""
    m = len(total)
    gain, feature, cut, lefts = np.full(m, -np.inf), np.zeros(m, int), np.zeros(m, int), np.zeros_like(total)
    for place in order.T:
        key = node.astype(np.int64) * width + bins[np.arange(len(node)), place[node]]
        by = np.argsort(key, kind="stable")
        key = key[by]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums = np.add.reduceat(s[by], start, axis=0)
        who, bin_ = np.divmod(key[start], width)
        head = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        upto = sums.cumsum(axis=0)
        before = np.concatenate([np.zeros((1, s.shape[1])), upto])[head]
        left = upto - np.repeat(before, np.diff(np.concatenate([head, [len(who)]])), axis=0)
        g = _gains(left, total[who], spec)
        most = np.maximum.reduceat(g, head)
        hit = np.flatnonzero(g == np.repeat(most, np.diff(np.concatenate([head, [len(who)]]))))
        hit = hit[np.concatenate([[True], who[hit][1:] != who[hit][:-1]])]
        better = hit[g[hit] > gain[who[hit]]]
        w = who[better]
        gain[w], feature[w], cut[w], lefts[w] = g[better], place[w], bin_[better], left[better]
    return gain, feature, cut, lefts


def grow(bins: np.ndarray, s: np.ndarray, root: int, depth: int, tree: int, width: int, pure: float, spec: Spec) -> dict:
    """The subtree of the given rows, breadth first.  ``root``: path number (1 at the top), ``depth``: its level."""
    total = s.sum(axis=0)[None, :]
    node, ids = np.zeros(len(s), int), np.array([root], np.int64)
    out = {k: [] for k in ("feature", "cut", "left", "stats", "gain")}
    done = 0
    while len(ids):
        m, n, d = len(ids), len(s), bins.shape[1]
        can = (impurity(total, spec) > pure) & (total[:, 0] >= 2 * max(spec.least, 1)) & (depth < spec.depth)
        gain, feature, cut, left = np.full(m, -np.inf), np.zeros(m, int), np.zeros(m, int), np.zeros_like(total)
        live = np.flatnonzero(can)
        if len(live):
            pos = np.full(m, -1)
            pos[live] = np.arange(len(live))
            keep = pos[node] >= 0
            bins, s, node = bins[keep], s[keep], pos[node[keep]]
            order = _subset(ids[live], tree, d, spec)
            if len(live) * width <= len(s):
                hist = np.empty((len(live), d, width, s.shape[1]))
                for f in range(d):
                    key = node * width + bins[:, f]
                    for k in range(s.shape[1]):
                        hist[:, f, :, k] = np.bincount(key, weights=s[:, k], minlength=len(live) * width).reshape(-1, width)
                found = best_of(hist, order, spec)
            else:
                found = _best_sparse(bins, s, node, total[live], order, width, spec)
            gain[live], feature[live], cut[live], left[live] = found
        split = (gain > 0) & (gain >= spec.gain)
        where = np.flatnonzero(split)
        child = np.full(m, -1, np.int64)
        child[where] = done + m + 2 * np.arange(len(where))
        out["feature"].append(np.where(split, feature, -1).astype(np.int16))
        out["cut"].append(cut.astype(np.uint8))
        out["left"].append(child)
        out["stats"].append(total)
        out["gain"].append(np.where(split, gain, 0.0))
        if len(where):
            back = np.full(m, -1)
            back[where] = np.arange(len(where))
            at = back[live[node]]
            keep = at >= 0
            bins, s, at = bins[keep], s[keep], at[keep]
            right = bins[np.arange(len(at)), feature[where][at]] > cut[where][at]
            node = 2 * at + right
            total = np.stack([left[where], total[where] - left[where]], axis=1).reshape(-1, s.shape[1])
            ids = np.stack([2 * ids[where], 2 * ids[where] + 1], axis=1).ravel()
        else:
            ids = ids[:0]
        done, depth = done + m, depth + 1
    out = {k: np.concatenate(v) for k, v in out.items()}
    return _merged(out, spec)


def _merged(t: dict, spec: Spec) -> dict:
    """Classes: two leaves of one prediction become their parent, from below."""
    if not spec.classes:
        return t
    guess = t["stats"][:, 1:].argmax(axis=1)
    feature, left = t["feature"].copy(), t["left"]
    while True:
        inner = np.flatnonzero(feature >= 0)
        a = left[inner]
        same = inner[(feature[a] < 0) & (feature[a + 1] < 0) & (guess[a] == guess[a + 1])]
        if not len(same):
            break
        feature[same] = -1
    return {**t, "feature": feature, "gain": np.where(feature >= 0, t["gain"], 0.0)}


def importance(t: dict, d: int) -> np.ndarray:
    inner = t["feature"] >= 0
    return np.bincount(t["feature"][inner], weights=(t["gain"] * t["stats"][:, 0])[inner], minlength=d)[:d]


def _walk(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The node at which each row of codes (or values, with cuts to match) ends."""
    at = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while len(rows):
        f = feature[at[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        here = at[rows]
        at[rows] = left[here] + ~(bins[rows, f] <= cut[here])
    return at


@dataclass
class _Top:
    """The split large nodes of a tree and, as leaves, where its units start."""
    feature: list
    cut: list
    left: list
    stats: list
    gain: list

    @classmethod
    def empty(cls) -> "_Top":
        return cls([-1], [0], [-1], [None], [0.0])

    def add(self, stats: np.ndarray) -> int:
        for x, v in zip((self.feature, self.cut, self.left, self.stats, self.gain), (-1, 0, -1, stats, 0.0)):
            x.append(v)
        return len(self.feature) - 1

    def arrays(self) -> tuple:
        return np.array(self.feature), np.array(self.cut), np.array(self.left)


def _codes(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, d)


def _split_large(binned: DataFrame, tops: list[_Top], slots: list[tuple], d: int, width: int, middle: float, spec: Spec) -> dict[int, tuple]:
    """Best split of each open node (tree, node, path number, depth), in one scan."""
    k = 1 + (spec.classes or 2)
    by_tree: dict[int, np.ndarray] = {}
    walks = {t: tops[t].arrays() for t, *_ in slots}
    for i, (t, node, *_) in enumerate(slots):
        by_tree.setdefault(t, np.full(len(tops[t].feature), -1))[node] = i

    def scan(batches):
        total = np.zeros((len(slots), d, width, k))
        for batch in batches:
            row, code = batch.column("row").to_numpy(), _codes(batch.column("bins"), d)
            y = batch.column("y").to_numpy() - middle
            for t, slot_of in by_tree.items():
                w = draws(row, t, spec)
                slot = slot_of[_walk(*walks[t], code)]
                use = np.flatnonzero((w > 0) & (slot >= 0))
                s = stats_of(y[use], w[use], spec)
                mine = np.unique(slot[use])
                at = np.searchsorted(mine, slot[use])
                for f in range(d):
                    key = at * width + code[use, f]
                    for c in range(k):
                        total[mine, f, :, c] += np.bincount(key, weights=s[:, c], minlength=len(mine) * width).reshape(-1, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(slots)), pa.int32()), pa.array(list(total.reshape(len(slots), -1)), pa.list_(pa.float64()))],
                                         ["slot", "values"])

    def choose(batches):
        for batch in batches:
            for slot, values in zip(batch.column("slot").to_pylist(), batch.column("values")):
                hist = np.asarray(values.values).reshape(1, d, width, k)
                order = _subset(np.array([slots[slot][2]], np.int64), slots[slot][0], d, spec)
                gain, f, b, left = (v[0] for v in best_of(hist, order, spec))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot], pa.int32()), pa.array([gain]), pa.array([f], pa.int32()), pa.array([b], pa.int32()),
                     pa.array([left], pa.list_(pa.float64())), pa.array([hist[0, 0].sum(axis=0)], pa.list_(pa.float64()))],
                    ["slot", "gain", "feature", "cut", "below", "total"])

    sums = binned.mapInArrow(scan, "slot int, values array<double>").groupBy("slot").agg(
        Summarizer.sum(array_to_vector("values")).alias("v")).select("slot", vector_to_array("v").alias("values"))
    found = sums.mapInArrow(choose, "slot int, gain double, feature int, cut int, below array<double>, total array<double>").collect()
    return {r["slot"]: (r["gain"], r["feature"], r["cut"], np.array(r["below"]), np.array(r["total"])) for r in found}


def _tops(binned: DataFrame, n: int, d: int, width: int, middle: float, pure: float, spec: Spec) -> tuple[list[_Top], list[tuple]]:
    """Trees split down to nodes of at most ``LOCAL`` rows, and those nodes as (tree, node, path number, depth)."""
    tops = [_Top.empty() for _ in range(spec.trees)]
    first = [(t, 0, 1, 0) for t in range(spec.trees)]
    units, open_ = ([], first) if n > LOCAL else (first, [])
    most = max(1, (1 << 23) // (d * width * (1 + (spec.classes or 2))))
    while open_:
        following = []
        for a in range(0, len(open_), most):
            slots = open_[a:a + most]
            found = _split_large(binned, tops, slots, d, width, middle, spec)
            for i, (t, node, path, depth) in enumerate(slots):
                gain, f, b, below, total = found[i]
                top = tops[t]
                top.stats[node] = total
                if not (gain > 0 and gain >= spec.gain and impurity(total, spec) > pure and depth < spec.depth):
                    continue
                top.feature[node], top.cut[node], top.gain[node] = f, b, gain
                for side, s in enumerate((below, total - below)):
                    child = top.add(s)
                    if side == 0:
                        top.left[node] = child
                    place = (t, child, 2 * path + side, depth + 1)
                    if depth + 1 < spec.depth and impurity(s, spec) > pure:
                        (following if s[0] > LOCAL else units).append(place)
        open_ = following
    return tops, units


_UNIT = "unit int, importance array<double>, stats array<double>, split boolean, nodes binary, sums binary"


def _finished(binned: DataFrame, tops: list[_Top], units: list[tuple], d: int, width: int, middle: float, pure: float, spec: Spec,
              keep: bool) -> list:
    """Every unit grown where its rows meet: importances and root, and with ``keep`` its nodes."""
    walks, unit_of = {}, {}
    for u, (t, node, *_) in enumerate(units):
        walks[t] = walks.get(t) or tops[t].arrays()
        unit_of.setdefault(t, np.full(len(tops[t].feature), -1))[node] = u

    def pack(batches):
        def emit(row, code, y):
            for t, of in unit_of.items():
                w = draws(row, t, spec)
                unit = of[_walk(*walks[t], code)]
                use = np.flatnonzero((w > 0) & (unit >= 0))
                use = use[np.argsort(unit[use], kind="stable")]
                ids, start = np.unique(unit[use], return_index=True)
                out = []
                for u, a, b in zip(ids.tolist(), start, [*start[1:], len(use)]):
                    for c in range(a, b, PACK):
                        part = use[c:min(b, c + PACK)]
                        out.append((u, len(part), code[part].tobytes() + w[part].tobytes() + y[part].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()),
                                                  pa.array([o[2] for o in out], pa.binary())], ["unit", "n", "rows"])

        held, size = [], 0
        for batch in batches:
            held.append((batch.column("row").to_numpy(), _codes(batch.column("bins"), d), batch.column("y").to_numpy() - middle))
            size += batch.num_rows
            if size >= 1 << 16:
                yield from emit(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if held:
            yield from emit(*(np.concatenate(x) for x in zip(*held)))

    def finish(table: pa.Table) -> pa.Table:
        u = table.column("unit")[0].as_py()
        code, w, y = [], [], []
        for n, blob in zip(table.column("n").to_pylist(), table.column("rows").to_pylist()):
            code.append(np.frombuffer(blob, np.uint8, n * d).reshape(n, d))
            w.append(np.frombuffer(blob, np.uint8, n, n * d))
            y.append(np.frombuffer(blob, np.float64, n, n * (d + 1)))
        code, s = np.concatenate(code), stats_of(np.concatenate(y), np.concatenate(w), spec)
        t, _, path, depth = units[u]
        found = grow(code, s, path, depth, t, width, pure, spec)
        nodes = b"".join((found["feature"].tobytes(), found["cut"].tobytes(), found["left"].astype(np.int32).tobytes())) if keep else b""
        return pa.Table.from_arrays(
            [pa.array([u], pa.int32()), pa.array([importance(found, d)], pa.list_(pa.float64())), pa.array([found["stats"][0]], pa.list_(pa.float64())),
             pa.array([bool(found["feature"][0] >= 0)]), pa.array([nodes], pa.binary()), pa.array([_values(found["stats"], spec).tobytes() if keep else b""], pa.binary())],
            ["unit", "importance", "stats", "split", "nodes", "sums"])

    if not units:
        return []
    packed = binned.mapInArrow(pack, "unit int, n int, rows binary").repartition(min(len(units), UNITS), "unit")
    return packed.groupBy("unit").applyInArrow(finish, _UNIT).collect()


def _values(stats: np.ndarray, spec: Spec) -> np.ndarray:
    """Mean of a node (regression), or its rows by class."""
    return stats[:, 1:] if spec.classes else stats[:, 1:2] / np.maximum(stats[:, :1], 1e-300)


@dataclass
class Grown:
    importances: np.ndarray
    trees: list            # per tree: feature, threshold, left, values
    spec: Spec


def fit(est, rows: DataFrame, features: str = "features", label: str = "label", keep: bool = True) -> Grown:
    """Trees of a Spark estimator's settings; with ``keep`` off only the importances, and no nodes, come back."""
    ship_package(rows.sparkSession)
    data = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    y = F.col("y")
    head = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(y.isNull() | F.isnan(y)).alias("bad"), F.max("y").alias("top"),
                    F.avg("y").alias("mean"), F.var_pop("y").alias("spread"), F.max(F.size("x")).alias("d")).first()
    if not head["n"] or head["bad"]:
        raise ValueError("no rows to fit on, or labels that are null or NaN")
    n, d = head["n"], head["d"]
    classes = int(head["top"]) + 1 if isinstance(est, (DecisionTreeClassifier, RandomForestClassifier)) else 0
    spec = spec_of(est, d, classes)
    middle, pure = (0.0, 1e-12) if classes else (head["mean"], 1e-12 * head["spread"])
    wide = data.select(*[F.col("x")[i].alias(f"c{i}") for i in range(d)])
    cuts = [thresholds(*s, min(spec.bins, 256) - 1) for s in summaries(wide, [f"c{i}" for i in range(d)])]
    width = max(2, max(len(c) for c in cuts) + 1)

    def code(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            codes = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([r.tobytes() for r in codes], pa.binary()), batch.column("y")],
                                             ["row", "bins", "y"])

    binned = written(data.withColumn("row", F.monotonically_increasing_id()).mapInArrow(code, "row long, bins binary, y double"), "tree-bins")
    tops, units = _tops(binned, n, d, width, middle, pure, spec)
    found = {r["unit"]: r for r in _finished(binned, tops, units, d, width, middle, pure, spec, keep)}
    return _grown(tops, units, found, cuts, d, middle, spec, keep)


def _grown(tops, units, found, cuts, d, middle, spec, keep) -> Grown:
    mine: dict[int, list[int]] = {}
    for u, (t, *_) in enumerate(units):
        mine.setdefault(t, []).append(u)
    total, trees = np.zeros(d), []
    cut_at = np.full((d, 256), np.inf)
    for i, c in enumerate(cuts):
        cut_at[i, :len(c)] = c
    k = spec.classes or 1
    for t, top in enumerate(tops):
        own = [(units[u][1], found[u]) for u in mine.get(t, []) if u in found]
        for node, r in own:
            top.stats[node] = np.array(r["stats"])
            top.feature[node] = 0 if r["split"] else -1
        # the roots of units count as split for the merging of leaves, not for the importances
        feature, _, left = top.arrays()
        for node, r in own:
            left[node] = node if r["split"] else -1
        stats = np.array(top.stats)
        whole = _merged_top({"feature": feature, "left": left, "stats": stats, "gain": np.array(top.gain)}, {n for n, _ in own}, spec)
        imp = importance(whole, d) + sum((np.array(r["importance"]) for _, r in own), np.zeros(d))
        total += imp / imp.sum() if imp.sum() > 0 else 0.0
        if not keep:
            continue
        parts = {"feature": [whole["feature"].astype(np.int16)], "cut": [np.array(top.cut, np.uint8)], "left": [left.astype(np.int32)], "value": [_values(stats, spec)]}
        size = len(feature)
        for node, r in own:
            if not r["split"]:
                continue
            m = len(r["nodes"]) // 7
            f, c, l = (np.frombuffer(r["nodes"], kind, m, m * at) for kind, at in ((np.int16, 0), (np.uint8, 2), (np.int32, 3)))
            l = l + (size - 1)
            parts["feature"][0][node], parts["cut"][0][node], parts["left"][0][node] = f[0], c[0], l[0]
            for name, v in (("feature", f), ("cut", c), ("left", l.astype(np.int32)), ("value", np.frombuffer(r["sums"]).reshape(m, k))):
                parts[name].append(v[1:])
            size += m - 1
        feature, cut, left, value = (np.concatenate(parts[x]) for x in ("feature", "cut", "left", "value"))
        at = np.where(feature >= 0, cut_at[np.maximum(feature, 0), cut], 0.0)
        trees.append((feature, at, left, value if spec.classes else value + middle))
    return Grown(total / total.sum() if total.sum() > 0 else total, trees, spec)


def _merged_top(t: dict, roots: set, spec: Spec) -> dict:
    inner = np.array([i not in roots for i in range(len(t["feature"]))])
    if spec.classes:
        guess, feature = t["stats"][:, 1:].argmax(axis=1), t["feature"]
        for i in reversed(range(len(feature))):  # children follow their parents
            a = t["left"][i]
            if inner[i] and feature[i] >= 0 and feature[a] < 0 and feature[a + 1] < 0 and guess[a] == guess[a + 1]:
                feature[i] = -1
    return {**t, "gain": np.where(inner & (t["feature"] >= 0), t["gain"], 0.0)}


class DeepTreesModel(Model, MLWritable, MLReadable):
    """Fitted trees as arrays of nodes; adds ``prediction`` and, for classes, ``rawPrediction`` and ``probability``."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector of features", TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "0: regression", TypeConverters.toInt)
    importances = Param(Params._dummy(), "importances", "one per feature", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", numClasses=0, importances=None):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**self._input_kwargs)
        self.trees, self._sent = [], None

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.getOrDefault(self.importances))

    def getNumTrees(self) -> int:
        return len(self.trees)

    def _transform(self, df: DataFrame) -> DataFrame:
        spark, k = df.sparkSession, self.getOrDefault(self.numClasses)
        ship_package(spark)
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(self.trees)
        sent = self._sent

        def predict(batches):
            for x in batches:
                x = np.array(x.tolist(), float).reshape(len(x), -1) if len(x) else np.zeros((0, 1))
                total = np.zeros((len(x), max(k, 1)))
                for feature, at, left, value in sent.value:
                    v = value[_walk(feature, at, left, x)]
                    total += v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300) if k and len(sent.value) > 1 else v
                yield _series(total if k else total[:, 0] / len(sent.value), k)

        from collections.abc import Iterator

        import pandas as pd

        predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        found = F.pandas_udf(predict, "array<double>" if k else "double")(vector_to_array(self.getOrDefault(self.featuresCol)))
        if not k:
            return df.withColumn("prediction", found)
        whole = F.aggregate("_v", F.lit(0.0), lambda s, v: s + v)
        return df.withColumn("_v", found).withColumns({
            "rawPrediction": array_to_vector("_v"), "probability": array_to_vector(F.transform("_v", lambda v: v / whole)),
            "prediction": (F.array_position("_v", F.array_max("_v")) - 1).cast("double")}).drop("_v")

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader()


def _series(values: np.ndarray, k: int):
    import pandas as pd

    return pd.Series(list(values) if k else values)


class _Writer(MLWriter):
    def __init__(self, model: DeepTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        rows = [(i, *[base64.b64encode(np.ascontiguousarray(v).tobytes()).decode() for v in tree]) for i, tree in enumerate(self.model.trees)]
        spark.createDataFrame(rows, "tree int, feature string, at string, left string, value string").write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def __init__(self, kind: type | None = None):
        super().__init__()
        self.kind = kind or DeepTreesModel

    def load(self, path: str) -> DeepTreesModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.kind()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        k = max(model.getOrDefault(model.numClasses), 1) if self.kind is DeepTreesModel else 1
        for r in spark.read.parquet(f"{path}/trees").orderBy("tree").collect():
            f, at, left, value = (np.frombuffer(base64.b64decode(r[c]), kind) for c, kind in
                                  (("feature", np.int16), ("at", float), ("left", np.int32), ("value", float)))
            model.trees.append((f, at, left, value.reshape(-1, k)))
        return model


def _more_than_small(rows: DataFrame) -> bool:
    return len(rows.select(F.lit(1)).head(SMALL + 1)) > SMALL


def _deep(est, rows: DataFrame) -> bool:
    return est.getMaxDepth() >= DEEP and est.getMaxBins() <= 256 and _more_than_small(rows)


def importances(est, rows: DataFrame) -> np.ndarray:
    """Importances of the forest ``est`` fits, without the forest."""
    if not _deep(est, rows):
        return est.fit(rows).featureImportances.toArray()
    return fit(est, rows, est.getFeaturesCol(), est.getLabelCol(), keep=False).importances


def dealt(rows: DataFrame) -> DataFrame:
    """At most about ``TASK`` rows a partition: Spark's ensembles hold each row with one count per tree."""
    parts = -(-rows.count() // TASK)
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def fitted(est, rows: DataFrame):
    """``est.fit(rows)``; on more rows than ``SMALL`` a deep tree or forest by the scans of this module, boosting by its own."""
    from haze.functions import boosting

    if boosting.takes(est) and _more_than_small(rows):
        return boosting.fit(est, rows)
    if isinstance(est, (RandomForestClassifier, OneVsRest, GBTClassifier, GBTRegressor)):
        return est.fit(dealt(rows))
    if not (takes(est) and _deep(est, rows)):
        return est.fit(rows)
    found = fit(est, rows, est.getFeaturesCol(), est.getLabelCol())
    model = DeepTreesModel(featuresCol=est.getFeaturesCol(), numClasses=found.spec.classes, importances=[float(v) for v in found.importances])
    model.trees = found.trees
    return model
