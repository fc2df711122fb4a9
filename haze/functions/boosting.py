"""Boosted trees: the trees of all classes grown together, one scan a level, over rows that stay packed.

Spark's learner runs a job per level, round and class over rows held as objects.  Here the rows are written once as blocks of
``BLOCK`` rows: the bins of a feature side by side, label, margins and gradients (these in single precision) as arrays.  Each round
keeps them with their new margins, in memory or on disk, and in the same job sums up the roots; every ``WRITTEN`` rounds they are written,
so that a lost executor repeats few rounds.  Each further level is one scan of bins and gradients for all classes.  A scan sums only the smaller child of a node,
its sibling is the difference; two features share a table where the bins allow it.  A task holds its blocks (a file split)
and one table per class, open node and feature; the driver holds the sums of one level, whatever the rows.

The rules are Spark's: trees on the gradients of the logistic or squared loss, variance gain over at most ``maxBins`` bins, mean
gradient as leaf, the first tree on the labels at weight 1, the others at ``stepSize``, rows drawn per round.  Bins come from a
summary of all rows (Spark: of about 10,000 drawn rows), draws are hashes of row number, round and seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.functions import trees
from haze.operators.quantile import summaries
from haze.session import drop_scratch, scratch_dir, ship_package

BLOCK = 1 << 15       # rows of a block
PAIRED = 32           # bins up to which two features share a table
GATHER = 32 << 20     # bytes of unadded sums that the driver takes
WRITTEN = 10          # rounds from one writing of the rows to the next; between them they are cached
_STATE = "first long, n int, codes binary, y binary, margin binary, grad binary, sums binary"
_NAMES = ["first", "n", "codes", "y", "margin", "grad", "sums"]


@dataclass(frozen=True)
class Spec:
    models: int           # one per class from three classes on
    classes: int          # 0: regression
    rounds: int
    depth: int
    step: float
    rate: float           # share of rows drawn per round
    least: int            # rows a child needs
    gain: float
    seed: int
    bins: int


def takes(est) -> bool:
    tree = est.getClassifier() if isinstance(est, OneVsRest) else est
    return (isinstance(tree, (GBTClassifier, GBTRegressor)) and tree.getFeatureSubsetStrategy() in ("all", "auto") and tree.getMaxBins() <= 256
            and tree.getMaxDepth() <= trees.DEEP and not any(tree.isDefined(tree.getParam(p)) for p in ("weightCol", "validationIndicatorCol"))
            and not tree.getMinWeightFractionPerNode() and tree.getLossType() in ("logistic", "squared"))


def drawn(first: int, n: int, turn: int, spec: Spec) -> np.ndarray:
    """Whether each row of a block is in the sample of a round."""
    x = np.arange(first, first + n).astype(np.uint64) + np.uint64(((turn + 1) * 0x9E3779B97F4A7C15 + spec.seed * 0xD1B54A32D192ED03) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) / 2.0**53 < spec.rate


def gradients(y: np.ndarray, margin: np.ndarray, k: int, turn: int, spec: Spec) -> np.ndarray:
    """What the tree of model ``k`` is fitted to: the labels first, then the loss's negative gradient."""
    if not spec.classes:
        return y if turn == 0 else 2.0 * (y - margin)
    sign = np.where(y == (k if spec.models > 1 else 1), 1.0, -1.0)
    return sign if turn == 0 else 4.0 * sign / (1.0 + np.exp(np.minimum(2.0 * sign * margin, 700.0)))


def landed(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node (heap order) that each column of codes, or of values with cuts to match, reaches after ``depth`` steps."""
    n = codes.shape[1]
    flat, rows, at = codes.reshape(-1), np.arange(n), np.zeros(n, np.intp)
    for _ in range(depth):
        at = 2 * at + 1 + ~(flat[feature[at] * n + rows] <= cut[at])
    return at


class Tables:
    """Rows and gradient sums by slot, feature and bin, added block by block."""

    def __init__(self, slots: int, d: int, width: int):
        self.slots, self.d, self.width = slots, d, width
        self.group = 2 if width <= PAIRED else 1
        self.cells = width ** self.group
        self.sums = np.zeros((2, -(-d // self.group), slots * self.cells))

    def add(self, codes: np.ndarray, slot: np.ndarray, g: np.ndarray) -> None:
        if (slot < 0).any():
            use = np.flatnonzero(slot >= 0)
            codes, slot, g = codes[:, use], slot[use], g[use]
        base, size = slot * self.cells, self.slots * self.cells
        for j, f in enumerate(range(0, self.d, self.group)):
            key = base + codes[f]
            if self.group == 2 and f + 1 < self.d:
                key += np.multiply(codes[f + 1], self.width, dtype=np.intp)
            self.sums[0, j] += np.bincount(key, minlength=size)
            self.sums[1, j] += np.bincount(key, weights=g, minlength=size)

    def by_feature(self) -> np.ndarray:
        """slots x features x bins x (rows, sum)."""
        t = self.sums.reshape(2, -1, self.slots, self.cells)
        if self.group == 2:
            t = t.reshape(2, -1, self.slots, self.width, self.width)
            t = np.stack([t.sum(axis=3), t.sum(axis=4)], axis=2).reshape(2, -1, self.slots, self.width)[:, :self.d]
        return np.ascontiguousarray(t.transpose(2, 1, 3, 0))


def _blocks(batches, d: int, spec: Spec):
    for batch in batches:
        columns = [batch.column(c) for c in _NAMES[:5]]
        for i in range(batch.num_rows):
            first, n = columns[0][i].as_py(), columns[1][i].as_py()
            if n:
                codes, y, margin = (c[i].as_buffer() for c in columns[2:])
                yield first, n, np.frombuffer(codes, np.uint8).reshape(d, n), np.frombuffer(y), np.frombuffer(margin).reshape(spec.models, n)


def _graded(batches, d: int, spec: Spec):
    for batch in batches:
        count, codes, grad = (batch.column(c) for c in ("n", "codes", "grad"))
        for i, n in enumerate(count.to_pylist()):
            if n:
                yield np.frombuffer(codes[i].as_buffer(), np.uint8).reshape(d, n), np.frombuffer(grad[i].as_buffer(), np.float32).reshape(spec.models, n)


def _row(first, n, codes=None, y=None, margin=None, grad=None, sums=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
        (first, n, codes, y, margin, grad, sums), (pa.int64(), pa.int32(), *[pa.binary()] * 5))], _NAMES)


def _packed(data: DataFrame, cuts: list[np.ndarray], d: int, spec: Spec) -> DataFrame:
    def pack(batches):
        at = TaskContext.get().partitionId() << 33

        def block(x, y):
            codes = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)]).astype(np.uint8)
            return _row(at, len(y), codes.tobytes(), y.astype(float).tobytes(), bytes(8 * spec.models * len(y)))

        held, size = [], 0
        for batch in batches:
            held.append((batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d), batch.column("y").to_numpy()))
            size += batch.num_rows
            while size >= BLOCK:
                x, y = (np.concatenate(v) for v in zip(*held))
                yield block(x[:BLOCK], y[:BLOCK])
                held, size, at = [(x[BLOCK:], y[BLOCK:])], size - BLOCK, at + BLOCK
        if size:
            yield block(*(np.concatenate(v) for v in zip(*held)))

    return data.mapInArrow(pack, _STATE)


def _write(state: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Written as it is: bins and margins hardly compress, and files of one size deal evenly."""
    path = scratch_dir(state.sparkSession, name)
    state.write.options(**{"compression": "none", "parquet.enable.dictionary": "false"}).parquet(path)
    return path, state.sparkSession.read.schema(_STATE).parquet(path)


def _moved(state: DataFrame, grown: list | None, turn: int, d: int, width: int, middle: float, spec: Spec) -> DataFrame:
    """The blocks with the margins of the last round's trees added; the last row of a task has the sums of this round's roots."""
    def move(batches):
        tables = Tables(spec.models, d, width)
        for first, n, codes, y, margin in _blocks(batches, d, spec):
            if grown is not None:
                margin = np.stack([m + value[landed(codes, feature, cut, spec.depth)] for m, (feature, cut, value) in zip(margin, grown)])
            grad = np.stack([gradients(y, margin[k], k, turn, spec) - (0.0 if turn else middle) for k in range(spec.models)]).astype(np.float32)
            if spec.rate < 1:
                grad[:, ~drawn(first, n, turn, spec)] = np.nan
            for k in range(spec.models):
                tables.add(codes, np.where(np.isnan(grad[k]), -1, k), grad[k])
            yield _row(first, n, codes.tobytes(), y.tobytes(), margin.tobytes(), grad.tobytes())
        yield _row(0, 0, sums=tables.by_feature().tobytes())

    return state.mapInArrow(move, _STATE)


def _level(state: DataFrame, heaps: list, slot_of: list[np.ndarray], level: int, d: int, width: int, spec: Spec) -> DataFrame:
    """Sums of the wanted nodes of a level: ``slot_of`` names them by model and place in the heap, -1 for the others."""
    count = [int((s >= 0).sum()) for s in slot_of]
    start = np.cumsum([0, *count])
    own = [np.where(s >= 0, s - start[k], -1) for k, s in enumerate(slot_of)]

    def scan(batches):
        tables = [Tables(c, d, width) for c in count]
        for codes, grad in _graded(batches, d, spec):
            for k in range(spec.models):
                if not count[k]:
                    continue
                slot = own[k][landed(codes, *heaps[k], level)]
                if spec.rate < 1:
                    slot[np.isnan(grad[k])] = -1
                tables[k].add(codes, slot, grad[k])
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([t.by_feature() for t in tables]).tobytes()], pa.binary())], ["sums"])

    return state.select("n", "codes", "grad").mapInArrow(scan, "sums binary")


def _summed(sums: DataFrame, shape: tuple, tasks: int) -> np.ndarray:
    """The tasks' sums added up: on the driver while they are less than ``GATHER`` bytes in all, else slot by slot in a shuffle."""
    if 8 * tasks * int(np.prod(shape)) <= GATHER:
        out = np.zeros(shape)
        for v in sums.toArrow().column("sums"):
            out += np.frombuffer(v.as_buffer()).reshape(shape)
        return out

    def opened(batches):
        for batch in batches:
            for v in batch.column("sums"):
                rows = np.frombuffer(v.as_buffer()).reshape(shape[0], -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), pa.array(list(rows), pa.list_(pa.float64()))], ["slot", "values"])

    found = sums.mapInArrow(opened, "slot int, values array<double>").groupBy("slot").agg(
        Summarizer.sum(array_to_vector("values")).alias("v")).select("slot", vector_to_array("v").alias("values")).toArrow()
    out = np.zeros(shape)
    for slot, values in zip(found.column("slot").to_pylist(), found.column("values")):
        out[slot] = np.asarray(values.values).reshape(shape[1:])
    return out


def best_split(hist: np.ndarray, spec: Spec) -> tuple | None:
    """(gain, feature, bin, left (rows, sum)) of a node's best split, None where it stays a leaf; hist: features x bins x 2."""
    left = hist.cumsum(axis=1)
    total = left[0, -1]
    left, right = left[:, :-1], total - left[:, :-1]
    nl, nr = left[..., 0], right[..., 0]
    ok = (nl >= max(spec.least, 1)) & (nr >= max(spec.least, 1))
    if not ok.any():
        return None
    mean = total[1] / total[0]
    # the variance gain as the spread of the two means: no difference of large sums
    gap = left[..., 1] / np.maximum(nl, 1) - right[..., 1] / np.maximum(nr, 1)
    gain = np.where(ok, nl * nr / total[0] ** 2 * gap * gap, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[f, b] <= 1e-20 + 1e-24 * mean * mean or gain[f, b] < spec.gain:
        return None
    return float(gain[f, b]), int(f), int(b), left[f, b]


class _Heap:
    """A growing tree: node ``i`` has the children 2i + 1 and 2i + 2."""

    def __init__(self, depth: int):
        m = 2 ** (depth + 1) - 1
        self.feature, self.cut, self.value, self.split = np.zeros(m, np.int64), np.full(m, 255), np.full(m, np.nan), np.zeros(m, bool)

    def filled(self) -> None:
        """Below a leaf every place has its value, so that all rows take the same number of steps."""
        for i in range(1, len(self.value)):
            if not self.split[(i - 1) // 2]:
                self.value[i] = self.value[(i - 1) // 2]


def _round(state: DataFrame, tasks: int, turn: int, d: int, width: int, middle: float, spec: Spec, total: np.ndarray) -> list[_Heap]:
    """The trees of one round; their gains times rows are added to ``total`` (models x features)."""
    heaps = [_Heap(spec.depth) for _ in range(spec.models)]
    shift = 0.0 if turn else middle
    sums = _summed(state.where(F.col("n") == 0).select("sums"), (spec.models, d, width, 2), tasks)
    open_ = [(k, 0, sums[k]) for k in range(spec.models)]
    for k, _, hist in open_:
        rows, s = hist[0].sum(axis=0)
        heaps[k].value[0] = s / max(rows, 1) + shift
    for level in range(spec.depth):
        splits = []
        for k, node, hist in open_:
            found = best_split(hist, spec)
            if found is None:
                continue
            gain, f, b, left = found
            heap, whole = heaps[k], hist[0].sum(axis=0)
            heap.feature[node], heap.cut[node], heap.split[node] = f, b, True
            total[k, f] += gain * whole[0]
            heap.value[2 * node + 1:2 * node + 3] = [s / n + shift for n, s in (left, whole - left)]
            # the sums are wanted of the smaller child; the larger one's are the difference
            splits.append((k, node, hist, 2 * node + 1 + int(2 * left[0] > whole[0])))
        if not splits or level + 1 == spec.depth:
            break
        slot_of = [np.full(len(heaps[0].value), -1) for _ in heaps]
        for slot, (k, _, _, small) in enumerate(splits):
            slot_of[k][small] = slot
        sums = _summed(_level(state, [(h.feature, h.cut) for h in heaps], slot_of, level + 1, d, width, spec),
                       (len(splits), d, width, 2), tasks)
        open_ = [child for (k, node, hist, small), mine in zip(splits, sums)
                 for child in ((k, small, mine), (k, 4 * node + 3 - small, hist - mine))]
    for heap in heaps:
        heap.filled()
    return heaps


def fit(est, rows: DataFrame) -> "BoostedTreesModel":
    spark = rows.sparkSession
    ship_package(spark)
    tree = est.getClassifier() if isinstance(est, OneVsRest) else est
    data = rows.select(vector_to_array(est.getFeaturesCol()).alias("x"), F.col(est.getLabelCol()).cast("double").alias("y"))
    y = F.col("y")
    head = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(y.isNull() | F.isnan(y)).alias("bad"), F.max("y").alias("top"),
                    F.avg("y").alias("mean"), F.max(F.size("x")).alias("d")).first()
    if not head["n"] or head["bad"]:
        raise ValueError("no rows to fit on, or labels that are null or NaN")
    d = head["d"]
    classes = 0 if isinstance(tree, GBTRegressor) else max(2, int(head["top"]) + 1)
    if classes > 2 and not isinstance(est, OneVsRest):
        raise ValueError("boosting takes two classes; more need OneVsRest")
    # one model per class of OneVsRest, also of two; otherwise one
    spec = Spec(classes if isinstance(est, OneVsRest) else 1, classes, tree.getMaxIter(), tree.getMaxDepth(), tree.getStepSize(), tree.getSubsamplingRate(),
                tree.getMinInstancesPerNode(), tree.getMinInfoGain(), tree.getSeed(), tree.getMaxBins())
    middle = 0.0 if classes else head["mean"]
    wide = data.select(*[F.col("x")[i].alias(f"c{i}") for i in range(d)])
    cuts = [trees.thresholds(*s, min(spec.bins, 256) - 1) for s in summaries(wide, [f"c{i}" for i in range(d)])]
    width = max(2, max(len(c) for c in cuts) + 1)
    cores = spark.sparkContext.defaultParallelism
    parts = -(-max(1, -(-head["n"] // trees.TASK)) // cores) * cores
    held, state = _write(_packed(data.repartition(parts), cuts, d, spec), "boost-rows")
    tasks = state.rdd.getNumPartitions()  # later rounds: one file a task, no more tasks than this
    cut_at = np.full((d, 256), np.inf)
    for i, c in enumerate(cuts):
        cut_at[i, :len(c)] = c
    total, found, grown = np.zeros((spec.models, d)), [[] for _ in range(spec.models)], None
    for turn in range(spec.rounds):
        before, state = state, _moved(state, grown, turn, d, width, middle, spec)
        if turn % WRITTEN:
            state.persist(StorageLevel.MEMORY_AND_DISK)
        else:
            path, state = _write(state, "boost-rows")
            drop_scratch(spark, held)
            held = path
        weight = spec.step if turn else 1.0
        heaps = _round(state, tasks, turn, d, width, middle, spec, total)
        before.unpersist()  # the round has read its own rows by now
        grown = [(h.feature, h.cut, weight * h.value) for h in heaps]
        for mine, h in zip(found, heaps):
            at = np.where(h.split, cut_at[h.feature, np.minimum(h.cut, 255)], np.inf)
            mine.append((h.feature.astype(np.int16), at, h.split.astype(np.int32), weight * h.value))
    state.unpersist()
    drop_scratch(spark, held)
    importance = (total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)).mean(axis=0)
    model = BoostedTreesModel(featuresCol=est.getFeaturesCol(), numClasses=classes, importances=[float(v) for v in importance])
    model.trees = [t for mine in found for t in mine]
    return model._set(numModels=spec.models)


class BoostedTreesModel(trees.DeepTreesModel):
    """Fitted trees as heaps (feature, threshold, split or not, value times weight), the trees of one class after those of another.

    Adds ``prediction`` and for classes ``rawPrediction``, for one model of two classes also ``probability``, as Spark's models do.
    """

    numModels = trees.Param(trees.Params._dummy(), "numModels", "margins of a row", trees.TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        spark, models = df.sparkSession, self.getOrDefault(self.numModels)
        ship_package(spark)
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast([(f.astype(np.int64), at, value.ravel()) for f, at, _, value in self.trees])
        sent, of_each = self._sent, len(self.trees) // models

        def predict(batches):
            for x in batches:
                margin = np.zeros((len(x), models))
                for a in range(0, len(x), 4096):
                    codes = np.ascontiguousarray(np.stack(x[a:a + 4096].to_numpy()).T)
                    for i, (feature, at, value) in enumerate(sent.value):
                        depth = len(value).bit_length() - 1
                        margin[a:a + 4096, i // of_each] += value[landed(codes, feature, at, depth)]
                yield pd.Series(list(margin))

        predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        out = df.withColumn("_m", F.pandas_udf(predict, "array<double>")(vector_to_array(self.getOrDefault(self.featuresCol))))
        m = F.col("_m")[0]
        if not self.getOrDefault(self.numClasses):
            return out.withColumn("prediction", m).drop("_m")
        if models == 1:
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * m))
            return out.withColumns({"rawPrediction": array_to_vector(F.array(-m, m)), "probability": array_to_vector(F.array(1.0 - p, p)),
                                    "prediction": (m > 0).cast("double")}).drop("_m")
        return out.withColumns({"rawPrediction": array_to_vector("_m"),
                                "prediction": (F.array_position("_m", F.array_max("_m")) - 1).cast("double")}).drop("_m")

    @classmethod
    def read(cls):
        return trees._Reader(cls)
