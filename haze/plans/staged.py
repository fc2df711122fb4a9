"""Whole grids of tree ensembles scored from a few fits.

A fitted ensemble is read as a node table.  From one deep fit with many trees follow, without another fit:

* every smaller number of trees: the sums over the first trees;
* for forests every smaller depth and every larger least number of rows to split a node (``min_split``): a node at the depth limit,
  or with too few rows, stands in for the leaves below it.  Its split was chosen from the node's own rows, which neither limit changes.

So only what changes the splits themselves (rows per leaf, learning rate, boosting depth, subsampling) needs its own
fit.  Rows are scored by the leaf each tree sends them to (``leafCol``): one look-up per tree in an array of
node values, as many trees at a time as ``BLOCK`` bytes of values hold; a larger ensemble takes several scans, each adding to the
sums that the rows carry.  Confusion counts or squared errors of all grid points come back as one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.session import scratch_dir, ship_package, written

BLOCK = 64 << 20
ROWS = 1024


@dataclass(frozen=True)
class Variant:
    """A forest cut at ``depth`` levels, nodes of fewer than ``min_split`` rows not split; None: as it was fitted."""
    depth: int | None = None
    min_split: int | None = None


@dataclass
class Trees:
    """Nodes of consecutive trees: values per node (nodes x k), and per variant and leaf the node that stands for it."""
    group: int                    # which ensemble (one per class in one-against-the-rest)
    first: int                    # number of the first tree in its ensemble
    values: np.ndarray
    stand: np.ndarray             # variants x leaves
    leaf_start: np.ndarray        # first leaf of each tree


def node_table(model) -> DataFrame:
    """tree, id, left, right, rows, prediction and stats of every node of a fitted Spark ensemble, from its saved form."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()  # fits run in threads
    path = scratch_dir(spark, "ensemble")
    model.write().overwrite().save(path)
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["rawCount"].alias("rows"), n["prediction"].alias("prediction"), n["impurityStats"].alias("stats"))


def stand_ins(left: np.ndarray, right: np.ndarray, rows: np.ndarray, variants: list[Variant]) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of one tree in order, and per variant the node that stands for each; nodes come in pre-order, children behind parents."""
    n = len(left)
    depth, top = np.zeros(n, int), np.tile(np.arange(n), (len(variants), 1))
    ends = np.zeros((len(variants), n), bool)  # the node is a leaf of the variant, or below one
    ends[:, 0] = [v.depth == 0 or (v.min_split is not None and rows[0] < v.min_split) for v in variants]
    for i in range(n):
        for c in (left[i], right[i]):
            if c > 0:
                depth[c] = depth[i] + 1
                for k, v in enumerate(variants):
                    if ends[k, i]:
                        top[k, c], ends[k, c] = top[k, i], True
                    else:
                        ends[k, c] = (v.depth is not None and depth[c] >= v.depth) or (v.min_split is not None and rows[c] < v.min_split)
    leaves = np.flatnonzero(left < 0)
    return leaves, top[:, leaves]


def blocks(model, group: int, value, variants: list[Variant], weights: list[float] | None = None):
    """The ensemble in runs of trees whose values take about ``BLOCK`` bytes.  ``value(prediction, stats)`` gives a node's k numbers."""
    table = written(node_table(model), "nodes")
    sizes = {r["tree"]: r["n"] for r in table.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()}
    trees, at = sorted(sizes), 0
    while at < len(trees):
        end, held = at, 0
        while end < len(trees) and (end == at or held + 64 * sizes[trees[end]] <= BLOCK):
            held += 64 * sizes[trees[end]]
            end += 1
        part = table.where(F.col("tree").between(trees[at], trees[end - 1])).orderBy("tree", "id").toPandas()
        values, stand, starts, nodes, leaves = [], [], [], 0, 0
        for t, frame in part.groupby("tree", sort=True):
            leaf, top = stand_ins(*(frame[c].to_numpy() for c in ("left", "right", "rows")), variants)
            v = np.array([value(p, s) for p, s in zip(frame["prediction"], frame["stats"])], float)
            values.append(v * (weights[t] if weights else 1.0))
            stand.append(top + nodes)
            starts.append(leaves)
            nodes, leaves = nodes + len(frame), leaves + len(leaf)
        yield Trees(group, trees[at], np.concatenate(values), np.concatenate(stand, axis=1), np.array(starts))
        at = end


def _votes(prediction, stats):
    s = np.asarray(stats, float)
    return s / max(s.sum(), 1e-300)


def scores(rows: DataFrame, models: list, sizes: list[int], variants: list[Variant], n_classes: int, boosted: bool) -> dict:
    """Confusion matrix (classes) or (rows, squared error) of every (size, variant) on ``rows`` (features, label).

    ``models``: one fitted ensemble, or for boosted classes one per class (one in all for two classes).
    """
    spark = rows.sparkSession
    ship_package(spark)
    k = max(1, n_classes)
    part = rows
    for g, m in enumerate(models):
        part = m.copy().setLeafCol(f"leaf{g}").transform(part).select(*part.columns, vector_to_array(f"leaf{g}").cast("array<int>").alias(f"leaf{g}"))
    cells = len(variants) * len(sizes) * k
    state = written(part.select("label", *[f"leaf{g}" for g in range(len(models))], F.array_repeat(F.lit(0.0), cells).alias("acc")), "staged")
    for g, m in enumerate(models):
        def margin(prediction, stats, g=g):
            return [-prediction, prediction] if k == 2 else [prediction if c == g else 0.0 for c in range(k)]

        if n_classes and not boosted:
            value, weights = _votes, None
        else:
            value, weights = (margin if n_classes else lambda p, s: [p]), (list(m.treeWeights) if boosted else None)
        for trees in blocks(m, g, value, variants, weights):
            state = written(state.mapInArrow(_adder(spark.sparkContext.broadcast(trees), sizes, k), state.schema), "staged")

    def judge(batches):
        total = np.zeros((len(variants), len(sizes), k * k if n_classes else 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            acc = batch.column("acc").flatten().to_numpy().reshape(batch.num_rows, len(variants), len(sizes), k)
            y = batch.column("label").to_numpy()
            if n_classes:
                code = y.astype(int)[:, None, None] * k + acc.argmax(axis=3)
                for v in range(len(variants)):
                    for s in range(len(sizes)):
                        total[v, s] += np.bincount(code[:, v, s], minlength=k * k)
            else:
                mean = acc[..., 0] if boosted else acc[..., 0] / np.array(sizes)
                total[..., 0] += len(y)
                total[..., 1] += ((mean - y[:, None, None]) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["v"])

    found = state.select("label", "acc").mapInArrow(judge, "v array<double>").agg(
        Summarizer.sum(array_to_vector("v")).alias("v")).select(vector_to_array("v").alias("v")).first()["v"]
    table = np.array(found).reshape(len(variants), len(sizes), -1)
    return {(n, v): table[i, j].reshape(k, k) if n_classes else table[i, j] for i, v in enumerate(variants) for j, n in enumerate(sizes)}


def _adder(shared, sizes: list[int], k: int):
    def add(batches):
        t: Trees = shared.value
        n_trees = len(t.leaf_start)
        number = t.first + np.arange(n_trees)
        for batch in batches:
            if not batch.num_rows:
                yield batch
                continue
            leaf = batch.column(f"leaf{t.group}").flatten().to_numpy().reshape(batch.num_rows, -1)[:, number] + t.leaf_start
            acc = batch.column("acc").flatten().to_numpy().reshape(batch.num_rows, len(t.stand), len(sizes), k).copy()
            for a in range(0, len(leaf), ROWS):
                for v, stand in enumerate(t.stand):
                    got = t.values[stand[leaf[a:a + ROWS]]]
                    for s, size in enumerate(sizes):
                        acc[a:a + ROWS, v, s] += got[:, number < size].sum(axis=1)
            flat = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * acc[0].size, pa.array(acc.reshape(-1)))
            yield pa.RecordBatch.from_arrays([flat if c == "acc" else batch.column(c) for c in batch.schema.names], batch.schema.names)
    return add
