"""Pearson correlations of very many columns: co-moment matrices by blocks instead of one expression per pair.

One scan for the means, one for four small matrix products per block of rows: how many rows hold both columns, and the sums of
centred values, squares and products over those rows.  A task sends one matrix per ``TILE`` rows of the result, and Spark adds them up by
tile; nothing of the size d x d meets on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.operators.quantile import number
from haze.session import ship_package

TILE = 64


def wide_corr(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col_a, col_b, corr) of every ordered pair, pairwise complete; null where either side is constant or absent."""
    spark = df.sparkSession
    ship_package(spark)
    d = len(cols)
    if not d:
        return spark.createDataFrame([], "col_a string, col_b string, corr double")
    wide = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(cols)])

    def matrix(batch):
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
        return x, ~np.isnan(x)

    def sums(batches):
        total = np.zeros(2 * d)
        for batch in batches:
            x, has = matrix(batch)
            total += np.concatenate([np.where(has, x, 0.0).sum(axis=0), has.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    found = wide.mapInArrow(sums, "v array<double>").groupBy(F.lit("all").alias("one")).agg(
        Summarizer.sum(array_to_vector("v")).alias("v")).select(vector_to_array("v").alias("v")).first()
    both = np.array(found["v"] if found else [0.0] * (2 * d))  # an empty table may have no task
    mean = both[:d] / np.maximum(both[d:], 1)
    tiles = [(a, min(a + TILE, d)) for a in range(0, d, TILE)]

    def moments(batches):
        total = [np.zeros((4, b - a, d)) for a, b in tiles]
        for batch in batches:
            x, has = matrix(batch)
            x, has = np.where(has, x - mean, 0.0), has.astype(float)
            for t, (a, b) in zip(total, tiles):
                left, there = x[:, a:b], has[:, a:b]
                t += (there.T @ has, left.T @ has, (left * left).T @ has, left.T @ x)
                # the other column's sums over the shared rows are the transposed cells of its own tile
        for i, t in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([t.ravel().tolist()], pa.list_(pa.float64()))], ["tile", "v"])

    parts = wide.mapInArrow(moments, "tile int, v array<double>").groupBy("tile").agg(Summarizer.sum(array_to_vector("v")).alias("v"))

    def cells(batches):
        for batch in batches:
            for tile, v in zip(batch.column("tile").to_pylist(), batch.column("v").to_pylist()):
                a, b = tiles[tile]
                m = np.array(v).reshape(4, (b - a) * d)
                i, j = np.divmod(np.arange((b - a) * d), d)
                yield pa.RecordBatch.from_arrays([pa.array((i + a).astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(x) for x in m]],
                                                 ["i", "j", "n", "s", "q", "p"])

    table = parts.select("tile", vector_to_array("v").alias("v")).mapInArrow(cells, "i int, j int, n double, s double, q double, p double")
    # both orders of a pair: (i, j) holds the sums of i, (j, i) those of j
    pair = table.groupBy(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(
        F.max("n").alias("n"), F.max("p").alias("p"),
        *[F.max(F.when(F.col("i") == F.least("i", "j"), F.col(k))).alias(f"{k}_lo") for k in "sq"],
        *[F.max(F.when(F.col("i") == F.greatest("i", "j"), F.col(k))).alias(f"{k}_hi") for k in "sq"])
    var = lambda k: F.col(f"q_{k}") - F.try_divide(F.col(f"s_{k}") * F.col(f"s_{k}"), F.col("n"))
    co = F.col("p") - F.try_divide(F.col("s_lo") * F.col("s_hi"), F.col("n"))
    # what is left of the squares by rounding alone is no variance
    real = lambda k: F.when(var(k) > 1e-13 * F.col(f"q_{k}"), var(k))
    corr = F.when(F.col("lo") == F.col("hi"), F.lit(1.0)).otherwise(co / F.sqrt(real("lo") * real("hi")))
    found = pair.select("lo", "hi", corr.alias("corr"))
    whole = found.unionByName(found.where("lo <> hi").select(F.col("hi").alias("lo"), F.col("lo").alias("hi"), "corr"))
    names = spark.createDataFrame(list(enumerate(cols)), "k int, name string")  # one row per column
    side = lambda k, name: F.broadcast(names.select(F.col("k").alias(k), F.col("name").alias(name)))
    return whole.join(side("lo", "col_a"), "lo").join(side("hi", "col_b"), "hi").select("col_a", "col_b", "corr")
