"""Connected components by alternating large-star and small-star rounds (joins and minimums only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.session import written


def _summary(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return r["n"], r["h"]


def _starred(edges: DataFrame, larger: bool) -> DataFrame:
    """One round.  Every node's smallest neighbour comes from a pre-aggregated minimum, so a hub is no single task."""
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    moved = pairs.join(low, F.col("u") == F.col("w"))
    if larger:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Null ends and self-loops are ignored; repeated edges count once.  Each round is written to the
    shared scratch folder, which also bounds the plan.
    """
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                  .distinct(), "cc")
    seen = _summary(now)
    while seen[0]:
        now = written(_starred(written(_starred(now, True), "cc"), False), "cc")
        new = _summary(now)
        if new == seen:
            break
        seen = new
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
