"""Joins: dimension lookup, as-of join without all-pairs, row-set complement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haze.session import written


def dim_join(fact: DataFrame, dim: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a dimension.  Whether it is broadcast is left to the optimiser, which knows its bytes at run time."""
    return fact.join(dim, on=on, how=how)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str) -> DataFrame:
    """For each left row, the right row of the same ``by`` key with the latest ``right_ts <= left_ts``
    (right columns null when there is none; null keys and null times match nothing; of right rows
    with equal times the one with the largest values, column by column, is taken).

    No pair expansion, and no key or time bucket in one task: both sides are range-partitioned together
    in (key, time) order, so a hot key spans as many partitions as it needs, and written once; the
    last right row of each (partition, key) carries over to the later partitions through a window over
    that small table; inside a partition a running ``last`` picks the row.
    """
    rcols, lcols = [c for c in right.columns if c not in by], list(left.columns)
    keys = [f"_k{i}" for i in range(len(by))]
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)]
    r = right.select(*named, F.col(right_ts).cast("timestamp").alias("_t"), F.struct(*[F.col(f"`{c}`") for c in rcols]).alias("_r"))
    for k in [*keys, "_t"]:
        r = r.where(F.col(k).isNotNull())
    l = left.select(*named, F.col(left_ts).cast("timestamp").alias("_t"), F.struct(*[F.col(f"`{c}`") for c in lcols]).alias("_l"))
    r = r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType)).withColumn("_side", F.lit(0))
    l = l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).withColumn("_side", F.lit(1))
    order = ["_t", "_side", "_r"]
    both = written(r.unionByName(l).repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), "asof")
    last = both.where("_side = 0").groupBy(*keys, "_p").agg(F.max(F.struct("_t", "_r")).alias("_m"))
    parts = both.select(*keys, "_p").distinct().join(last, [*keys, "_p"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*[F.col(k).alias(f"{k}c") for k in keys], F.col("_p").alias("_pc"),
                         F.last("_m", ignorenulls=True).over(earlier)["_r"].alias("_carry"))
    so_far = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_in", F.last("_r", ignorenulls=True).over(so_far)).where("_side = 1")
    same = F.col("_p") == F.col("_pc")
    for k in keys:
        same = same & (F.col(k) == F.col(f"{k}c"))
    out = found.join(carry, same, "left").withColumn("_m", F.when(F.col("_t").isNotNull(), F.coalesce("_in", "_carry")))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    out = out.withColumn("_m", F.when(known, F.col("_m")))
    return out.select(*[F.col(f"_l.`{c}`").alias(c) for c in lcols], *[F.col(f"_m.`{c}`").alias(c) for c in rcols])


def complement(all_rows: DataFrame, subset: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``all_rows`` whose key is not in ``subset`` (anti join)."""
    return all_rows.join(subset.select(*keys), on=keys, how="left_anti")
