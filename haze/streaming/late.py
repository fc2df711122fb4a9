"""Repeated ingest without losing late rows: in-time rows to the sink, late ones to a side sink, merged by a batch job.

A row is late when its time lies more than ``delay`` before the newest time of earlier micro-batches.  In-time rows are
deduplicated against the sink at once; since they are recent, only the sink's recent day folders are read.
Late rows would need all of history for that, so they are only put aside; ``merge_late`` joins them to history
now and then.  Lateness only depends on files of earlier batches, and every batch writes its own folders anew,
so a replayed batch gives the same rows.  Stream and merge together equal a batch job over all rows in arrival order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.operators.dedupe import dedupe_keep_first
from haze.session import path_exists, written
from haze.streaming.ingest import read_landed


def _earlier(spark: SparkSession, path: str, schema, batch_id: int) -> DataFrame | None:
    if not path_exists(spark, path):
        return None
    return spark.read.schema(schema).parquet(path).where(F.col("batch") < batch_id)


def ingest_with_late(spark: SparkSession, source: str, sink: str, checkpoint: str, keys: list[str] | None = None,
                     ts: str = "ts", order_by: str = "reading_id", delay: str = "1 day", available_now: bool = True,
                     processing_time: str = "30 minutes", max_files_per_trigger: int | None = 1):
    """Start the stream; rows are at ``<sink>/rows`` (by day), late ones at ``<sink>/late``.

    A row without a time cannot be placed and is put aside with the late ones.  The first copy of a key to arrive wins, the
    smallest ``order_by`` within a batch.
    """
    keys = keys or ["city", "ts"]
    rows = read_landed(spark, source, max_files_per_trigger=max_files_per_trigger)
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    seen_schema = "seen timestamp, batch long"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = written(batch, "late-batch")
        seen = _earlier(spark, f"{sink}/seen", seen_schema, batch_id)
        newest = seen.agg(F.max("seen").alias("m")).first()["m"] if seen is not None else None
        horizon = F.lit(newest) - F.expr(f"INTERVAL {delay}")
        late = F.col(ts).isNull() if newest is None else F.coalesce(F.col(ts) < horizon, F.lit(True))
        first = dedupe_keep_first(batch.where(~late), keys, order_by)
        known = _earlier(spark, f"{sink}/rows", rows.schema.add("batch", "long").add("day", "date"), batch_id)
        if known is not None and newest is not None:
            since = spark.range(1).select(horizon.alias("h")).first()["h"]
            known = known.where((F.col("day") >= F.lit(since.date())) & (F.col(ts) >= F.lit(since)))
            known = known.select(*[F.col(k).alias(f"_{k}") for k in keys])  # one row a key already
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            first = first.join(known, same, "left_anti")
        first.withColumn("day", F.to_date(ts)).write.mode("overwrite").partitionBy("day").parquet(f"{sink}/rows/batch={batch_id}")
        batch.where(late).write.mode("overwrite").parquet(f"{sink}/late/batch={batch_id}")
        batch.where(~late).agg(F.max(ts).alias("seen")).write.mode("overwrite").parquet(f"{sink}/seen/batch={batch_id}")

    w = rows.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def merge_late(spark: SparkSession, sink: str, schema, keys: list[str] | None = None, order_by: str = "reading_id") -> DataFrame:
    """History and late rows, one row per key, as a batch job over all rows in arrival order gives it; ``was_late`` tells
    where a row came from.  Write the result to a new path."""
    keys = keys or ["city", "ts"]
    names = [f.name for f in schema.fields]
    full = type(schema)(list(schema.fields)).add("batch", "long")
    rows = spark.read.schema(full).parquet(f"{sink}/rows").select(*names, "batch", F.lit(False).alias("was_late"))
    late = spark.read.schema(full).parquet(f"{sink}/late").select(*names, "batch", F.lit(True).alias("was_late"))
    return dedupe_keep_first(rows.unionByName(late), keys, ["was_late", "batch", order_by]).drop("batch")
