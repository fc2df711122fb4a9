"""Structured Streaming ingest of landed reading files.

* ``dedup_stream``: file source with an explicit schema → event-time
  watermark → ``dropDuplicatesWithinWatermark`` against redeliveries → first
  copy of each (city, ts) → parquet sink, checkpointed.  State is bounded by
  the watermark.  Rows later than the watermark are dropped by the stream —
  the batch ``append_dedupe`` job merges those into history.
* ``split_rejects``: a malformed record in a micro-batch does not fail the
  batch: records that do not parse go to a reject sink, the rest go on.
  ``foreachBatch`` writes each batch to a batch-numbered folder with
  overwrite, so a replayed batch after a failure rewrites the same output.

Run with ``trigger(availableNow=True)`` for catch-up / tests, or a
processing-time trigger (e.g. every 30 minutes) for continuous ingest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haze.operators.dedupe import dedupe_keep_first
from haze.session import path_exists, written

# Landed JSON keeps microseconds (Spark's default JSON timestamp format stops at milliseconds).
JSON_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

READING_JSON = T.StructType([
    T.StructField("reading_id", T.LongType()),
    T.StructField("city", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("pm25", T.DoubleType()),
    T.StructField("aqi", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("pressure", T.DoubleType()),
    T.StructField("wind_speed", T.DoubleType()),
])


def read_landed(spark: SparkSession, path: str, schema: T.StructType = READING_JSON,
                max_files_per_trigger: int | None = None, corrupt_col: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(
        T.StructType(schema.fields + [T.StructField(corrupt_col, T.StringType())]) if corrupt_col else schema)
    if corrupt_col:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt_col)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.option("timestampFormat", JSON_TS_FORMAT).json(path)


def dedup_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, keys: list[str] | None = None,
                 ts: str = "ts", order_by: str = "reading_id", watermark: str = "1 day", available_now: bool = True,
                 processing_time: str = "30 minutes", max_files_per_trigger: int | None = 1):
    """Start the dedupe stream; returns the StreamingQuery (await it or let it run).

    Redelivered rows are dropped by the stream's state.  Copies of a key inside one micro-batch are reduced
    to the one with the smallest ``order_by``; a key that an earlier micro-batch has written (looked up in
    the sink, in the batch's own time range) is dropped, so the first copy to arrive wins whatever the
    read order.  Rows are at ``<sink>/rows``, one folder a batch, rewritten when a batch is replayed.
    """
    keys = keys or ["city", "ts"]
    rows = read_landed(spark, source, max_files_per_trigger=max_files_per_trigger)
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    fresh = rows.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([*keys, order_by])

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        first = dedupe_keep_first(batch, keys, order_by)
        first = written(first, "stream-batch")
        rows_at = f"{sink}/rows"
        if batch_id and path_exists(spark, rows_at):
            # keys that earlier batches wrote, in this batch's time range; a replayed batch ignores its own folder
            span = first.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
            known = spark.read.schema(first.select(*keys).schema.add("batch", "long")).parquet(rows_at).where(
                (F.col("batch") < batch_id) & F.col(ts).between(F.lit(span["lo"]), F.lit(span["hi"]))).drop("batch").distinct()
            known = known.select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            first = first.join(known, same, "left_anti")
        first.write.mode("overwrite").parquet(f"{rows_at}/batch={batch_id}")

    w = fresh.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def split_rejects(spark: SparkSession, source: str, good_sink: str, reject_sink: str, checkpoint: str,
                  available_now: bool = True, processing_time: str = "30 minutes"):
    """Parse landed JSON; unparsable records go to ``reject_sink``, the rest to ``good_sink``."""
    corrupt = "_corrupt_record"
    rows = read_landed(spark, source, corrupt_col=corrupt)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = written(batch, "stream-parse")  # a corrupt-record column may only be queried on a finished parse
        batch.where(F.col(corrupt).isNotNull()).select(F.lit(batch_id).alias("batch_id"), F.col(corrupt).alias("record")) \
            .write.mode("overwrite").parquet(f"{reject_sink}/batch={batch_id}")
        batch.where(F.col(corrupt).isNull()).drop(corrupt) \
            .write.mode("overwrite").parquet(f"{good_sink}/batch={batch_id}")

    w = rows.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
