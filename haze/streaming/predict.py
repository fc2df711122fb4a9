"""A fitted chain applied to a stream of landed files."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from haze.plans import training


def predict_stream(spark: SparkSession, model: PipelineModel, features: list[str], labels: list[str] | None, keep: list[str],
                   source: str, schema: T.StructType, sink: str, checkpoint: str, available_now: bool = True,
                   processing_time: str = "30 minutes", max_files_per_trigger: int | None = None):
    """Predictions of Parquet files as they land; each batch has its own folder under ``sink``, rewritten when it is replayed."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        found = training.predict(model, batch, features, labels, keep=keep)
        found.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    w = reader.parquet(source).writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
