"""File sources and sinks: CSV readings, nested JSON payloads, result and metadata sinks."""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haze.operators.quality import DataQualityError
from haze.session import written

# Timestamps keep microseconds through a CSV round trip.
TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# Raw reading layout (column order matters to the outlier cascade).  The raw
# files call the PM2.5 column "pm2.5"; a dot cannot be resolved unquoted in
# Spark, so the schema renames it positionally to pm25.
# fixed values: the data contract of a raw reading, in column order
READING = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("pm25", T.DoubleType()),
    T.StructField("aqi", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("pressure", T.DoubleType()),
    T.StructField("wind_speed", T.DoubleType()),
])
RAW_NAMES = {"pm25": "pm2.5", "ts": "timestamp"}

AIR_JSON = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("list", T.ArrayType(T.StructType([
        T.StructField("dt", T.LongType()),
        T.StructField("main", T.StructType([T.StructField("aqi", T.IntegerType())])),
        T.StructField("components", T.StructType([T.StructField("pm2_5", T.DoubleType())])),
    ]))),
])

WEATHER_JSON = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("dt", T.LongType()),
    T.StructField("main", T.StructType([
        T.StructField("temp", T.DoubleType()),
        T.StructField("humidity", T.DoubleType()),
        T.StructField("pressure", T.DoubleType()),
    ])),
    T.StructField("wind", T.StructType([T.StructField("speed", T.DoubleType())])),
])


def _by_header(spark: SparkSession, path: str, schema: T.StructType) -> tuple[T.StructType, list[str]]:
    """The schema in the order of the file's own header, and the missing column names.

    Header names may be the raw ones (``RAW_NAMES``); columns outside ``schema`` are read as text.
    """
    back = {v: k for k, v in RAW_NAMES.items()}
    names = [back.get(c, c) for c in spark.read.option("header", True).csv(path).columns]
    fields = {f.name: f for f in schema.fields}
    kinds = [fields.get(n) or T.StructField(n, T.StringType()) for n in names]
    return T.StructType(kinds), [f.name for f in schema.fields if f.name not in names]


def _named(spark: SparkSession, path: str, schema: T.StructType, header: bool) -> T.StructType:
    if not header:
        return schema
    found, missing = _by_header(spark, path, schema)
    if missing:
        raise DataQualityError(f"Missing required columns: {missing}")
    return found


def read_csv(spark: SparkSession, path: str, schema: T.StructType = READING, header: bool = True,
             mode: str = "FAILFAST") -> DataFrame:
    """CSV with an explicit schema (no inference pass), columns taken by header name.

    Without a header they are taken by position.  Every column of ``schema`` has to be there; others
    are dropped.  All files of a folder share one column order: it is taken from one of them.
    """
    found = _named(spark, path, schema, header)
    df = (spark.read.schema(found).option("header", header).option("mode", mode)
          .option("timestampFormat", TS_FORMAT).csv(path))
    return df.select(*[F.col(f"`{f.name}`") for f in schema.fields])


def read_csv_permissive(spark: SparkSession, path: str, schema: T.StructType = READING,
                        header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected raw lines): malformed lines go to a reject frame instead of failing the job.

    Both frames read one parse, written to the shared scratch folder: the corrupt-record column is only
    reliable on fully parsed rows, and a lost executor must not change it.
    """
    found = _named(spark, path, schema, header)
    s = T.StructType(found.fields + [T.StructField("_corrupt_record", T.StringType())])
    df = (spark.read.schema(s).option("header", header).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").option("timestampFormat", TS_FORMAT).csv(path))
    df = written(df, "csv-parse")
    bad = df.where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")
    good = df.where(F.col("_corrupt_record").isNull()).select(*[F.col(f"`{f.name}`") for f in schema.fields])
    return good, bad


def write_csv(df: DataFrame, path: str, raw_names: bool = False, mode: str = "overwrite") -> str:
    """CSV with header, no index; ``raw_names`` restores the raw column names (pm2.5, timestamp)."""
    out = df
    if raw_names:
        out = df.select(*[F.col(c).alias(RAW_NAMES.get(c, c)) for c in df.columns])
    out.write.mode(mode).option("header", True).option("timestampFormat", TS_FORMAT).csv(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def flatten_air(payloads: DataFrame) -> DataFrame:
    """One row per ``list`` entry: city, epoch dt, timestamp, aqi, pm25.  A payload
    without ``list`` (or with an empty one) yields no row."""
    e = payloads.select("city", F.explode("list").alias("e"))
    return e.select(
        "city", F.col("e.dt").alias("dt"), F.timestamp_seconds(F.col("e.dt")).alias("ts"),
        F.col("e.main.aqi").alias("aqi"), F.col("e.components.pm2_5").alias("pm25"))


def kelvin_to_celsius(x):
    return x - F.lit(273.15)


def flatten_weather(payloads: DataFrame) -> DataFrame:
    return payloads.select(
        "city", F.col("dt"), F.timestamp_seconds(F.col("dt")).alias("weather_ts"),
        kelvin_to_celsius(F.col("main.temp")).alias("temperature"),
        F.col("main.humidity").alias("humidity"), F.col("main.pressure").alias("pressure"),
        F.col("wind.speed").alias("wind_speed"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


def run_metadata(spark: SparkSession, best_model: str, features: list[str], config: dict,
                 extra: dict | None = None) -> DataFrame:
    """One-row run record (time, best model, chosen features, config as JSON)."""
    row = {
        "run_time": _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None).isoformat(timespec="seconds"),
        "best_model": best_model,
        "features": list(features),
        "config_json": json.dumps(config, sort_keys=True, default=str),
        "extra_json": json.dumps(extra or {}, sort_keys=True, default=str),
    }
    return spark.createDataFrame([row], "run_time string, best_model string, features array<string>, "
                                        "config_json string, extra_json string")


def write_metadata(df: DataFrame, path: str) -> str:
    """A small record sink (one JSON file)."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path
