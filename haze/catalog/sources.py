"""Sources, sinks and joins: CSV round trip, nested JSON flatten, append-dedupe, lookups, as-of."""

from __future__ import annotations

from pyspark.sql import functions as F

from haze.catalog import register
from haze.catalog._util import Views, rounded, view_sql
from haze.operators import dedupe, joins
from haze.session import scratch_dir
from haze.sources import files

READING_COLS = ["reading_id", "city", "ts", "pm25", "aqi", "temperature", "humidity", "pressure", "wind_speed"]


@register("scan_csv", view_sql("readings") + "SELECT * FROM readings")
def scan_csv(spark, sf_dir):
    """Readings landed as CSV (header, raw column names) and scanned back with an explicit schema."""
    v = Views(spark, sf_dir)
    path = scratch_dir(spark, "readings-csv")
    files.write_csv(v["readings"].select(*READING_COLS), path, raw_names=True)
    schema = files.T.StructType([files.T.StructField("reading_id", files.T.LongType())] + list(files.READING.fields))
    return files.read_csv(spark, path, schema).select(*READING_COLS)


@register("flatten_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def flatten_json(spark, sf_dir):
    ev = Views(spark, sf_dir)["events"]
    return ev.select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


def _air_payloads(readings):
    """Group readings into API-like payloads of at most 16 list entries per city."""
    entry = F.struct(F.unix_seconds(F.col("ts")).alias("dt"),
                     F.struct(F.floor("aqi").cast("int").alias("aqi")).alias("main"),
                     F.struct(F.col("pm25").alias("pm2_5")).alias("components"))
    return (readings.groupBy("city", F.floor(F.col("reading_id") / 16).alias("page"))
            .agg(F.collect_list(entry).alias("list")).select("city", "list"))


@register("flatten_air", view_sql("readings") + """
SELECT city, CAST(floor(epoch(ts)) AS BIGINT) AS dt,
       make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS ts,
       CAST(floor(aqi) AS INTEGER) AS aqi, pm25
FROM readings""")
def flatten_air(spark, sf_dir):
    """Nested air payloads landed as JSON, read with an explicit schema, exploded and flattened."""
    v = Views(spark, sf_dir)
    path = scratch_dir(spark, "air-json")
    files.write_json(_air_payloads(v["readings"]), path)
    return files.flatten_air(files.read_json(spark, path, files.AIR_JSON))


@register("epoch_ts", """
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS dt, make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS ts_seconds
FROM events""")
def epoch_ts(spark, sf_dir):
    ev = Views(spark, sf_dir)["events"]
    dt = F.unix_seconds(F.col("ts").cast("timestamp"))
    return ev.select("event_id", dt.alias("dt"), F.timestamp_seconds(dt).alias("ts_seconds"))


def _weather_payloads(events):
    """One weather payload per event (Kelvin temperature, nested main/wind), derived from the events."""
    return events.select(
        F.col("event_type").alias("city"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("dt"),
        F.struct((F.lit(288.15) + (F.col("user_id") % 20)).alias("temp"),
                 (F.lit(40.0) + (F.col("event_id") % 50)).alias("humidity"),
                 (F.lit(1000.0) + (F.col("user_id") % 30)).alias("pressure")).alias("main"),
        F.struct(((F.col("event_id") % 120) / 10.0).alias("speed")).alias("wind"))


WEATHER_SQL = """weather AS (
  SELECT event_type AS city, CAST(floor(epoch(ts)) AS BIGINT) AS dt,
         make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS weather_ts,
         (288.15e0 + user_id % 20) - 273.15e0 AS temperature, CAST(40 + event_id % 50 AS DOUBLE) AS humidity,
         CAST(1000 + user_id % 30 AS DOUBLE) AS pressure, (event_id % 120) / 10.0e0 AS wind_speed
  FROM events)"""


@register("kelvin_celsius", "WITH " + WEATHER_SQL + """
SELECT city, dt, weather_ts, round(temperature, 6) AS temperature, humidity, pressure, wind_speed FROM weather""")
def kelvin_celsius(spark, sf_dir):
    ev = Views(spark, sf_dir)["events"]
    return rounded(files.flatten_weather(_weather_payloads(ev)))


@register("air_weather_join", view_sql("readings") + ", " + WEATHER_SQL + """,
latest AS (SELECT city, arg_max(temperature, dt) AS w_temperature, arg_max(humidity, dt) AS w_humidity,
                  max(dt) AS w_dt FROM weather GROUP BY city)
SELECT r.reading_id, r.city, r.pm25, round(l.w_temperature, 6) AS w_temperature, l.w_humidity, l.w_dt
FROM readings r JOIN latest l ON r.city = l.city""")
def air_weather_join(spark, sf_dir):
    """Each reading joined with its city's latest weather snapshot (inner: no weather, no row)."""
    v = Views(spark, sf_dir)
    w = files.flatten_weather(_weather_payloads(v["events"]))
    latest = w.groupBy("city").agg(
        F.max_by(F.struct("temperature", "humidity", "dt"), "dt").alias("w")).select(
        "city", F.col("w.temperature").alias("w_temperature"), F.col("w.humidity").alias("w_humidity"),
        F.col("w.dt").alias("w_dt"))
    out = joins.dim_join(v["readings"].select("reading_id", "city", "pm25"), latest, on="city")
    return rounded(out)


@register("asof_weather", view_sql("readings") + ", " + WEATHER_SQL + """,
shifted AS (SELECT reading_id, city, ts + INTERVAL 7 MINUTE AS ts FROM readings),
one AS (SELECT * FROM weather QUALIFY row_number() OVER (
  PARTITION BY city, weather_ts ORDER BY temperature DESC, humidity DESC) = 1)
SELECT s.reading_id, s.city, s.ts, w.weather_ts, round(w.temperature, 6) AS temperature, w.humidity
FROM shifted s ASOF LEFT JOIN one w ON s.city = w.city AND s.ts >= w.weather_ts""")
def asof_weather(spark, sf_dir):
    """Readings (7 minutes later than the events) matched to the latest weather snapshot at or before them
    (of snapshots of one second the one with the largest values)."""
    v = Views(spark, sf_dir)
    w = files.flatten_weather(_weather_payloads(v["events"])).select("city", "weather_ts", "temperature", "humidity")
    left = v["readings"].select("reading_id", "city", (F.col("ts") + F.expr("INTERVAL 7 MINUTES")).alias("ts"))
    return rounded(joins.asof_join(left, w, ["city"], "ts", "weather_ts"))


@register("dim_lookup", """
SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")
def dim_lookup(spark, sf_dir):
    v = Views(spark, sf_dir)
    region = v["region"].withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.dim_join(v["nation"], region, on="n_regionkey").select("n_nationkey", "n_name", "r_name")


@register("union_all", view_sql("readings", "readings_gaps") + """
SELECT reading_id, city, pm25, humidity, 'raw' AS source FROM readings
UNION ALL SELECT reading_id, city, pm25, humidity, 'gaps' AS source FROM readings_gaps""")
def union_all(spark, sf_dir):
    v = Views(spark, sf_dir)
    a = v["readings"].select("reading_id", "city", "pm25", "humidity", F.lit("raw").alias("source"))
    b = v["readings_gaps"].select("reading_id", "humidity", "pm25", "city", F.lit("gaps").alias("source"))
    return dedupe.union_by_name(a, b)


@register("dedupe_first", view_sql("readings_dups") + """
SELECT reading_id, city, ts, pm25 FROM (
  SELECT *, row_number() OVER (PARTITION BY city, ts ORDER BY reading_id) AS rn FROM readings_dups) WHERE rn = 1""")
def dedupe_first(spark, sf_dir):
    v = Views(spark, sf_dir)
    return dedupe.dedupe_keep_first(v["readings_dups"].select("reading_id", "city", "ts", "pm25"),
                                    ["city", "ts"], "reading_id")


@register("append_dedup", view_sql("readings", "readings_dups") + """,
hist AS (SELECT reading_id, city, ts, pm25, 0 AS side FROM readings WHERE ts < TIMESTAMP '2024-01-16 00:00:00'),
new AS (SELECT reading_id, city, ts, pm25, 1 AS side FROM readings_dups WHERE ts >= TIMESTAMP '2024-01-10 00:00:00')
SELECT reading_id, city, ts, pm25 FROM (
  SELECT *, row_number() OVER (PARTITION BY city, ts ORDER BY side, reading_id) AS rn
  FROM (SELECT * FROM hist UNION ALL SELECT * FROM new)) WHERE rn = 1""")
def append_dedup(spark, sf_dir):
    """History file + a new overlapping batch, one row per (city, ts), history first."""
    v = Views(spark, sf_dir)
    cols = ["reading_id", "city", "ts", "pm25"]
    hist = v["readings"].where(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp")).select(*cols)
    new = v["readings_dups"].where(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp")).select(*cols)
    return dedupe.append_dedupe(hist, new, ["city", "ts"], "reading_id")


@register("reject_rows", view_sql("readings") + """
SELECT count_if(humidity <= 85) AS n_good, count_if(humidity > 85) AS n_rejected FROM readings""")
def reject_rows(spark, sf_dir):
    """Readings landed as CSV where the PM2.5 field of humid readings arrived as text: a permissive
    scan parses the rest and sends those lines to a reject frame; counts of both."""
    v = Views(spark, sf_dir)
    path = scratch_dir(spark, "readings-csv-rejects")
    r = v["readings"]
    pm = F.when(F.col("humidity") > 85, F.lit("n/a")).otherwise(F.col("pm25").cast("string"))
    line = F.concat_ws(",", F.col("reading_id").cast("string"), "city",
                       F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), pm,
                       *[F.col(c).cast("string") for c in ["aqi", "temperature", "humidity", "pressure", "wind_speed"]])
    r.select(line.alias("value")).write.mode("overwrite").text(path)
    schema = files.T.StructType([files.T.StructField("reading_id", files.T.LongType())] + list(files.READING.fields))
    good, bad = files.read_csv_permissive(spark, path, schema, header=False)
    return spark.createDataFrame([(good.count(), bad.count())], "n_good long, n_rejected long")
