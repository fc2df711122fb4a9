"""Projection, filter and quality-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from haze.catalog import register
from haze.catalog._util import Views, rounded, view_sql
from haze.functions import features
from haze.operators import quality, stats


REQUIRED = ["city", "ts", "temperature", "humidity", "pm10", "station"]


@register("required_columns", view_sql("readings") + """
SELECT c.column, CAST(0 AS BIGINT) + (SELECT count(*) FROM readings) AS n_rows
FROM (SELECT unnest(['pm10', 'station']) AS column) c""")
def required_columns(spark, sf_dir):
    """The required columns that the readings lack (the check names every one), beside their row count."""
    df = Views(spark, sf_dir)["readings"]
    missing = quality.missing_columns(df, REQUIRED)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(F.lit(missing)).alias("column"), "n_rows")


@register("nonempty", view_sql("readings") + """
SELECT city, count(*) > 0 AS nonempty, count_if(pm25 > 480) > 0 AS any_extreme FROM readings GROUP BY city""")
def nonempty(spark, sf_dir):
    """The emptiness check on each city's readings and on its extreme ones."""
    df = Views(spark, sf_dir)["readings"]
    cities = [r["city"] for r in df.select("city").distinct().collect()]
    rows = [(c, quality.is_nonempty(df.where(F.col("city") == c)),
             quality.is_nonempty(df.where((F.col("city") == c) & (F.col("pm25") > 480)))) for c in cities]
    return spark.createDataFrame(rows, "city string, nonempty boolean, any_extreme boolean")


@register("select_dtypes", view_sql("readings") + """
SELECT reading_id, pm25, aqi, temperature, humidity, pressure, wind_speed FROM readings""")
def select_dtypes(spark, sf_dir):
    """Numeric columns by type, in schema order."""
    df = Views(spark, sf_dir)["readings"]
    return quality.select_columns(df, quality.numeric_columns(df))


@register("feature_width", view_sql("readings", "readings_gaps") + """
SELECT CAST(9 AS INTEGER) AS n_train, CAST(8 AS INTEGER) AS n_test, false AS same,
       (SELECT count(*) FROM readings) AS n_rows""")
def feature_width(spark, sf_dir):
    """The width check of a train and a test table, one of which has lost a column."""
    v = Views(spark, sf_dir)
    train, test = v["readings"], quality.drop_columns(v["readings_gaps"], ["aqi"])
    try:
        quality.check_feature_width(train.columns, test.columns)
        same = True
    except quality.DataQualityError:
        same = False
    return train.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(len(train.columns)).alias("n_train"), F.lit(len(test.columns)).alias("n_test"), F.lit(same).alias("same"), "n_rows")


@register("class_check", view_sql("readings") + """,
q AS (SELECT quantile_cont(pm25, 0.33) AS a, quantile_cont(pm25, 0.66) AS b FROM readings),
l AS (SELECT CASE WHEN pm25 <= a THEN 'Low' WHEN pm25 <= b THEN 'Medium' ELSE 'High' END AS label FROM readings, q)
SELECT label, count(*) AS n, CAST(1 AS BIGINT) AS n_before, (SELECT count(DISTINCT label) FROM l) AS n_after FROM l GROUP BY label""")
def class_check(spark, sf_dir):
    """A target with one class is relabelled by terciles: class counts before and after."""
    df = Views(spark, sf_dir)["readings"].withColumn("label", F.lit("only"))
    before = quality.distinct_count(df, "label")
    if before < 2:
        df = features.add_tercile_label(df, "pm25", "label")
    after = quality.require_several_classes(df, "label")
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"n_before": F.lit(before).cast("long"), "n_after": F.lit(after).cast("long")})


@register("features_if_present", view_sql("readings") + """
SELECT reading_id, temperature, humidity, round(temperature / (humidity + 1e-8), 6) AS temp_humidity_ratio FROM readings""")
def features_if_present(spark, sf_dir):
    """Engineered features of a table without time, PM2.5 and pressure: only the ratio can be made."""
    df = Views(spark, sf_dir)["readings"].select("reading_id", "temperature", "humidity")
    return rounded(features.engineer_features(df, "classification"))


@register("drop_cols", view_sql("readings") + """
SELECT reading_id, city, ts, pm25, temperature, humidity, pressure, wind_speed FROM readings""")
def drop_cols(spark, sf_dir):
    """Drop listed columns that exist; the absent name is ignored."""
    return quality.drop_columns(Views(spark, sf_dir)["readings"], ["aqi", "no_such_column"])


@register("select_features", view_sql("readings") + "SELECT reading_id, temperature, humidity, wind_speed FROM readings")
def select_features(spark, sf_dir):
    return quality.select_columns(Views(spark, sf_dir)["readings"], ["reading_id", "temperature", "humidity", "wind_speed"])


@register("dropna_any", view_sql("readings_gaps") + """
SELECT * FROM readings_gaps WHERE reading_id IS NOT NULL AND city IS NOT NULL AND ts IS NOT NULL AND pm25 IS NOT NULL
  AND aqi IS NOT NULL AND temperature IS NOT NULL AND humidity IS NOT NULL AND pressure IS NOT NULL
  AND wind_speed IS NOT NULL""")
def dropna_any(spark, sf_dir):
    return quality.drop_null_rows(Views(spark, sf_dir)["readings_gaps"])


@register("dropna_target", view_sql("readings_gaps") + """
SELECT reading_id, city, pm25, humidity FROM readings_gaps WHERE pm25 IS NOT NULL""")
def dropna_target(spark, sf_dir):
    df = Views(spark, sf_dir)["readings_gaps"].select("reading_id", "city", "pm25", "humidity")
    return quality.drop_null_rows(df, ["pm25"])


@register("range_filter", view_sql("readings") + """
SELECT reading_id, pm25 FROM readings WHERE pm25 BETWEEN 10 AND 100""")
def range_filter(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"]
    return df.where(quality.in_range("pm25", 10.0, 100.0)).select("reading_id", "pm25")


@register("align_columns", view_sql("readings") + """
SELECT reading_id, temperature, 0.0e0 AS city_unknown, pm25, humidity FROM readings""")
def align_columns(spark, sf_dir):
    """Columns reindexed to a fitted list: missing ones are 0, extra ones dropped."""
    df = Views(spark, sf_dir)["readings"]
    return quality.align_columns(df, ["reading_id", "temperature", "city_unknown", "pm25", "humidity"])


@register("unseen_labels", """
SELECT DISTINCT l_returnflag AS label FROM lineitem
WHERE l_returnflag IS NOT NULL AND l_returnflag NOT IN (SELECT o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL)""")
def unseen_labels(spark, sf_dir):
    """Labels of a 'test' table (return flags) never seen in a 'train' table (order states)."""
    v = Views(spark, sf_dir)
    train = v["orders"].select(F.col("o_orderstatus").alias("label"))
    test = v["lineitem"].select(F.col("l_returnflag").alias("label"))
    return quality.unseen_labels(train, test, "label")


@register("min_group_size", view_sql("readings") + """
SELECT reading_id, city FROM readings WHERE city IN (SELECT city FROM readings GROUP BY city HAVING count(*) >= 2000)""")
def min_group_size(spark, sf_dir):
    kept, _skipped = quality.min_group_size(Views(spark, sf_dir)["readings"].select("reading_id", "city"), "city", 2000)
    return kept


@register("skipped_groups", view_sql("readings") + """
SELECT city, count(*) AS n_rows FROM readings GROUP BY city HAVING count(*) < 2000""")
def skipped_groups(spark, sf_dir):
    _kept, skipped = quality.min_group_size(Views(spark, sf_dir)["readings"].select("reading_id", "city"), "city", 2000)
    return skipped


@register("head_n", view_sql("readings") + "SELECT * FROM readings ORDER BY reading_id LIMIT 10")
def head_n(spark, sf_dir):
    """Preview: the first 10 readings in id order (a top-k, the limit is the feature)."""
    return quality.head(Views(spark, sf_dir)["readings"], 10, ["reading_id"])


@register("shape", view_sql("readings") + "SELECT count(*) AS n_rows, 9 AS n_cols FROM readings")
def shape(spark, sf_dir):
    return stats.shape(Views(spark, sf_dir)["readings"])


@register("distinct_values", view_sql("readings_gaps") + "SELECT DISTINCT city FROM readings_gaps WHERE city IS NOT NULL")
def distinct_values(spark, sf_dir):
    return stats.distinct_values(Views(spark, sf_dir)["readings_gaps"], "city")


@register("parse_ts", """
SELECT event_id, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS ts_parsed FROM events""")
def parse_ts(spark, sf_dir):
    """Timestamps written as text and parsed back (second precision)."""
    from haze.operators.clean import parse_timestamp
    ev = Views(spark, sf_dir)["events"].select(
        "event_id", F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss").alias("ts_parsed"))
    return parse_timestamp(ev, "ts_parsed", "yyyy-MM-dd HH:mm:ss")

