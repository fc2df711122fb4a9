"""Feature-expression queries: time parts, interactions, bands, one-hot, scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from haze.catalog import register
from haze.catalog._util import Views, rounded, view_sql
from haze.catalog.flagship import AQI_CASE
from haze.functions import features, scalers


@register("time_features", view_sql("readings") + """
SELECT reading_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) - 1 >= 5 AS INTEGER) AS is_weekend FROM readings""")
def time_features(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"].select("reading_id", "ts")
    return features.add_time_features(df, "ts").drop("ts")


@register("interaction_features", view_sql("readings") + """
SELECT reading_id, round(pm25 * temperature, 6) AS pm25_temp_interaction,
       round(temperature / (humidity + 1e-8), 6) AS temp_humidity_ratio,
       round(pressure * temperature, 6) AS pressure_temp_interaction FROM readings""")
def interaction_features(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"]
    cls = features.add_interaction_features(df, "classification")
    reg = features.add_interaction_features(cls.drop("temp_humidity_ratio"), "regression")
    return rounded(reg.select("reading_id", "pm25_temp_interaction", "temp_humidity_ratio", "pressure_temp_interaction"))


@register("poly_features", view_sql("readings") + """
SELECT reading_id, round(pm25 * pm25, 6) AS pm25_squared, round(wind_speed * wind_speed, 6) AS wind_speed_squared,
       round(aqi * aqi, 6) AS aqi_squared FROM readings""")
def poly_features(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"]
    out = features.add_poly_features(features.add_poly_features(df, "classification"), "regression")
    return rounded(out.select("reading_id", "pm25_squared", "wind_speed_squared", "aqi_squared"))


@register("log_features", view_sql("readings_signal") + """
SELECT reading_id, round(ln(1 + pm25), 6) AS pm25_log,
       round(CASE WHEN target - 40 > -1 THEN ln(1 + (target - 40)) END, 6) AS shifted_log FROM readings_signal""")
def log_features(spark, sf_dir):
    """log1p of pm2.5, and of a shifted column that goes below -1 (null there, as NaN would be)."""
    df = Views(spark, sf_dir)["readings_signal"]
    return rounded(df.select("reading_id", features.safe_log1p(F.col("pm25")).alias("pm25_log"),
                             features.safe_log1p(F.col("target") - 40).alias("shifted_log")))


@register("engineer_features", view_sql("readings") + """
SELECT reading_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) - 1 >= 5 AS INTEGER) AS is_weekend,
       round(pm25 * temperature, 6) AS pm25_temp_interaction, round(temperature / (humidity + 1e-8), 6) AS temp_humidity_ratio,
       round(pm25 * pm25, 6) AS pm25_squared, round(ln(1 + pm25), 6) AS pm25_log
FROM readings""")
def engineer_features(spark, sf_dir):
    """All classification features, added only when their inputs exist; incomplete rows dropped."""
    df = Views(spark, sf_dir)["readings"].select("reading_id", "ts", "pm25", "temperature", "humidity")
    out = features.engineer_features(df, "classification")
    return rounded(out.drop("ts", "pm25", "temperature", "humidity"))


@register("one_hot", view_sql("readings_gaps") + """
SELECT reading_id, CAST(coalesce(city = 'click', false) AS INTEGER) AS city_click,
       CAST(coalesce(city = 'error', false) AS INTEGER) AS city_error,
       CAST(coalesce(city = 'purchase', false) AS INTEGER) AS city_purchase,
       CAST(coalesce(city = 'signup', false) AS INTEGER) AS city_signup,
       CAST(coalesce(city = 'view', false) AS INTEGER) AS city_view FROM readings_gaps""")
def one_hot(spark, sf_dir):
    df = Views(spark, sf_dir)["readings_gaps"].select("reading_id", "city")
    return features.one_hot(df, "city", prefix="city")


@register("one_hot_drop_first", view_sql("readings_gaps") + """
SELECT reading_id, CAST(coalesce(city = 'error', false) AS INTEGER) AS city_error,
       CAST(coalesce(city = 'purchase', false) AS INTEGER) AS city_purchase,
       CAST(coalesce(city = 'signup', false) AS INTEGER) AS city_signup,
       CAST(coalesce(city = 'view', false) AS INTEGER) AS city_view FROM readings_gaps""")
def one_hot_drop_first(spark, sf_dir):
    df = Views(spark, sf_dir)["readings_gaps"].select("reading_id", "city")
    return features.one_hot(df, "city", prefix="city", drop_first=True)


@register("aqi_band", view_sql("readings") + f"""
SELECT reading_id, {AQI_CASE.format(x='aqi')} AS aqi_class FROM readings""")
def aqi_band(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"]
    return df.select("reading_id", features.aqi_band(F.col("aqi")).alias("aqi_class"))


@register("pm25_class", view_sql("readings") + """,
t AS (SELECT quantile_cont(pm25, 0.33) AS p33, quantile_cont(pm25, 0.66) AS p66 FROM readings)
SELECT reading_id, CASE WHEN pm25 <= p33 THEN 'Low' WHEN pm25 <= p66 THEN 'Medium' ELSE 'High' END AS label
FROM readings, t""")
def pm25_class(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"].select("reading_id", "pm25")
    return features.add_tercile_label(df, "pm25", "label").select("reading_id", "label")


@register("digitize", view_sql("readings") + """
SELECT reading_id, CAST(CASE WHEN aqi < 0 THEN -1 WHEN aqi < 50 THEN 0 WHEN aqi < 100 THEN 1 ELSE 2 END AS INTEGER) AS aqi_bin
FROM readings""")
def digitize(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"]
    return df.select("reading_id", features.digitize(F.col("aqi")).alias("aqi_bin"))


def _scale_sql(center: str, scale: str, zero_value: str) -> str:
    cols = ["temperature", "humidity", "wind_speed"]
    stats = ", ".join(f"{center.format(c=c)} AS c_{c}, {scale.format(c=c)} AS s_{c}" for c in cols)
    outs = ", ".join(
        f"round(CASE WHEN s_{c} = 0 THEN {zero_value.format(c=c)} ELSE ({c} - c_{c}) / s_{c} END, 6) AS {c}" for c in cols)
    return view_sql("readings") + f", st AS (SELECT {stats} FROM readings)\nSELECT reading_id, {outs} FROM readings, st"


SCALE_COLS = ["temperature", "humidity", "wind_speed"]


@register("scale_standard", _scale_sql("avg({c})", "stddev_pop({c})", "({c} - c_{c})"))
def scale_standard(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"].select("reading_id", *SCALE_COLS)
    return rounded(scalers.scale(df, SCALE_COLS, "standard"))


@register("scale_robust", _scale_sql("quantile_cont({c}, 0.5)",
                                     "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))", "({c} - c_{c})"))
def scale_robust(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"].select("reading_id", *SCALE_COLS)
    return rounded(scalers.scale(df, SCALE_COLS, "robust"))


@register("scale_minmax", _scale_sql("min({c})", "(max({c}) - min({c}))", "0.0e0"))
def scale_minmax(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"].select("reading_id", *SCALE_COLS)
    return rounded(scalers.scale(df, SCALE_COLS, "minmax"))
