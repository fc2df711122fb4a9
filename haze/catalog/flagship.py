"""Flagship: readings with duplicates → median fill → dropna → keep-first dedupe → AQI band → counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from haze.catalog import register
from haze.catalog._util import Views, rounded, view_sql
from haze.plans.preprocess import PreprocessConfig, clean_readings, preprocess
from haze.functions.features import AQI_BANDS, AQI_TOP

AQI_CASE = "CASE " + " ".join(f"WHEN {{x}} <= {edge:g} THEN '{name}'" for edge, name in AQI_BANDS) + f" ELSE '{AQI_TOP}' END"

# Median fill, dropna and keep-first dedupe of a readings view, in DuckDB.
CLEAN_SQL = """
med AS (SELECT quantile_cont(temperature, 0.5) AS m_t, quantile_cont(humidity, 0.5) AS m_h,
               quantile_cont(pressure, 0.5) AS m_p, quantile_cont(wind_speed, 0.5) AS m_w,
               quantile_cont(pm25, 0.5) AS m_pm, quantile_cont(aqi, 0.5) AS m_a FROM {src}),
filled AS (SELECT reading_id, city, ts, coalesce(pm25, m_pm) AS pm25, coalesce(aqi, m_a) AS aqi,
                  coalesce(temperature, m_t) AS temperature, coalesce(humidity, m_h) AS humidity,
                  coalesce(pressure, m_p) AS pressure, coalesce(wind_speed, m_w) AS wind_speed
           FROM {src}, med),
complete AS (SELECT * FROM filled WHERE reading_id IS NOT NULL AND city IS NOT NULL AND ts IS NOT NULL
             AND pm25 IS NOT NULL AND aqi IS NOT NULL AND temperature IS NOT NULL AND humidity IS NOT NULL
             AND pressure IS NOT NULL AND wind_speed IS NOT NULL),
deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city, ts ORDER BY reading_id) AS rn
                           FROM complete) WHERE rn = 1)"""


def flagship(spark, sf_dir):
    v = Views(spark, sf_dir)
    cleaned = clean_readings(v["readings_dups"], PreprocessConfig(check_nonempty=False))
    return cleaned.groupBy("city", "aqi_class").agg(F.count(F.lit(1)).alias("n_readings"))


register("flagship_class_counts", view_sql("readings_dups") + "," + CLEAN_SQL.format(src="readings_dups") + f"""
SELECT city, {AQI_CASE.format(x='aqi')} AS aqi_class, count(*) AS n_readings
FROM deduped GROUP BY 1, 2""")(flagship)


@register("preprocess_readings", view_sql("readings_gaps") + "," + CLEAN_SQL.format(src="readings_gaps") + f""",
banded AS (SELECT *, {AQI_CASE.format(x='aqi')} AS aqi_class FROM deduped),
mom AS (SELECT avg(temperature) AS a_t, stddev_pop(temperature) AS s_t, avg(humidity) AS a_h, stddev_pop(humidity) AS s_h,
               avg(pressure) AS a_p, stddev_pop(pressure) AS s_p, avg(wind_speed) AS a_w, stddev_pop(wind_speed) AS s_w,
               avg(pm25) AS a_pm, stddev_pop(pm25) AS s_pm, avg(aqi) AS a_a, stddev_pop(aqi) AS s_a FROM banded)
SELECT reading_id, ts,
       round((pm25 - a_pm) / CASE WHEN s_pm = 0 THEN 1 ELSE s_pm END, 6) AS pm25,
       round((aqi - a_a) / CASE WHEN s_a = 0 THEN 1 ELSE s_a END, 6) AS aqi,
       round((temperature - a_t) / CASE WHEN s_t = 0 THEN 1 ELSE s_t END, 6) AS temperature,
       round((humidity - a_h) / CASE WHEN s_h = 0 THEN 1 ELSE s_h END, 6) AS humidity,
       round((pressure - a_p) / CASE WHEN s_p = 0 THEN 1 ELSE s_p END, 6) AS pressure,
       round((wind_speed - a_w) / CASE WHEN s_w = 0 THEN 1 ELSE s_w END, 6) AS wind_speed,
       aqi_class,
       CAST(city = 'click' AS INTEGER) AS city_click, CAST(city = 'error' AS INTEGER) AS city_error,
       CAST(city = 'purchase' AS INTEGER) AS city_purchase, CAST(city = 'signup' AS INTEGER) AS city_signup,
       CAST(city = 'view' AS INTEGER) AS city_view
FROM banded, mom""")
def preprocess_readings(spark, sf_dir):
    v = Views(spark, sf_dir)
    return rounded(preprocess(v["readings_gaps"], PreprocessConfig(check_nonempty=False)))
