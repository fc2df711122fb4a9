"""Per-city least squares, model averaging and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from haze.catalog import register
from haze.catalog._util import Views, rounded, view_sql
from haze.operators import grouped
from haze.plans import grouped_model

SIG = view_sql("readings_signal")
ONE = ["temperature"]
MULTI = ["temperature", "humidity", "wind_speed"]

OLS1_SQL = """per_city AS (
  SELECT city, count(*) AS n, regr_intercept(target, temperature) AS intercept, regr_slope(target, temperature) AS b_temperature
  FROM {src} GROUP BY city)"""


@register("group_ols", SIG + ", " + OLS1_SQL.format(src="readings_signal") + """
SELECT city, n, round(intercept, 6) AS intercept, round(b_temperature, 6) AS b_temperature FROM per_city""")
def group_ols(spark, sf_dir):
    """Per-city OLS of the planted target on temperature (one feature: SQL has regr_slope/intercept)."""
    df = Views(spark, sf_dir)["readings_signal"]
    return rounded(grouped.fit_per_group(df, "city", ONE, "target"))


@register("group_ols_multi")
def group_ols_multi(spark, sf_dir):
    """Per-city OLS on three features (checked against numpy lstsq in the tests)."""
    df = Views(spark, sf_dir)["readings_signal"]
    return rounded(grouped.fit_per_group(df, "city", MULTI, "target"))


@register("weighted_avg_coef", SIG + ", " + OLS1_SQL.format(src="readings_signal") + """
SELECT round(sum(intercept * n) / sum(n), 6) AS intercept, round(sum(b_temperature * n) / sum(n), 6) AS b_temperature,
       sum(n) AS n FROM per_city""")
def weighted_avg_coef(spark, sf_dir):
    df = Views(spark, sf_dir)["readings_signal"]
    return rounded(grouped.average_models(grouped.fit_per_group(df, "city", ONE, "target"), ONE))


@register("linear_score", SIG + ", " + OLS1_SQL.format(src="readings_signal") + """,
avg_model AS (SELECT sum(intercept * n) / sum(n) AS a, sum(b_temperature * n) / sum(n) AS b FROM per_city)
SELECT reading_id, round(a + b * temperature, 6) AS y_hat FROM readings_signal, avg_model""")
def linear_score(spark, sf_dir):
    df = Views(spark, sf_dir)["readings_signal"]
    model = grouped.average_models(grouped.fit_per_group(df, "city", ONE, "target"), ONE)
    return rounded(grouped.linear_score(df.select("reading_id", "temperature"), model, ONE).drop("temperature"))


FED_SQL = SIG + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat(CAST(reading_id AS VARCHAR), '-42')), reading_id) - 1 AS r,
                  count(*) OVER () AS n_all FROM readings_signal WHERE target IS NOT NULL),
test AS (SELECT * FROM ranked WHERE r < round(0.1e0 * n_all)),
train AS (SELECT * FROM ranked WHERE NOT (r < round(0.1e0 * n_all))),
kept AS (SELECT * FROM train WHERE city IN (SELECT city FROM train GROUP BY city HAVING count(*) >= 20)),
""" + OLS1_SQL.format(src="kept") + """,
avg_model AS (SELECT sum(intercept * n) / sum(n) AS a, sum(b_temperature * n) / sum(n) AS b FROM per_city),
scored AS (SELECT target AS y, a + b * temperature AS y_hat FROM test, avg_model)"""


@register("federated_avg", FED_SQL + """
SELECT count(*) AS n,
       round(1 - avg((y - y_hat) * (y - y_hat)) / var_pop(y), 6) AS r2,
       round(avg((y - y_hat) * (y - y_hat)), 6) AS mse, round(sqrt(avg((y - y_hat) * (y - y_hat))), 6) AS rmse,
       round(avg(abs(y - y_hat)), 6) AS mae, round(avg(abs(y - y_hat) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape,
       round(1 - var_pop(y - y_hat) / var_pop(y), 6) AS explained_variance,
       round(CASE WHEN least(min(y), min(y_hat)) >= 0 THEN avg(pow(ln(1 + y) - ln(1 + y_hat), 2)) END, 6) AS msle
FROM scored""")
def federated_avg(spark, sf_dir):
    """Averaged per-city model (one feature) scored on a 10 % hold-out: test metrics."""
    df = Views(spark, sf_dir)["readings_signal"]
    res = grouped_model.run(df, grouped_model.GroupedModelConfig(features=ONE))
    return rounded(res.metrics)


@register("metric_sink", FED_SQL + """
SELECT count(*) AS n,
       round(1 - avg((y - y_hat) * (y - y_hat)) / var_pop(y), 6) AS r2,
       round(avg((y - y_hat) * (y - y_hat)), 6) AS mse, round(sqrt(avg((y - y_hat) * (y - y_hat))), 6) AS rmse,
       round(avg(abs(y - y_hat)), 6) AS mae, round(avg(abs(y - y_hat) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape,
       round(1 - var_pop(y - y_hat) / var_pop(y), 6) AS explained_variance,
       round(CASE WHEN least(min(y), min(y_hat)) >= 0 THEN avg(pow(ln(1 + y) - ln(1 + y_hat), 2)) END, 6) AS msle
FROM scored""")
def metric_sink(spark, sf_dir):
    """Averaged-model metrics written as a JSON record to the shared folder and read back."""
    from haze.session import scratch_dir
    from haze.sources import files
    df = Views(spark, sf_dir)["readings_signal"]
    res = grouped_model.run(df, grouped_model.GroupedModelConfig(features=ONE))
    path = files.write_metadata(rounded(res.metrics), scratch_dir(spark, "metrics-json"))
    return spark.read.schema(res.metrics.schema).json(path)


@register("federated_avg_multi")
def federated_avg_multi(spark, sf_dir):
    """Averaged per-city model on three features: hold-out metrics (rows check; numpy-checked in tests)."""
    df = Views(spark, sf_dir)["readings_signal"]
    return rounded(grouped_model.run(df, grouped_model.GroupedModelConfig(features=MULTI)).metrics)


PLANTED = ["temperature", "humidity", "wind_speed", "pm25"]


@register("group_ols_planted", SIG + """
SELECT city, count(*) AS n, 0.0e0 AS intercept, 2.0e0 AS b_temperature, -0.5e0 AS b_humidity, 3.0e0 AS b_wind_speed,
       0.02e0 AS b_pm25 FROM readings_signal GROUP BY city""")
def group_ols_planted(spark, sf_dir):
    """Per-city OLS on the four columns that make up the planted target: its coefficients come back."""
    df = Views(spark, sf_dir)["readings_signal"]
    out = rounded(grouped.fit_per_group(df, "city", PLANTED, "target"), 5)
    return out.withColumn("intercept", F.abs("intercept"))


@register("federated_avg_all", FED_SQL + """
SELECT count(*) AS n, 1.0e0 AS r2, 0.0e0 AS mse, 0.0e0 AS rmse, 0.0e0 AS mae, 0.0e0 AS mape, 1.0e0 AS explained_variance,
       CASE WHEN min(y) >= 0 THEN 0.0e0 END AS msle FROM scored""")
def federated_avg_all(spark, sf_dir):
    """Averaged per-city model on all columns (numbers, one-hot city without the first, shared scaler):
    the planted target is linear in them, so the hold-out rows are met exactly."""
    df = Views(spark, sf_dir)["readings_signal"]
    return rounded(grouped_model.run(df, grouped_model.GroupedModelConfig()).metrics)
