"""Cleaning queries: imputation and the order-dependent outlier cascades."""

from __future__ import annotations

from haze.catalog import register
from haze.catalog._util import Views, rounded, view_sql
from haze.operators import clean

# Raw reading column order; the cascade visits columns in this order.
CASCADE_COLS = ["pm25", "aqi", "temperature", "humidity", "pressure", "wind_speed"]


def _iqr_cascade_sql(src: str, cols: list[str]) -> str:
    """Chained CTEs: step i takes quartiles of what step i-1 kept."""
    parts, prev = [], src
    for i, c in enumerate(cols):
        parts.append(f"""s{i} AS (SELECT * FROM {prev}, (SELECT quantile_cont({c}, 0.25) AS q1_{i},
                quantile_cont({c}, 0.75) AS q3_{i} FROM {prev}) q
            WHERE {c} >= q1_{i} - 1.5e0 * (q3_{i} - q1_{i}) AND {c} <= q3_{i} + 1.5e0 * (q3_{i} - q1_{i}))""")
        prev = f"(SELECT {', '.join(['reading_id', 'city'] + CASCADE_COLS)} FROM s{i})"
    return ",\n".join(parts), f"s{len(cols) - 1}"


def _z_cascade_sql(src: str, cols: list[str]) -> str:
    parts, prev = [], src
    for i, c in enumerate(cols):
        parts.append(f"""z{i} AS (SELECT * FROM {prev}, (SELECT avg({c}) AS m_{i}, stddev_pop({c}) AS s_{i} FROM {prev}) q
            WHERE s_{i} = 0 OR abs(({c} - m_{i}) / s_{i}) < 3)""")
        prev = f"(SELECT {', '.join(['reading_id', 'city'] + CASCADE_COLS)} FROM z{i})"
    return ",\n".join(parts), f"z{len(cols) - 1}"


_IQR_CTES, _IQR_LAST = _iqr_cascade_sql("readings", CASCADE_COLS)
_Z_CTES, _Z_LAST = _z_cascade_sql("readings", CASCADE_COLS)


def _readings(spark, sf_dir):
    return Views(spark, sf_dir)["readings"].select("reading_id", "city", *CASCADE_COLS)


@register("outlier_iqr", view_sql("readings") + ", " + _IQR_CTES + f"""
SELECT reading_id, city, pm25 FROM {_IQR_LAST}""")
def outlier_iqr(spark, sf_dir):
    kept, _fences = clean.remove_outliers_iqr(_readings(spark, sf_dir), CASCADE_COLS)
    return kept.select("reading_id", "city", "pm25")


@register("outlier_zscore", view_sql("readings") + ", " + _Z_CTES + f"""
SELECT reading_id, city, pm25 FROM {_Z_LAST}""")
def outlier_zscore(spark, sf_dir):
    kept, _fences = clean.remove_outliers_zscore(_readings(spark, sf_dir), CASCADE_COLS)
    return kept.select("reading_id", "city", "pm25")


@register("outlier_report", view_sql("readings") + ", " + _IQR_CTES + f"""
SELECT n_before, n_after, n_before - n_after AS n_removed,
       round((n_before - n_after) * 100.0e0 / n_before, 6) AS pct_removed
FROM (SELECT count(*) AS n_before FROM readings), (SELECT count(*) AS n_after FROM {_IQR_LAST})""")
def outlier_report(spark, sf_dir):
    df = _readings(spark, sf_dir)
    kept, _fences = clean.remove_outliers_iqr(df, CASCADE_COLS)
    return rounded(clean.removal_report(df, kept))


@register("impute_median", view_sql("readings_gaps") + """
SELECT reading_id, coalesce(pm25, (SELECT quantile_cont(pm25, 0.5) FROM readings_gaps)) AS pm25,
       coalesce(humidity, (SELECT quantile_cont(humidity, 0.5) FROM readings_gaps)) AS humidity
FROM readings_gaps""")
def impute_median(spark, sf_dir):
    df = Views(spark, sf_dir)["readings_gaps"].select("reading_id", "pm25", "humidity")
    return rounded(clean.impute_median(df, ["pm25", "humidity"]))


@register("impute_mode", view_sql("readings_gaps") + """
SELECT reading_id, coalesce(city, (SELECT arg_min(city, (-n, city)) FROM
       (SELECT city, count(*) AS n FROM readings_gaps WHERE city IS NOT NULL GROUP BY city))) AS city
FROM readings_gaps""")
def impute_mode(spark, sf_dir):
    df = Views(spark, sf_dir)["readings_gaps"].select("reading_id", "city")
    return clean.impute_mode(df, ["city"])


@register("impute_const", view_sql("readings_gaps") + """
SELECT reading_id, coalesce(city, 'missing') AS city FROM readings_gaps""")
def impute_const(spark, sf_dir):
    df = Views(spark, sf_dir)["readings_gaps"].select("reading_id", "city")
    return clean.impute_constant(df, ["city"])

