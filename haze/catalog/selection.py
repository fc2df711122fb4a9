"""Feature scoring and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from haze.catalog import register
from haze.catalog._util import Views, rounded, view_sql
from haze.catalog.flagship import AQI_CASE
from haze.functions import features
from haze.operators import select

FEATS = ["pm25", "temperature", "humidity", "pressure", "wind_speed"]


def _anova_sql(src: str, feats: list[str], label: str) -> str:
    parts = []
    for c in feats:
        parts.append(f"""SELECT '{c}' AS feature, round(
    ((sum(s * s / n) - pow(sum(s), 2) / sum(n)) / (count(*) - 1)) /
    (((sum(ss) - pow(sum(s), 2) / sum(n)) - (sum(s * s / n) - pow(sum(s), 2) / sum(n))) / (sum(n) - count(*))), 6) AS f_score
  FROM (SELECT {label}, count(*) AS n, sum({c}) AS s, sum({c} * {c}) AS ss FROM {src} GROUP BY {label})""")
    return "\nUNION ALL ".join(parts)


ANOVA_SQL = view_sql("readings") + f""",
lab AS (SELECT *, {AQI_CASE.format(x='aqi')} AS y FROM readings)
""" + _anova_sql("lab", FEATS, "y")


def _labelled(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"]
    return df.withColumn("y", features.aqi_band(F.col("aqi")))


@register("anova_f", ANOVA_SQL)
def anova_f(spark, sf_dir):
    return rounded(select.anova_f(_labelled(spark, sf_dir), FEATS, "y"))


REG_FEATS = ["pm25", "temperature", "humidity", "pressure", "wind_speed", "aqi"]

F_REG_SQL = view_sql("readings_signal") + "\n" + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(pow(corr({c}, target), 2) / (1 - pow(corr({c}, target), 2)) * (count(*) - 2), 6)
        AS f_score FROM readings_signal""" for c in REG_FEATS)


@register("f_regression", F_REG_SQL)
def f_regression(spark, sf_dir):
    df = Views(spark, sf_dir)["readings_signal"]
    return rounded(select.f_regression(df, REG_FEATS, "target"))


@register("select_k_best", "SELECT * FROM (" + F_REG_SQL + ") ORDER BY f_score DESC, feature LIMIT 3")
def select_k_best(spark, sf_dir):
    """Top-3 regression features by F score (the limit is the feature)."""
    df = Views(spark, sf_dir)["readings_signal"]
    return rounded(select.top_k(select.f_regression(df, REG_FEATS, "target"), 3))


@register("select_k_best_cls", "SELECT * FROM (" + ANOVA_SQL + ") ORDER BY f_score DESC, feature LIMIT 3")
def select_k_best_cls(spark, sf_dir):
    return rounded(select.top_k(select.anova_f(_labelled(spark, sf_dir), FEATS, "y"), 3))


@register("rfe")
def rfe(spark, sf_dir):
    """Recursive elimination with a 50-tree forest down to 3 of 6 features."""
    df, _ = features.label_index(_labelled(spark, sf_dir), "y", "label")
    return select.rfe(df, FEATS, "label", 3, "classification")


@register("select_both")
def select_both(spark, sf_dir):
    """k-best (4 of 6 by regression F) then forest elimination to 2, on the planted-signal table."""
    df = Views(spark, sf_dir)["readings_signal"]
    kept = select.select_k_best(df, REG_FEATS, "target", 4, "regression")
    return select.rfe(df, kept, "target", 2, "regression")
