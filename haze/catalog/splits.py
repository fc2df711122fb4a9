"""Split, fold and sampling queries (exact sizes, seeded hash order)."""

from __future__ import annotations

from pyspark.sql import functions as F

from haze.catalog import register
from haze.catalog._util import Views, rounded, view_sql
from haze.functions import scalers
from haze.operators import joins, split

H = "md5(concat(CAST(reading_id AS VARCHAR), '-42'))"
RANKED = f"""ranked AS (
  SELECT reading_id, city, temperature, humidity,
         row_number() OVER (ORDER BY {H}, reading_id) - 1 AS r, count(*) OVER () AS n FROM readings)"""
RANKED_CITY = f"""ranked AS (
  SELECT reading_id, city, row_number() OVER (PARTITION BY city ORDER BY {H}, reading_id) - 1 AS r,
         count(*) OVER (PARTITION BY city) AS n FROM readings)"""


def _fold_sql(k: int) -> str:
    big = f"(n // {k} + 1)"
    return (f"CAST(CASE WHEN r < (n % {k}) * {big} THEN r // {big} "
            f"ELSE (n % {k}) + (r - (n % {k}) * {big}) // (n // {k}) END AS INTEGER)")


@register("holdout_split", view_sql("readings") + ", " + RANKED + """
SELECT reading_id, CAST(r < ceil(0.2e0 * n) AS INTEGER) AS is_test FROM ranked""")
def holdout_split(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"].select("reading_id")
    return split.holdout_split(df, ["reading_id"], 0.2)


@register("stratified_split", view_sql("readings") + ", " + RANKED_CITY + """
SELECT reading_id, city, CAST(r < ceil(0.2e0 * n) AS INTEGER) AS is_test FROM ranked""")
def stratified_split(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"].select("reading_id", "city")
    return split.holdout_split(df, ["reading_id"], 0.2, strata=["city"])


@register("kfold", view_sql("readings") + ", " + RANKED + f"""
SELECT reading_id, {_fold_sql(5)} AS fold FROM ranked""")
def kfold(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"].select("reading_id")
    return split.kfold(df, ["reading_id"], 5)


@register("stratified_kfold", view_sql("readings") + ", " + RANKED_CITY + f"""
SELECT reading_id, city, {_fold_sql(5)} AS fold FROM ranked""")
def stratified_kfold(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"].select("reading_id", "city")
    return split.kfold(df, ["reading_id"], 5, strata=["city"])


@register("kfold_composite", f"""
WITH ranked AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         row_number() OVER (ORDER BY md5(concat(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR),
             CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)), '-42')), l_orderkey, l_partkey, l_suppkey,
             l_linenumber) - 1 AS r,
         count(*) OVER () AS n FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_fold_sql(3)} AS fold FROM ranked""")
def kfold_composite(spark, sf_dir):
    """Three folds over line items keyed by (order, part, supplier, line number)."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    df = Views(spark, sf_dir)["lineitem"].select(*keys)
    return split.kfold(df, keys, 3)


@register("global_test_set", view_sql("readings") + ", " + RANKED + """
SELECT reading_id, CAST(r < round(0.1e0 * n) AS INTEGER) AS in_sample FROM ranked""")
def global_test_set(spark, sf_dir):
    df = Views(spark, sf_dir)["readings"].select("reading_id")
    return split.fraction_sample(df, ["reading_id"], 0.1)


@register("holdout_complement", view_sql("readings") + ", " + RANKED + """
SELECT reading_id, city FROM ranked WHERE NOT (r < round(0.1e0 * n))""")
def holdout_complement(spark, sf_dir):
    """Training rows = all rows minus the sampled test rows (anti join on the key)."""
    df = Views(spark, sf_dir)["readings"].select("reading_id", "city")
    test = split.fraction_sample(df, ["reading_id"], 0.1).where(F.col("in_sample") == 1)
    return joins.complement(df, test, ["reading_id"])


@register("scale_fit_apply", view_sql("readings") + ", " + RANKED + """,
tr AS (SELECT avg(temperature) AS mt, stddev_pop(temperature) AS st, avg(humidity) AS mh, stddev_pop(humidity) AS sh
       FROM ranked WHERE NOT (r < ceil(0.2e0 * n)))
SELECT reading_id, round((temperature - mt) / st, 6) AS temperature, round((humidity - mh) / sh, 6) AS humidity
FROM ranked, tr WHERE r < ceil(0.2e0 * n)""")
def scale_fit_apply(spark, sf_dir):
    """Standard scaler fitted on the training rows only and applied to the test rows."""
    df = Views(spark, sf_dir)["readings"].select("reading_id", "temperature", "humidity")
    marked = split.holdout_split(df, ["reading_id"], 0.2)
    train, test = marked.where("is_test = 0"), marked.where("is_test = 1")
    model = scalers.ExactScaler(inputCols=["temperature", "humidity"], method="standard").fit(train)
    return rounded(model.transform(test).drop("is_test"))
