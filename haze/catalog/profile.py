"""Statistics and profile-table queries (A-rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from haze.catalog import register
from haze.catalog._util import Views, rounded, view_sql
from haze.functions import features
from haze.operators import stats, wide

NUM = ["pm25", "aqi", "temperature", "humidity", "pressure", "wind_speed"]
GAP_NUM = NUM


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


@register("null_counts", view_sql("readings_gaps") + _union([
    f"SELECT '{c}' AS column, count_if({c} IS NULL) AS n_null FROM readings_gaps"
    for c in ["reading_id", "city", "ts", "pm25", "aqi", "temperature", "humidity", "pressure", "wind_speed"]]))
def null_counts(spark, sf_dir):
    return stats.null_counts(Views(spark, sf_dir)["readings_gaps"])


@register("value_counts", view_sql("readings_gaps") + """
SELECT city, count(*) AS n FROM readings_gaps WHERE city IS NOT NULL GROUP BY city""")
def value_counts(spark, sf_dir):
    return stats.value_counts(Views(spark, sf_dir)["readings_gaps"], "city")


@register("class_counts", """
SELECT CAST(dense_rank() OVER (ORDER BY y) - 1 AS INTEGER) AS label_idx, n FROM (
  SELECT event_type AS y, count(*) AS n FROM events GROUP BY event_type)""")
def class_counts(spark, sf_dir):
    """Counts per label code (labels coded a..z from 0), like bincount on encoded labels."""
    ev = Views(spark, sf_dir)["events"].select(F.col("event_type").alias("y"))
    coded, _model = features.label_index(ev, "y")
    return coded.groupBy("label_idx").agg(F.count(F.lit(1)).alias("n"))


@register("label_encode", """
SELECT event_id, event_type AS y, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS label_idx FROM events""")
def label_encode(spark, sf_dir):
    ev = Views(spark, sf_dir)["events"].select("event_id", F.col("event_type").alias("y"))
    coded, _model = features.label_index(ev, "y")
    return coded


@register("medians", view_sql("readings_gaps") + "SELECT " + ", ".join(
    f"round(quantile_cont({c}, 0.5), 6) AS {c}" for c in GAP_NUM) + " FROM readings_gaps")
def medians(spark, sf_dir):
    df = Views(spark, sf_dir)["readings_gaps"]
    found = stats.medians(df, GAP_NUM)
    return rounded(spark.range(1).select(*[F.lit(found[c]).cast("double").alias(c) for c in GAP_NUM]))


@register("most_frequent", """
WITH c AS (SELECT 'event_type' AS column, event_type AS value, count(*) AS n FROM events GROUP BY 2
           UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2)
SELECT "column", arg_min(value, (-n, value)) AS mode, max(n) AS n FROM c GROUP BY 1""")
def most_frequent(spark, sf_dir):
    ev = Views(spark, sf_dir)["events"]
    return stats.most_frequent(ev, ["event_type", "user_id"])


@register("quartiles", view_sql("readings") + "SELECT " + ", ".join(
    f"round(quantile_cont({c}, 0.25), 6) AS {c}_p25, round(quantile_cont({c}, 0.75), 6) AS {c}_p75" for c in NUM)
    + " FROM readings")
def quartiles(spark, sf_dir):
    return rounded(stats.quantiles(Views(spark, sf_dir)["readings"], NUM, [0.25, 0.75]))


@register("terciles", view_sql("readings") + """
SELECT round(quantile_cont(pm25, 0.33), 6) AS pm25_p33, round(quantile_cont(pm25, 0.66), 6) AS pm25_p66 FROM readings""")
def terciles(spark, sf_dir):
    return rounded(stats.quantiles(Views(spark, sf_dir)["readings"], ["pm25"], [0.33, 0.66]))


@register("mean_std", view_sql("readings") + _union([
    f"SELECT '{c}' AS column, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM readings" for c in NUM]))
def mean_std(spark, sf_dir):
    return rounded(stats.mean_std(Views(spark, sf_dir)["readings"], NUM))


@register("min_max", view_sql("readings") + _union([
    f"SELECT '{c}' AS column, min({c}) AS min, max({c}) AS max FROM readings" for c in NUM]))
def min_max(spark, sf_dir):
    return rounded(stats.min_max(Views(spark, sf_dir)["readings"], NUM))


@register("describe", view_sql("readings") + _union([
    f"""SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM readings""" for c in NUM]))
def describe(spark, sf_dir):
    return rounded(stats.describe(Views(spark, sf_dir)["readings"], NUM))


def _corr_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM {src}")
            parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM {src}")
        parts.append(f"SELECT '{a}' AS col_a, '{a}' AS col_b, 1.0e0 AS corr")
    return _union(parts)


CORR_COLS = ["pm25", "temperature", "humidity", "pressure", "wind_speed"]


@register("corr_matrix", view_sql("readings") + _corr_sql("readings", CORR_COLS))
def corr_matrix(spark, sf_dir):
    return rounded(stats.corr_matrix(Views(spark, sf_dir)["readings"], CORR_COLS))


WIDE = 500


@register("corr_wide", f"""
WITH cells AS (SELECT vec_id, c, CAST(embedding[c % 64 + 1] AS DOUBLE) * CASE WHEN c < 64 THEN 1.0e0
                      ELSE CAST(embedding[(c + c // 64) % 64 + 1] AS DOUBLE) END AS v
               FROM (SELECT vec_id, embedding, unnest(range({WIDE})) AS c FROM embeddings)),
g AS (SELECT CASE WHEN (vec_id + c) % 11 = 3 THEN NULL ELSE v END AS v, vec_id, c FROM cells),
half AS (SELECT a.c AS i, b.c AS j, CASE WHEN a.c = b.c THEN 1.0e0 ELSE round(corr(a.v, b.v), 6) END AS corr
         FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.c <= b.c GROUP BY 1, 2)
SELECT 'c' || i AS col_a, 'c' || j AS col_b, corr FROM half
UNION ALL SELECT 'c' || j, 'c' || i, corr FROM half WHERE i <> j""")
def corr_wide(spark, sf_dir):
    """Pearson matrix of 500 columns with gaps: the embedding's entries and products of two of them."""
    e = Views(spark, sf_dir)["embeddings"]
    at = lambda k: F.get("embedding", F.lit(k % 64)).cast("double")
    value = lambda c: at(c) if c < 64 else at(c) * at(c + c // 64)
    table = e.select(*[F.when((F.col("vec_id") + c) % 11 != 3, value(c)).alias(f"c{c}") for c in range(WIDE)])
    return rounded(wide.wide_corr(table, [f"c{c}" for c in range(WIDE)]))


@register("nullity_corr", view_sql("readings_gaps") + """,
flags AS (SELECT CAST(city IS NULL AS DOUBLE) AS city, CAST(pm25 IS NULL AS DOUBLE) AS pm25,
                 CAST(humidity IS NULL AS DOUBLE) AS humidity FROM readings_gaps)
""" + _corr_sql("flags", ["city", "pm25", "humidity"]))
def nullity_corr(spark, sf_dir):
    df = Views(spark, sf_dir)["readings_gaps"]
    return rounded(stats.nullity_corr(df))


@register("histogram", view_sql("readings") + """,
rng AS (SELECT min(pm25) AS lo, max(pm25) AS hi FROM readings),
counts AS (SELECT least(CAST(floor((pm25 - lo) / (hi - lo) * 20) AS INTEGER), 19) AS bin, count(*) AS n
           FROM readings, rng WHERE pm25 IS NOT NULL GROUP BY 1)
SELECT CAST(b.range AS INTEGER) AS bin, round(lo + b.range * ((hi - lo) / 20), 6) AS bin_lo,
       round(lo + (b.range + 1) * ((hi - lo) / 20), 6) AS bin_hi, coalesce(c.n, 0) AS n
FROM range(20) b CROSS JOIN rng LEFT JOIN counts c ON c.bin = b.range""")
def histogram(spark, sf_dir):
    return rounded(stats.histogram(Views(spark, sf_dir)["readings"], "pm25", 20))


@register("boxplot", view_sql("readings") + """,
q AS (SELECT city, quantile_cont(pm25, 0.25) AS q1, quantile_cont(pm25, 0.5) AS median,
             quantile_cont(pm25, 0.75) AS q3 FROM readings WHERE pm25 IS NOT NULL GROUP BY city),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5e0 * (q3 - q1) AS fence_lo, q3 + 1.5e0 * (q3 - q1) AS fence_hi FROM q)
SELECT f.city, count(*) AS n, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       round(f.iqr, 6) AS iqr,
       round(min(CASE WHEN r.pm25 >= f.fence_lo AND r.pm25 <= f.fence_hi THEN r.pm25 END), 6) AS whisker_lo,
       round(max(CASE WHEN r.pm25 >= f.fence_lo AND r.pm25 <= f.fence_hi THEN r.pm25 END), 6) AS whisker_hi,
       count_if(NOT (r.pm25 >= f.fence_lo AND r.pm25 <= f.fence_hi)) AS n_fliers
FROM readings r JOIN f ON r.city = f.city WHERE r.pm25 IS NOT NULL
GROUP BY f.city, f.q1, f.median, f.q3, f.iqr""")
def boxplot(spark, sf_dir):
    return rounded(stats.boxplot(Views(spark, sf_dir)["readings"], "pm25", "city"))


@register("weighted_avg", """
SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS l_discount,
       round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS l_tax
FROM lineitem GROUP BY l_returnflag""")
def weighted_avg(spark, sf_dir):
    li = Views(spark, sf_dir)["lineitem"]
    return rounded(stats.weighted_average(li, ["l_discount", "l_tax"], "l_quantity", by=["l_returnflag"]))
