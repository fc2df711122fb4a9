"""Metric queries on the prediction fixture tables (no model needed: every one has a SQL twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from haze.catalog import register
from haze.catalog._util import Views, rounded, view_sql
from haze.functions import features
from haze.operators import metrics, split, stats

PC = view_sql("pred_class")
PR = view_sql("pred_reg")

PER_CLASS_SQL = """,
c AS (SELECT y, y_hat, count(*) AS n FROM pred_class GROUP BY 1, 2),
sup AS (SELECT y AS label, sum(n) AS support FROM c GROUP BY 1),
pre AS (SELECT y_hat AS label, sum(n) AS predicted FROM c GROUP BY 1),
tpt AS (SELECT y AS label, n AS tp FROM c WHERE y = y_hat),
pc0 AS (SELECT coalesce(sup.label, pre.label) AS label, coalesce(support, 0) AS support,
               coalesce(predicted, 0) AS predicted FROM sup FULL JOIN pre ON sup.label = pre.label),
pc1 AS (SELECT pc0.*, coalesce(tpt.tp, 0) AS tp,
               CASE WHEN predicted > 0 THEN CAST(coalesce(tpt.tp, 0) AS DOUBLE) / predicted ELSE 0.0e0 END AS p,
               CASE WHEN support > 0 THEN CAST(coalesce(tpt.tp, 0) AS DOUBLE) / support ELSE 0.0e0 END AS r
        FROM pc0 LEFT JOIN tpt ON pc0.label = tpt.label),
pc AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0e0 END AS f1 FROM pc1)
"""


def _pred_class(spark, sf_dir):
    return Views(spark, sf_dir)["pred_class"]


def _pred_reg(spark, sf_dir):
    return Views(spark, sf_dir)["pred_reg"]


@register("confusion_matrix", PC + """,
labels AS (SELECT y AS l FROM pred_class UNION SELECT y_hat FROM pred_class),
c AS (SELECT y, y_hat, count(*) AS n FROM pred_class GROUP BY 1, 2)
SELECT a.l AS y, b.l AS y_hat, coalesce(c.n, 0) AS n
FROM labels a CROSS JOIN labels b LEFT JOIN c ON c.y = a.l AND c.y_hat = b.l""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_pred_class(spark, sf_dir))


@register("clf_metrics", PC + PER_CLASS_SQL + """
SELECT round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy,
       round(sum(p * support) / sum(support), 6) AS precision,
       round(sum(r * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1 FROM pc""")
def clf_metrics(spark, sf_dir):
    return rounded(metrics.classification_metrics(_pred_class(spark, sf_dir)))


@register("classification_report", PC + PER_CLASS_SQL + """
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM pc
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), sum(support) FROM pc
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), sum(support) FROM pc""")
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(_pred_class(spark, sf_dir)))


@register("notebook_metrics", PC + PER_CLASS_SQL + """
SELECT 'Accuracy' AS metric, round(CAST(sum(tp) AS DOUBLE) / sum(support), 2) AS value FROM pc
UNION ALL SELECT 'F1-Score (Weighted)', round(sum(f1 * support) / sum(support), 2) FROM pc
UNION ALL SELECT 'Precision (Macro)', round(avg(p), 2) FROM pc
UNION ALL SELECT 'Recall (Macro)', round(avg(r), 2) FROM pc
UNION ALL SELECT 'F1-Score (Macro)', round(avg(f1), 2) FROM pc""")
def notebook_metrics(spark, sf_dir):
    """Per-model metric table with values rounded to two places for display."""
    return metrics.metric_table(_pred_class(spark, sf_dir))


AUC_COUNTS = """,
sc AS (SELECT score AS s, CAST(count_if(y = 'purchase') AS DOUBLE) AS pos,
              CAST(count_if(y <> 'purchase') AS DOUBLE) AS neg FROM pred_class GROUP BY 1)"""


@register("roc_auc", PC + AUC_COUNTS + """,
cum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_neg FROM sc)
SELECT round(sum(pos * (cum_neg + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM cum""")
def roc_auc(spark, sf_dir):
    """Binary AUC: 'purchase' against the rest, scored by value (ties count half)."""
    df = _pred_class(spark, sf_dir)
    return rounded(metrics.roc_auc(df, F.col("y") == F.lit("purchase"), "score"))


@register("roc_curve", PC + AUC_COUNTS + """
SELECT s AS threshold,
       round(sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) / sum(neg) OVER (), 6) AS fpr,
       round(sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) / sum(pos) OVER (), 6) AS tpr FROM sc
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0e0, 0.0e0""")
def roc_curve(spark, sf_dir):
    """The curve of 'purchase' against the rest, from its start at (0, 0)."""
    df = _pred_class(spark, sf_dir)
    return rounded(metrics.roc_curve(df, F.col("y") == F.lit("purchase"), "score"))


def _ovr_long(df):
    """One row per (event, class) with a per-class score; the class list is the bounded label set."""
    classes = features.category_values(df, "y")
    long = df.select("event_id", "y", "score", F.explode(F.array(*[F.lit(c) for c in classes])).alias("cls"))
    base = ((F.col("event_id") * 7 + F.length("cls") * 13) % 101) / 100.0
    bonus = F.when(F.col("y") == F.col("cls"), F.col("score") / 500.0).otherwise(F.lit(0.0))
    return long.select("event_id", "y", "cls", (base + bonus).alias("cls_score"))


@register("roc_auc_ovr", PC + """,
classes AS (SELECT DISTINCT y AS cls FROM pred_class),
lg AS (SELECT p.y, c.cls, ((p.event_id * 7 + length(c.cls) * 13) % 101) / 100.0e0
              + CASE WHEN p.y = c.cls THEN p.score / 500.0e0 ELSE 0.0e0 END AS s
       FROM pred_class p CROSS JOIN classes c),
sc AS (SELECT cls, s, CAST(count_if(y = cls) AS DOUBLE) AS pos, CAST(count_if(y <> cls) AS DOUBLE) AS neg FROM lg GROUP BY 1, 2),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS cum_neg FROM sc),
per AS (SELECT cls, sum(pos * (cum_neg + neg / 2)) / (sum(pos) * sum(neg)) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos,
               CAST(sum(neg) AS BIGINT) AS n_neg FROM cum GROUP BY cls)
SELECT cls, round(auc, 6) AS auc, n_pos, n_neg FROM per
UNION ALL SELECT 'weighted', round(sum(auc * n_pos) / sum(n_pos), 6), CAST(sum(n_pos) AS BIGINT), CAST(NULL AS BIGINT) FROM per""")
def roc_auc_ovr(spark, sf_dir):
    """One-vs-rest AUC per class and support-weighted, from per-class scores."""
    return rounded(metrics.roc_auc_ovr(_ovr_long(_pred_class(spark, sf_dir)), "y", "cls", "cls_score"))


@register("roc_curve_ovr", PC + """,
classes AS (SELECT DISTINCT y AS cls FROM pred_class),
lg AS (SELECT p.y, c.cls, ((p.event_id * 7 + length(c.cls) * 13) % 101) / 100.0e0
              + CASE WHEN p.y = c.cls THEN p.score / 500.0e0 ELSE 0.0e0 END AS s
       FROM pred_class p CROSS JOIN classes c),
sc AS (SELECT cls, s, CAST(count_if(y = cls) AS DOUBLE) AS pos, CAST(count_if(y <> cls) AS DOUBLE) AS neg FROM lg GROUP BY 1, 2)
SELECT cls, round(s, 6) AS threshold,
       round(sum(neg) OVER (PARTITION BY cls ORDER BY s DESC ROWS UNBOUNDED PRECEDING) / sum(neg) OVER (PARTITION BY cls), 6) AS fpr,
       round(sum(pos) OVER (PARTITION BY cls ORDER BY s DESC ROWS UNBOUNDED PRECEDING) / sum(pos) OVER (PARTITION BY cls), 6) AS tpr FROM sc
UNION ALL SELECT cls, CAST('inf' AS DOUBLE), 0.0e0, 0.0e0 FROM classes""")
def roc_curve_ovr(spark, sf_dir):
    """One curve per class against the rest, each from (0, 0)."""
    long = _ovr_long(_pred_class(spark, sf_dir))
    return rounded(metrics.roc_curve(long, F.col("y") == F.col("cls"), "cls_score", by=["cls"]))


_LONG = """,
classes AS (SELECT DISTINCT y AS cls FROM pred_class),
lg AS (SELECT p.y, c.cls, ((p.event_id * 7 + length(c.cls) * 13) % 101) / 100.0e0
              + CASE WHEN p.y = c.cls THEN p.score / 500.0e0 ELSE 0.0e0 END AS s
       FROM pred_class p CROSS JOIN classes c),
sc AS (SELECT cls, s, CAST(count_if(y = cls) AS DOUBLE) AS pos, CAST(count_if(y <> cls) AS DOUBLE) AS neg FROM lg GROUP BY 1, 2)"""


@register("roc_curve_thinned", PC + _LONG + """,
pts AS (SELECT cls, s, pos, neg, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS k,
               sum(neg) OVER (PARTITION BY cls ORDER BY s DESC ROWS UNBOUNDED PRECEDING) / sum(neg) OVER (PARTITION BY cls) AS fpr,
               sum(pos) OVER (PARTITION BY cls ORDER BY s DESC ROWS UNBOUNDED PRECEDING) / sum(pos) OVER (PARTITION BY cls) AS tpr
        FROM sc WINDOW w AS (PARTITION BY cls ORDER BY s DESC))
SELECT cls, round(s, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM pts
WHERE k = 1 OR np IS NULL OR np <> pos OR nn <> neg
UNION ALL SELECT cls, CAST('inf' AS DOUBLE), 0.0e0, 0.0e0 FROM classes""")
def roc_curve_thinned(spark, sf_dir):
    """One curve per class against the rest, without the points between two equal steps."""
    long = _ovr_long(_pred_class(spark, sf_dir))
    return rounded(metrics.roc_curve_thinned(long, F.col("y") == F.col("cls"), "cls_score", by=["cls"]))


REG_SQL = """SELECT count(*) AS n,
       round(1 - avg((y - y_hat) * (y - y_hat)) / var_pop(y), 6) AS r2,
       round(avg((y - y_hat) * (y - y_hat)), 6) AS mse, round(sqrt(avg((y - y_hat) * (y - y_hat))), 6) AS rmse,
       round(avg(abs(y - y_hat)), 6) AS mae, round(avg(abs(y - y_hat) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape,
       round(1 - var_pop(y - y_hat) / var_pop(y), 6) AS explained_variance,
       round(avg(pow(ln(1 + y) - ln(1 + y_hat), 2)), 6) AS msle"""


@register("reg_metrics", PR + REG_SQL + " FROM pred_reg")
def reg_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(_pred_reg(spark, sf_dir)))


KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@register("residuals", PR + """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(y, 6) AS y, round(y_hat, 6) AS y_hat,
       round(y - y_hat, 6) AS residual FROM pred_reg""")
def residuals(spark, sf_dir):
    return rounded(metrics.residuals(_pred_reg(spark, sf_dir), KEYS))


@register("pred_vs_actual", PR + """
SELECT count(*) AS n, round(1 - avg((y - y_hat) * (y - y_hat)) / var_pop(y), 6) AS r2,
       round(least(min(y), min(y_hat)), 6) AS lo, round(greatest(max(y), max(y_hat)), 6) AS hi FROM pred_reg""")
def pred_vs_actual(spark, sf_dir):
    return rounded(metrics.pred_vs_actual(_pred_reg(spark, sf_dir)))


@register("residual_hist", PR + """,
e AS (SELECT y - y_hat AS residual FROM pred_reg),
rng AS (SELECT min(residual) AS lo, max(residual) AS hi FROM e),
counts AS (SELECT least(CAST(floor((residual - lo) / (hi - lo) * 30) AS INTEGER), 29) AS bin, count(*) AS n FROM e, rng GROUP BY 1)
SELECT CAST(b.range AS INTEGER) AS bin, round(lo + b.range * ((hi - lo) / 30), 6) AS bin_lo,
       round(lo + (b.range + 1) * ((hi - lo) / 30), 6) AS bin_hi, coalesce(c.n, 0) AS n
FROM range(30) b CROSS JOIN rng LEFT JOIN counts c ON c.bin = b.range""")
def residual_hist(spark, sf_dir):
    e = metrics.residuals(_pred_reg(spark, sf_dir), KEYS)
    return rounded(stats.histogram(e, "residual", 30))


@register("residual_kde", PR + """,
e AS (SELECT y - y_hat AS x FROM pred_reg),
st AS (SELECT count(x) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd,
              stddev_samp(x) * pow(count(x), -1.0e0 / 5.0e0) AS h FROM e),
w AS (SELECT (hi - lo) / 256 AS width FROM st),
cen AS (SELECT lo + (least(floor((x - lo) / width), 255) + 0.5e0) * width AS centre, count(*) AS c FROM e, st, w GROUP BY 1),
g AS (SELECT (lo - 3 * h) + range * (((hi + 3 * h) - (lo - 3 * h)) / 199) AS grid_x FROM st, range(200))
SELECT round(grid_x, 6) AS grid_x,
       round(sum(c * exp(-0.5e0 * ((grid_x - centre) / h) * ((grid_x - centre) / h))) * (1.0e0 / (n * h * sqrt(2 * pi()))), 6)
       AS density
FROM g, cen, st GROUP BY grid_x, n, h""")
def residual_kde(spark, sf_dir):
    e = metrics.residuals(_pred_reg(spark, sf_dir), KEYS)
    return rounded(metrics.kde_on_bins(e, "residual", 200, 256))


def _fold_metrics(spark, sf_dir, k: int = 5):
    df = split.kfold(_pred_reg(spark, sf_dir), KEYS, k)
    return metrics.regression_metrics(df, by=["fold"], msle=False)


FOLD_SQL = PR + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat(concat_ws('|', CAST(l_orderkey AS VARCHAR),
              CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)), '-42')),
              l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1 AS r, count(*) OVER () AS n FROM pred_reg),
folded AS (SELECT *, CAST(CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1)
                   ELSE (n % 5) + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM ranked),
fm AS (SELECT fold, avg((y - y_hat) * (y - y_hat)) AS mse FROM folded GROUP BY fold)"""


@register("cv_summary", FOLD_SQL + """
SELECT round(avg(mse), 6) AS cv_mse_mean, round(stddev_pop(mse), 6) AS cv_mse_std,
       round(sqrt(avg(mse)), 6) AS cv_rmse_mean, round(sqrt(stddev_pop(mse)), 6) AS cv_mse_std_sqrt,
       round(stddev_pop(sqrt(mse)), 6) AS cv_rmse_std, count(*) AS n_folds FROM fm""")
def cv_summary(spark, sf_dir):
    """Fold-score summary: mean/std of fold MSE, √mean, √std (the reference's odd 'RMSE std'), std of fold RMSE."""
    fm = _fold_metrics(spark, sf_dir)
    return rounded(fm.agg(
        F.avg("mse").alias("cv_mse_mean"), F.stddev_pop("mse").alias("cv_mse_std"),
        F.sqrt(F.avg("mse")).alias("cv_rmse_mean"), F.sqrt(F.stddev_pop("mse")).alias("cv_mse_std_sqrt"),
        F.stddev_pop("rmse").alias("cv_rmse_std"), F.count(F.lit(1)).alias("n_folds")))


@register("best_round", FOLD_SQL + """
SELECT arg_min(fold, sqrt(mse)) AS best_round, round(min(sqrt(mse)), 6) AS best_rmse FROM fm""")
def best_round(spark, sf_dir):
    """Metric history (one entry per round/fold) and the round with the lowest RMSE."""
    fm = _fold_metrics(spark, sf_dir)
    return rounded(fm.agg(F.min_by("fold", "rmse").alias("best_round"), F.min("rmse").alias("best_rmse")))


COMPARE_SQL = PR + """,
m AS (SELECT 'scaled' AS model, 0 AS pos, 1 - avg((y - y_hat) * (y - y_hat)) / var_pop(y) AS r2,
             avg(abs(y - y_hat)) AS mae FROM pred_reg
      UNION ALL SELECT 'identity_plus', 1, 1 - avg((y - (y + 0.5e0)) * (y - (y + 0.5e0))) / var_pop(y),
             avg(abs(y - (y + 0.5e0))) FROM pred_reg
      UNION ALL SELECT 'mean_only', 2, 1 - avg((y - m) * (y - m)) / var_pop(y), avg(abs(y - m))
             FROM pred_reg, (SELECT avg(y) AS m FROM pred_reg))"""


def _comparison(spark, sf_dir):
    df = _pred_reg(spark, sf_dir)
    mean_y = df.agg(F.avg("y").alias("m")).first()["m"]
    models = [("scaled", F.col("y_hat")), ("identity_plus", F.col("y") + 0.5), ("mean_only", F.lit(mean_y))]
    base = df
    parts = []
    for pos, (name, pred) in enumerate(models):
        m = metrics.regression_metrics(base.select("y", pred.alias("y_hat")), msle=False)
        parts.append(m.select(F.lit(name).alias("model"), F.lit(pos).alias("pos"), "r2", "mae"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("model_comparison", COMPARE_SQL + """
SELECT model, metric, round(value, 6) AS value FROM (
  SELECT model, 'r2' AS metric, r2 AS value FROM m UNION ALL SELECT model, 'mae', mae FROM m)""")
def model_comparison(spark, sf_dir):
    """Metric per model in long form (the table behind a comparison bar chart)."""
    wide = _comparison(spark, sf_dir)
    return rounded(wide.unpivot(["model"], ["r2", "mae"], "metric", "value"))


@register("leaderboard", COMPARE_SQL + """
SELECT model, round(r2, 6) AS r2, round(mae, 6) AS mae, CAST(row_number() OVER (ORDER BY r2 DESC, pos) AS INTEGER) AS rank
FROM m""")
def leaderboard(spark, sf_dir):
    """Models sorted by R² descending, listing order breaking ties."""
    from pyspark.sql import Window
    wide = _comparison(spark, sf_dir)
    w = Window.orderBy(F.desc("r2"), F.asc("pos"))  # one row per model: a tiny table
    return rounded(wide.select("model", "r2", "mae", F.row_number().over(w).cast("int").alias("rank")))


@register("best_model", COMPARE_SQL + """
SELECT model, round(r2, 6) AS r2 FROM m ORDER BY r2 DESC, pos LIMIT 1""")
def best_model(spark, sf_dir):
    """Top-1 model; strict '>' on the score, so the first listed wins a tie."""
    wide = _comparison(spark, sf_dir)
    return rounded(wide.orderBy(F.desc("r2"), F.asc("pos")).limit(1).select("model", "r2"))
