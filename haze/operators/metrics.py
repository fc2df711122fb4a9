"""Classification and regression metrics, ROC/AUC, residual tables.

All metrics are aggregations over the prediction table; nothing is
collected but a bounded label list (for the full confusion grid) and
bucket totals.  Rank-based metrics (AUC, ROC) first collapse rows to one row
per distinct score, so a score value shared by many rows costs one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haze.session import written

MAPE_EPS = 2.220446049250313e-16  # float64 machine epsilon, the floor on |y| in MAPE


def confusion_matrix(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Long confusion matrix (y, y_hat, n) over all pairs of labels that occur on either side, zeros kept.

    One scan: labels and grid come from the counted pairs.  The grid is the result's own size (labels
    squared) and is made by exploding the label list of each label, on the cluster.
    """
    counts = written(df.groupBy(y, y_hat).agg(F.count(F.lit(1)).alias("n")), "confusion")
    labels = counts.select(F.explode(F.array(y, y_hat)).alias("l")).where(F.col("l").isNotNull()).distinct()
    every = labels.agg(F.array_sort(F.collect_list("l")).alias("a")).first()["a"] or []
    grid = labels.select(F.col("l").alias(y), F.explode(F.lit(every).cast(f"array<{df.schema[y].dataType.simpleString()}>")).alias(y_hat)) \
        if every else counts.select(y, y_hat).limit(0)
    return (grid.join(counts, [y, y_hat], "left")
            .select(y, y_hat, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def per_class(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Per label: tp, support (true count), predicted count, precision, recall, f1 (0 on zero division)."""
    counts = df.groupBy(y, y_hat).agg(F.count(F.lit(1)).alias("n"))
    support = counts.groupBy(F.col(y).alias("label")).agg(F.sum("n").alias("support"))
    predicted = counts.groupBy(F.col(y_hat).alias("label")).agg(F.sum("n").alias("predicted"))
    tp = counts.where(F.col(y) == F.col(y_hat)).select(F.col(y).alias("label"), F.col("n").alias("tp"))
    t = (support.join(predicted, "label", "full").join(tp, "label", "left")
         .where(F.col("label").isNotNull())
         .select("label", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "support", "predicted")]))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    t = t.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when((F.col("precision") + F.col("recall")) > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return t.withColumn("f1", f1)


def classification_metrics(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """accuracy and support-weighted precision / recall / f1 (one row)."""
    pc = per_class(df, y, y_hat)
    n = F.sum("support")
    return pc.agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"))


def classification_report(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Per-class precision/recall/f1/support plus 'macro avg' and 'weighted avg' rows."""
    pc = per_class(df, y, y_hat).select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    n = F.sum("support")
    macro = pc.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), n.alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("label"),
                      (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"), n.alias("support"))
    return pc.unionByName(macro).unionByName(weighted)


def metric_table(df: DataFrame, y: str = "y", y_hat: str = "y_hat", places: int = 2) -> DataFrame:
    """The notebook's per-model table: (metric, value) for accuracy, weighted F1 and macro
    precision / recall / F1, rounded for display."""
    pc = per_class(df, y, y_hat)
    n = F.sum("support")
    row = pc.agg((F.sum("tp") / n).alias("a"), (F.sum(F.col("f1") * F.col("support")) / n).alias("fw"),
                 F.avg("precision").alias("pm"), F.avg("recall").alias("rm"), F.avg("f1").alias("fm"))
    names = [("Accuracy", "a"), ("F1-Score (Weighted)", "fw"), ("Precision (Macro)", "pm"),
             ("Recall (Macro)", "rm"), ("F1-Score (Macro)", "fm")]
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.round(F.col(c), places).alias("value")) for k, c in names])).alias("m")
    ).select("m.*")


def prefix_sums(df: DataFrame, order_col: str, value_cols: list[str], partition_cols: list[str] | None = None,
                buckets: int | None = None, inclusive: bool = False) -> DataFrame:
    """Running sums of ``value_cols`` in ``order_col`` order within each partition, without
    sending a whole partition to one task.

    Rows are cut into ``buckets`` range buckets (bounds from ``percentile_approx``; by default one per 100,000 rows,
    at least 1,024, so that no bucket grows with the data);
    bucket totals (a table of at most partitions × buckets rows) give each
    bucket's offset through a window over that small table; inside a bucket a
    window adds the local running sum.  ``inclusive=False`` sums strictly
    earlier rows.  ``order_col`` values should be distinct within a partition
    (aggregate per value first).
    """
    parts = list(partition_cols or [])
    x = F.col(order_col)
    buckets = buckets or max(1024, -(-df.count() // 100_000))
    probs = [i / buckets for i in range(1, buckets)]
    bounds_row = df.agg(F.percentile_approx(x.cast("double"), probs, max(10_000, 4 * buckets)).alias("b")).first()
    bounds = sorted(set(bounds_row["b"] or []))
    src = df.withColumn("_x", x.cast("double"))
    if bounds:
        from pyspark.ml.feature import Bucketizer  # JVM binary search over the bucket bounds
        splits = [-math.inf] + bounds + [math.inf]
        src = Bucketizer(splits=splits, inputCol="_x", outputCol="_bkd", handleInvalid="keep").transform(src)
        src = src.withColumn("_bk", F.col("_bkd").cast("int")).drop("_bkd")
    else:
        src = src.withColumn("_bk", F.lit(0))
    with_b = src.drop("_x")
    totals = with_b.groupBy(*parts, "_bk").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    wo = Window.partitionBy(*parts).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*parts, "_bk", *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}")
                                             for c in value_cols])
    frame_end = 0 if inclusive else -1
    wi = Window.partitionBy(*parts, "_bk").orderBy(x).rowsBetween(Window.unboundedPreceding, frame_end)
    local = with_b.select("*", *[F.coalesce(F.sum(c).over(wi), F.lit(0)).alias(f"_l_{c}") for c in value_cols])
    joined = local.join(offsets, parts + ["_bk"], "left")
    out = joined.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"cum_{c}") for c in value_cols])
    return out


def _score_counts(df: DataFrame, positive: Column, score: str, by: list[str]) -> DataFrame:
    """(by, score, pos, neg) per distinct score, written once to the shared checkpoint folder:
    the bucket bounds, the bucket totals and the running sums all read it, so the prediction
    table is scanned once, and a lost executor does not send the job back to the raw rows."""
    counts = df.groupBy(*by, F.col(score).alias("_s")).agg(
        F.count_if(positive).cast("double").alias("pos"), F.count_if(~positive).cast("double").alias("neg"))
    return written(counts, "scores")


def roc_auc(df: DataFrame, positive: Column, score: str, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Exact ROC AUC with ties counted half (Mann-Whitney), per ``by`` group.

    AUC·P·N = Σ_s pos_s · (negatives scored below s + neg_s / 2).
    """
    by = list(by or [])
    counts = _score_counts(df, positive, score, by)
    cum = prefix_sums(counts, "_s", ["neg"], by, buckets)
    return cum.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"),
        F.sum("pos").cast("long").alias("n_pos"), F.sum("neg").cast("long").alias("n_neg"))


def roc_auc_ovr(long_scores: DataFrame, y: str, cls: str, score: str, buckets: int | None = None) -> DataFrame:
    """One-vs-rest AUC per class (rows: one per (row, class) with that class's score), and the
    support-weighted average as the row with class 'weighted'."""
    per = roc_auc(long_scores, F.col(y) == F.col(cls), score, [cls], buckets)
    w = per.agg(F.lit("weighted").alias(cls), (F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("auc"),
                F.sum("n_pos").alias("n_pos"), F.lit(None).cast("long").alias("n_neg"))
    return per.select(F.col(cls).cast("string").alias(cls), "auc", "n_pos", "n_neg").unionByName(w)


def roc_curve(df: DataFrame, positive: Column, score: str, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, thresholds descending, after the start (infinity, 0, 0)."""
    by = list(by or [])
    counts = _score_counts(df, positive, score, by).withColumn("_neg_s", -F.col("_s"))
    cum = prefix_sums(counts, "_neg_s", ["pos", "neg"], by, buckets, inclusive=True)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if by:
        j = cum.join(totals, by, "inner")
    else:
        t = totals.first()
        j = cum.withColumn("P", F.lit(t["P"])).withColumn("N", F.lit(t["N"]))
    points = j.select(*by, F.col("_s").cast("double").alias("threshold"),
                      F.try_divide(F.col("cum_neg"), F.col("N")).alias("fpr"),
                      F.try_divide(F.col("cum_pos"), F.col("P")).alias("tpr"))
    start = totals.where(F.col("P").isNotNull()).select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points)


def roc_curve_thinned(df: DataFrame, positive: Column, score: str, by: list[str] | None = None) -> DataFrame:
    """``roc_curve`` without the points inside a straight run: a point between two equal steps is left out, as in the
    reference's curve; the first and the last always stay, and the area is the same.

    A point's step is its own counts, so it goes when the next score has the same counts.  Scores are
    range-partitioned; the first row of the next part that holds the group stands for the neighbour over the edge.
    """
    by = list(by or [])
    counts = _score_counts(df, positive, score, by)
    keys = [F.col(c) for c in by]
    cum = prefix_sums(counts.withColumn("_neg_s", -F.col("_s")), "_neg_s", ["pos", "neg"], by, inclusive=True)
    dealt = written(cum.repartitionByRange(*keys, F.asc("_neg_s")).withColumn("_p", F.spark_partition_id()), "curve")
    step = F.struct("pos", "neg")
    heads = dealt.groupBy(*by, "_p").agg(F.min_by(step, "_neg_s").alias("_head"))
    after = heads.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"),
                         F.lead("_head").over(Window.partitionBy(*by).orderBy("_p")).alias("_over"))
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    placed = dealt.withColumn("_next", F.lead(step).over(Window.partitionBy(*by, "_p").orderBy("_neg_s"))).join(after, same)
    following = F.coalesce("_next", "_over")
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    kept = placed.where(first | following.isNull() | (following != step))
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    named = totals.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(by)], "P", "N")
    match = F.lit(True)
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"_t{i}"))
    points = kept.join(F.broadcast(named) if not by else named, match if by else None, "inner").select(
        *by, F.col("_s").cast("double").alias("threshold"), F.try_divide("cum_neg", "N").alias("fpr"), F.try_divide("cum_pos", "P").alias("tpr"))
    start = totals.where(F.col("P").isNotNull()).select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points)


def regression_metrics(df: DataFrame, y: str = "y", y_hat: str = "y_hat", by: list[str] | None = None,
                       msle: bool = True) -> DataFrame:
    """R², MSE, RMSE, MAE, MAPE (fraction), explained variance, MSLE — one aggregation.

    MSLE is null when any value is negative (the log is undefined there).
    """
    e = F.col(y) - F.col(y_hat)
    yy = F.col(y)
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(e) / F.greatest(F.abs(yy), F.lit(MAPE_EPS))).alias("mape"),
        F.var_pop(yy).alias("_vy"),
        F.var_pop(e).alias("_ve"),
    ]
    if msle:
        aggs += [F.avg(F.pow(F.log1p(yy) - F.log1p(F.col(y_hat)), 2)).alias("_msle"),
                 F.least(F.min(yy), F.min(F.col(y_hat))).alias("_min")]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    out = g.select(
        *(by or []), "n",
        (F.lit(1.0) - F.try_divide(F.col("mse"), F.col("_vy"))).alias("r2"),
        "mse", F.sqrt("mse").alias("rmse"), "mae", "mape",
        (F.lit(1.0) - F.try_divide(F.col("_ve"), F.col("_vy"))).alias("explained_variance"),
        *([F.when(F.col("_min") >= 0, F.col("_msle")).alias("msle")] if msle else []))
    return out


def residuals(df: DataFrame, keys: list[str], y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    return df.select(*keys, y, y_hat, (F.col(y) - F.col(y_hat)).alias("residual"))


def pred_vs_actual(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """R² and the diagonal's range (min/max over both columns) for an actual-vs-predicted plot."""
    e = F.col(y) - F.col(y_hat)
    return df.agg(F.count(F.lit(1)).alias("n"),
                  (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
                  F.least(F.min(y), F.min(y_hat)).alias("lo"), F.greatest(F.max(y), F.max(y_hat)).alias("hi"))


def kde_on_bins(df: DataFrame, col: str, grid_points: int = 200, bins: int = 256, cut: float = 3.0) -> DataFrame:
    """Gaussian density curve (Scott bandwidth) evaluated on a grid, from binned counts.

    Rows are reduced to ``bins`` counts first (a partial aggregation); the
    curve is the count-weighted kernel sum over bin centres, so the work
    after the scan is bins × grid_points regardless of the row count.
    """
    x = F.col(col).cast("double")
    st = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd")).first()
    n, lo, hi, sd = st["n"], st["lo"], st["hi"], st["sd"]
    spark = df.sparkSession
    if not n or sd is None or sd == 0.0:
        return spark.createDataFrame([], "grid_x double, density double")
    h = sd * n ** (-1.0 / 5.0)
    width = (hi - lo) / bins if hi > lo else 1.0
    centres = (df.where(x.isNotNull())
               .select(F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int").alias("b"))
               .groupBy("b").agg(F.count(F.lit(1)).alias("c"))
               .select((F.lit(lo) + (F.col("b") + 0.5) * F.lit(width)).alias("centre"), "c"))
    g_lo, g_hi = lo - cut * h, hi + cut * h
    step = (g_hi - g_lo) / (grid_points - 1)
    grid = F.explode(F.array(*[F.lit(g_lo + i * step) for i in range(grid_points)]))
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    z = (F.col("grid_x") - F.col("centre")) / F.lit(h)
    return (centres.select("centre", "c", grid.alias("grid_x"))
            .groupBy("grid_x").agg((F.sum(F.col("c") * F.exp(-0.5 * z * z)) * F.lit(norm)).alias("density")))
