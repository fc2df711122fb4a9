"""Univariate feature scores (ANOVA F, regression F), k-best and recursive elimination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _long_class_sums(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Per (class, feature): n, sum, sum of squares — one aggregation, k rows, then unpivoted."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        aggs += [F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}")]
    per_class = df.groupBy(label).agg(*aggs)
    return per_class.select(label, "n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("ss"))
        for i, c in enumerate(features)])).alias("e")).select(label, "n", "e.*")


def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One-way ANOVA F per feature against a class label: (SSB/(k-1)) / (SSW/(n-k))."""
    g = _long_class_sums(df, features, label)
    tot_n = F.sum("n")
    sq_all = F.pow(F.sum("s"), 2) / tot_n
    ssbn = F.sum(F.col("s") * F.col("s") / F.col("n")) - sq_all
    sstot = F.sum("ss") - sq_all
    sswn = sstot - ssbn
    k = F.count(F.lit(1))
    f = F.try_divide(ssbn / (k - 1), sswn / (tot_n - k))
    return g.groupBy("feature").agg(f.alias("f_score"))


def f_regression(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Univariate regression F per feature: r²/(1-r²)·(n-2), r the Pearson correlation with the target."""
    from haze.operators.stats import pearson
    y = F.col(target).cast("double")
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(features):
        aggs.append(pearson(F.col(c).cast("double"), y).alias(f"r{i}"))
    wide = df.agg(*aggs)
    long = wide.select("n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r")) for i, c in enumerate(features)])).alias("e"))
    r = F.col("e.r")
    f = F.try_divide(r * r, F.lit(1.0) - r * r) * (F.col("n") - F.lit(2))
    return long.select(F.col("e.feature").alias("feature"), f.alias("f_score"))


def top_k(scores: DataFrame, k: int, score: str = "f_score", name: str = "feature") -> DataFrame:
    """The k best-scoring features (ties by name); k = min(k, number of features)."""
    return scores.orderBy(F.desc_nulls_last(score), F.asc(name)).limit(k)


def select_k_best(df: DataFrame, features: list[str], target: str, k: int, task: str = "classification") -> list[str]:
    scores = anova_f(df, features, target) if task == "classification" else f_regression(df, features, target)
    chosen = {r["feature"] for r in top_k(scores, min(k, len(features))).collect()}
    return [c for c in features if c in chosen]


def rfe(df: DataFrame, features: list[str], label: str, k: int, task: str = "classification",
        n_trees: int = 50, max_depth: int = 30, seed: int = 42) -> DataFrame:
    """Recursive feature elimination with a random forest: refit, drop the least important, until k left.

    Each fit is distributed; only the d importances come back, no tree does.
    Returns (feature, ranking) with ranking 1 for kept features, like RFE.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from haze.functions import trees

    cur = list(features)
    ranking: dict[str, int] = {}
    data = df.select(*features, label)
    k = min(k, len(features))
    step_rank = len(features) - k + 1
    while len(cur) > k:
        vec = VectorAssembler(inputCols=cur, outputCol="_features").transform(data)
        if task == "classification":
            est = RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=n_trees,
                                         maxDepth=max_depth, seed=seed, maxMemoryInMB=1024)
        else:
            est = RandomForestRegressor(featuresCol="_features", labelCol=label, numTrees=n_trees,
                                        maxDepth=max_depth, seed=seed, maxMemoryInMB=1024)
        imp = trees.importances(est, vec)
        worst = min(range(len(cur)), key=lambda i: (imp[i], i))
        ranking[cur[worst]] = step_rank
        step_rank -= 1
        cur.pop(worst)
    for c in cur:
        ranking[c] = 1
    return df.sparkSession.createDataFrame([(c, ranking[c]) for c in features], "feature string, ranking int")
