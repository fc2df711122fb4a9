"""Per-group least squares, support-weighted model averaging and linear scoring.

A per-group fit never ships a group's rows anywhere: each group is reduced to its means, variances
and covariances by a partial/final aggregation whose states are centred and mergeable, so a
hot group is combined map-side in every task and an offset as large as an epoch costs no digits.
Only that O(d^2) row per group is solved, all groups of a batch in one stacked numpy call, on centred
and scaled columns; the intercept follows from the means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def sufficient_stats(df: DataFrame, group: str, features: list[str], target: str) -> DataFrame:
    """One row per group: n, means, and the covariances of features and target (rows without gaps)."""
    xs = [F.col(f"`{c}`").cast("double") for c in features]
    y = F.col(f"`{target}`").cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("my")]
    aggs += [F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)]
    aggs += [(F.var_pop(xs[i]) if i == j else F.covar_pop(xs[i], xs[j])).alias(f"c{i}_{j}") for i, j in _pairs(len(xs))]
    aggs += [F.covar_pop(x, y).alias(f"cy{i}") for i, x in enumerate(xs)]
    complete = df.where(F.col(f"`{target}`").isNotNull())
    for c in features:
        complete = complete.where(F.col(f"`{c}`").isNotNull())
    return complete.groupBy(group).agg(*aggs)


def solve_ols(stats: DataFrame, group: str, features: list[str]) -> DataFrame:
    """(group, n, intercept, b_<feature>...) from the statistics table.

    A constant column gets 0; among collinear columns the smallest coefficients are taken.
    """
    d, pairs = len(features), _pairs(len(features))
    gtype = stats.schema[group].dataType.simpleString()
    schema = f"`{group}` {gtype}, n long, intercept double, " + ", ".join(f"`b_{c}` double" for c in features)
    names = ["n", "intercept", *[f"b_{c}" for c in features]]

    def solve(batches):  # self-contained: workers need numpy and pandas alone
        import numpy as np
        import pandas as pd

        for pdf in batches:
            if not len(pdf):
                continue
            cov = np.empty((len(pdf), d, d))
            for i, j in pairs:
                cov[:, i, j] = cov[:, j, i] = pdf[f"c{i}_{j}"]
            cy = pdf[[f"cy{i}" for i in range(d)]].to_numpy(float)
            mean = pdf[[f"m{i}" for i in range(d)]].to_numpy(float)
            scale = np.sqrt(np.einsum("kii->ki", cov))
            flat = ~(scale > 1e-12 * (1 + np.abs(mean)))
            scale[flat] = 1.0
            corr = cov / scale[:, :, None] / scale[:, None, :]
            corr[flat] = 0.0
            corr.transpose(0, 2, 1)[flat] = 0.0
            b = np.einsum("kij,kj->ki", np.linalg.pinv(corr, rcond=1e-10, hermitian=True), np.where(flat, 0.0, cy / scale)) / scale
            out = np.column_stack([pdf["my"].to_numpy(float) - (b * mean).sum(axis=1), b])
            res = pd.DataFrame({group: pdf[group].values, "n": pdf["n"].astype("int64").values})
            for k, name in enumerate(names[1:]):
                res[name] = out[:, k]
            yield res

    return stats.mapInPandas(solve, schema)


def fit_per_group(df: DataFrame, group: str, features: list[str], target: str, min_rows: int = 1) -> DataFrame:
    """Ordinary least squares with intercept per group; groups below ``min_rows`` are skipped."""
    st = sufficient_stats(df, group, features, target).where(F.col("n") >= min_rows)
    return solve_ols(st, group, features)


def average_models(coefs: DataFrame, features: list[str], weight: str = "n") -> DataFrame:
    """Sample-weighted mean of intercepts and coefficients (one row)."""
    w = F.col(weight).cast("double")
    cols = ["intercept"] + [f"b_{c}" for c in features]
    return coefs.agg(*[(F.sum(F.col(f"`{c}`") * w) / F.sum(w)).alias(c) for c in cols], F.sum(weight).alias("n"))


def linear_score(df: DataFrame, model: DataFrame, features: list[str], out: str = "y_hat") -> DataFrame:
    """ŷ = intercept + Σ b_i·x_i; the one-row coefficient table is read back (d+1 numbers) and
    the score is a plain projection with literals (whole-stage codegen, no join)."""
    m = model.select("intercept", *[F.col(f"`b_{c}`") for c in features]).first()
    pred = F.lit(m["intercept"])
    for c in features:
        pred = pred + F.lit(m[f"b_{c}"]) * F.col(f"`{c}`").cast("double")
    return df.withColumn(out, pred)
