"""Cleaning: imputation, outlier cascades, timestamp parsing."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.operators import stats
from haze.operators.quantile import exact_quantiles, number

log = logging.getLogger(__name__)


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill nulls (and NaN) with each column's exact median.

    An integer column that is filled becomes double, since a median may lie between two integers; one
    without missing values keeps its type.
    """
    med = stats.medians(df, cols)
    missing = df.agg(*[F.count_if(number(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]).first() if cols else {}
    holes = {c for i, c in enumerate(cols) if missing[f"m{i}"]}
    return df.select(*[
        F.coalesce(number(c), F.lit(med[c])).alias(c) if c in holes and med[c] is not None else F.col(f"`{c}`")
        for c in df.columns])


def impute_mode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill nulls with each column's most frequent value (tie: smallest)."""
    if not cols:
        return df
    modes = {r["column"]: r["mode"] for r in stats.most_frequent(df, cols).collect()}
    fill = {c: modes[c] for c in cols if modes.get(c) is not None}
    return df.na.fill(fill) if fill else df


def impute_constant(df: DataFrame, cols: list[str], value: str = "missing") -> DataFrame:
    return df.na.fill({c: value for c in cols})


@dataclass
class Fence:
    column: str
    lower: float | None
    upper: float | None
    skipped: bool = False


def remove_outliers_iqr(df: DataFrame, cols: list[str], k: float = 1.5, cascade: bool = True) -> tuple[DataFrame, list[Fence]]:
    """Keep rows inside [Q1 - k·IQR, Q3 + k·IQR], column by column.

    ``cascade=True`` is the reference's order-dependent rule: each column's
    quartiles are taken on the rows still left after the columns before it
    (a few small jobs per column; the filters stack up in one plan
    and the scan prunes to the numeric columns).  ``cascade=False`` takes all
    fences from the input in a single job.
    """
    fences: list[Fence] = []
    cur = df
    if not cascade:
        for c, (q1, q3) in exact_quantiles(df, cols, [0.25, 0.75]).items():
            fences.append(_iqr_fence(c, q1, q3, k))
        for f in fences:
            cur = cur.where(F.col(f.column).between(F.lit(f.lower), F.lit(f.upper)))
        return cur, fences
    for c in cols:
        f = _iqr_fence(c, *exact_quantiles(cur, [c], [0.25, 0.75])[c], k)
        fences.append(f)
        if f.lower is None:
            cur = cur.where(F.lit(False))
        else:
            cur = cur.where(F.col(c).between(F.lit(f.lower), F.lit(f.upper)))
    return cur, fences


def _iqr_fence(c: str, q1, q3, k: float) -> Fence:
    if q1 is None or q3 is None:
        return Fence(c, None, None)
    iqr = q3 - q1
    return Fence(c, q1 - k * iqr, q3 + k * iqr)


def remove_outliers_zscore(df: DataFrame, cols: list[str], threshold: float = 3.0,
                           cascade: bool = True) -> tuple[DataFrame, list[Fence]]:
    """Keep rows with |x - mean| / std_pop < threshold, column by column.

    A constant column (std 0) has no z-score; it is skipped instead of
    dropping every row.
    """
    fences: list[Fence] = []
    cur = df
    if not cascade:
        wide = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))]).first()
        moments = [(c, wide[f"{c}__m"], wide[f"{c}__s"]) for c in cols]
    for i, c in enumerate(cols):
        if cascade:
            r = cur.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).first()
            m, s = r["m"], r["s"]
        else:
            _, m, s = moments[i]
        if m is None or s is None or s == 0.0:
            fences.append(Fence(c, None, None, skipped=True))
            continue
        fences.append(Fence(c, m - threshold * s, m + threshold * s))
        cur = cur.where(F.abs((F.col(c) - F.lit(m)) / F.lit(s)) < F.lit(threshold))
    return cur, fences


def remove_outliers(df: DataFrame, cols: list[str], method: str = "iqr", **kw) -> tuple[DataFrame, list[Fence]]:
    if method == "iqr":
        return remove_outliers_iqr(df, cols, **kw)
    if method == "zscore":
        return remove_outliers_zscore(df, cols, **kw)
    raise ValueError(f"Unknown outlier method {method!r} (use 'iqr' or 'zscore')")


def removal_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before/after, removed, and percent of the start."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    both = n(before, "n_before").join(n(after, "n_after"))  # two one-row tables
    return both.select("n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed"),
                       F.try_divide((F.col("n_before") - F.col("n_after")) * F.lit(100.0), F.col("n_before")).alias("pct_removed"))


def parse_timestamp(df: DataFrame, col: str, fmt: str | None = None, strict: bool = True) -> DataFrame:
    """Parse a string column into a timestamp; ``strict=False`` yields null for bad values."""
    if strict:
        parsed = F.to_timestamp(F.col(col), fmt) if fmt else F.to_timestamp(F.col(col))
    else:
        parsed = F.try_to_timestamp(F.col(col), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(col))
    return df.withColumn(col, parsed)
