"""Exact column scalers as Spark ML Estimator/Model pairs.

Spark's own scalers differ from the reference's rules: ``StandardScaler``
uses the sample std, ``RobustScaler`` approximate quantiles and no
centring, ``MinMaxScaler`` maps a constant column to 0.5.  These stages
keep the reference's rules:

* standard: (x - mean) / std_pop, std 0 -> divide by 1
* robust:   (x - median) / (Q3 - Q1), IQR 0 -> divide by 1
* minmax:   (x - min) / (max - min), range 0 -> 0

``fit`` covers all columns in the same jobs; ``transform`` is a plain
projection (codegen, no Python).  Both are saveable inside a
``PipelineModel`` (params are plain JSON lists).
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.operators.quantile import exact_quantiles

METHODS = ("standard", "robust", "minmax")


class _ScalerParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to scale (in place)", TypeConverters.toListString)
    method = Param(Params._dummy(), "method", "standard | robust | minmax", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(method="standard")

    def getInputCols(self):
        return self.getOrDefault(self.inputCols)

    def getMethod(self):
        return self.getOrDefault(self.method)


class ExactScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, method="standard"):
        super().__init__()
        kwargs = self._input_kwargs
        self._set(**kwargs)

    @keyword_only
    def setParams(self, *, inputCols=None, method="standard"):
        return self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ExactScalerModel":
        cols, method = self.getInputCols(), self.getMethod()
        if method not in METHODS:
            raise ValueError(f"unknown scaling method {method!r}; use one of {METHODS}")
        centers, scales = fit_scaling(df, cols, method)
        model = ExactScalerModel(inputCols=cols, method=method, centers=centers, scales=scales)
        return self._copyValues(model)


class ExactScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    centers = Param(Params._dummy(), "centers", "per-column centre", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "per-column divisor", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, method="standard", centers=None, scales=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return apply_scaling(df, self.getInputCols(), self.getOrDefault(self.centers),
                             self.getOrDefault(self.scales))


def fit_scaling(df: DataFrame, cols: list[str], method: str) -> tuple[list[float], list[float]]:
    """(centres, divisors) per column, all columns in the same jobs."""
    if not cols:
        return [], []
    if method == "robust":
        found = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
        row = {k: v for i, c in enumerate(cols) for q1, q2, q3 in [found[c]]
               for k, v in ((f"{i}__a", q2), (f"{i}__b", None if q2 is None else q3 - q1))}
        return _pairs(row, cols, method)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        if method == "standard":
            aggs += [F.avg(x).alias(f"{i}__a"), F.stddev_pop(x).alias(f"{i}__b")]
        elif method == "minmax":
            aggs += [F.min(x).alias(f"{i}__a"), (F.max(x) - F.min(x)).alias(f"{i}__b")]
        else:
            raise ValueError(f"unknown scaling method {method!r}")
    return _pairs(df.agg(*aggs).first(), cols, method)


def fold_scalings(df: DataFrame, cols: list[str], method: str, fold: str, folds: int) -> dict[int, tuple[list[float], list[float]]]:
    """The scaling fitted without each fold, all folds in the same jobs."""
    names = [f"f{f}c{i}" for f in range(folds) for i in range(len(cols))]
    wide = df.select(*[F.when(F.col(fold) != f, F.col(f"`{c}`").cast("double")).alias(f"f{f}c{i}")
                       for f in range(folds) for i, c in enumerate(cols)])
    centres, scales = fit_scaling(wide, names, method)
    d = len(cols)
    return {f: (centres[f * d:(f + 1) * d], scales[f * d:(f + 1) * d]) for f in range(folds)}


def _pairs(row, cols: list[str], method: str) -> tuple[list[float], list[float]]:
    centers, scales = [], []
    for i in range(len(cols)):
        a, b = row[f"{i}__a"], row[f"{i}__b"]
        centers.append(float(a) if a is not None else 0.0)
        if method == "minmax":
            scales.append(float(b) if b not in (None, 0.0) else 0.0)
        else:
            scales.append(float(b) if b not in (None, 0.0) else 1.0)
    return centers, scales


def apply_scaling(df: DataFrame, cols: list[str], centers: list[float], scales: list[float]) -> DataFrame:
    """(x - centre) / divisor in place; a zero divisor (min-max on a constant) gives 0."""
    spec = {c: (m, s) for c, m, s in zip(cols, centers, scales)}
    out = []
    for c in df.columns:
        if c in spec:
            m, s = spec[c]
            if s == 0.0:
                out.append(F.when(F.col(f"`{c}`").isNotNull(), F.lit(0.0)).alias(c))
            else:
                out.append(((F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def scale(df: DataFrame, cols: list[str], method: str = "standard") -> DataFrame:
    """Fit on ``df`` and apply to it (fit on train + apply elsewhere: use ExactScaler)."""
    centers, scales = fit_scaling(df, cols, method)
    return apply_scaling(df, cols, centers, scales)
