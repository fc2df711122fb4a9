"""Logistic regression, many problems per scan.

A problem is one (class against the rest, penalty, excluded fold).  All problems of a grid search are fitted together:
one scan of the rows gathers loss, gradient and curvature of every problem, one small block per task, added up
by Spark; the driver then takes one proximal Newton step per problem on numbers whose count depends
on features and problems only.  A step that does not lower its objective enough is halved at the next scan.  A scan
costs one pass over the data whatever the number of problems, and about fifteen scans end a search.

Objective: mean log-loss + penalty / (C n), the penalty being the sum of absolute values (l1) or half the sum of
squares (l2).  The intercept is the weight of a constant column and penalised like the others, as in
the reference's solver.  More than two classes are one against the rest; class probabilities are the normalised logistic scores.

``BLOCK`` bounds the numbers a task holds for its problems; larger sets of problems are run in turns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.session import ship_package

BLOCK = 1 << 22
ROWS = 2048  # products of features held at a time
TOL, MAX_SCANS = 1e-6, 100


@dataclass(frozen=True)
class Problem:
    """Class ``code`` against the rest on the rows outside ``fold`` (-1: all rows)."""
    code: int
    c: float = 1.0
    l1: bool = False
    fold: int = -1


def scaled(x: np.ndarray, scaling) -> np.ndarray:
    """The scaled columns and the constant column."""
    if scaling is not None:
        centre, scale = (np.asarray(v, float) for v in scaling)
        flat = scale == 0
        x = np.where(flat, 0.0, (x - centre) / np.where(flat, 1.0, scale))
    return np.column_stack([x, np.ones(len(x))])


def arrays(batch: pa.RecordBatch, d: int):
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return x, batch.column("label").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)


def _measures(rows: DataFrame, d: int, problems: list[Problem], scalings: dict, weights: np.ndarray, live: np.ndarray):
    """Rows, loss, gradient and curvature (sums) of each live problem at its weights: one scan."""
    p = d + 1
    upper = np.triu_indices(p)
    by_fold: dict[int, list[int]] = {}
    for i in np.flatnonzero(live).tolist():
        by_fold.setdefault(problems[i].fold, []).append(i)

    def scan(batches):
        total = {i: np.zeros(2 + p + len(upper[0])) for i in np.flatnonzero(live).tolist()}
        for batch in batches:
            x_all, label, fold = arrays(batch, d)
            for f, members in by_fold.items():
                use = fold != f
                x, y = scaled(x_all[use], scalings.get(f)), label[use]
                target = y[:, None] == np.array([problems[i].code for i in members])[None, :]
                z = x @ weights[members].T
                loss = np.logaddexp(0.0, np.where(target, -z, z)).sum(axis=0)
                prob = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                slope = (prob - target).T @ x
                bend = np.zeros((len(members), len(upper[0])))
                for a in range(0, len(y), ROWS):
                    part, q = x[a:a + ROWS], prob[a:a + ROWS]
                    # products of features once for all problems: one matrix product instead of one per problem
                    bend += (q * (1.0 - q)).T @ (part[:, upper[0]] * part[:, upper[1]])
                for k, i in enumerate(members):
                    total[i][0] += len(y)
                    total[i][1] += loss[k]
                    total[i][2:2 + p] += slope[k]
                    total[i][2 + p:] += bend[k]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
                                         ["problem", "values"])

    parts = rows.select("x", "label", "fold").mapInArrow(scan, "problem int, values array<double>")
    found = parts.groupBy("problem").agg(Summarizer.sum(array_to_vector("values")).alias("s")).select(
        "problem", vector_to_array("s").alias("s")).collect()
    n, loss = np.zeros(len(problems)), np.zeros(len(problems))
    slope, bend = np.zeros((len(problems), p)), np.zeros((len(problems), p, p))
    for r in found:
        i, s = r["problem"], np.array(r["s"])
        n[i], loss[i], slope[i] = s[0], s[1], s[2:2 + p]
        h = np.zeros((p, p))
        h[upper] = s[2 + p:]
        bend[i] = h + np.triu(h, 1).T
    return n, loss, slope, bend


def _newton_points(w, g, h, l1, l2, sweeps: int = 400) -> np.ndarray:
    """Minimum of each problem's quadratic model plus penalty, coordinate by coordinate for all problems at once."""
    u = w.copy()
    ridge = l2 > 0
    if ridge.any():
        eye = np.eye(w.shape[1])
        a = h[ridge] + l2[ridge][:, None, None] * eye
        b = np.einsum("mij,mj->mi", h[ridge], w[ridge]) - g[ridge]
        u[ridge] = np.linalg.solve(a, b[:, :, None])[:, :, 0]
    rest = np.flatnonzero(~ridge)
    if len(rest):
        v, hr, lam = w[rest].copy(), h[rest], l1[rest]
        base = np.einsum("mij,mj->mi", hr, v) - g[rest]
        diag = np.maximum(np.einsum("mii->mi", hr), 1e-12)
        for _ in range(sweeps):
            before = v.copy()
            for j in range(v.shape[1]):
                r = base[:, j] - np.einsum("mk,mk->m", hr[:, j], v) + diag[:, j] * v[:, j]
                v[:, j] = np.sign(r) * np.maximum(np.abs(r) - lam, 0.0) / diag[:, j]
            if np.abs(v - before).max() <= 1e-10 * max(1.0, np.abs(v).max()):
                break
        u[rest] = v
    return u


def fit_many(rows: DataFrame, d: int, problems: list[Problem], scalings: dict | None = None, tol: float = TOL,
             max_scans: int = MAX_SCANS) -> np.ndarray:
    """Weights (problems x (d + 1), the last one the intercept) of all problems.

    ``rows``: x (array of d doubles), label, fold (int).  ``scalings``: per excluded fold the (centres, divisors)
    fitted without it.  Ends when every problem's smallest subgradient is below ``tol`` of its first one.
    """
    ship_package(rows.sparkSession)
    most = max(1, BLOCK // ((d + 1) * (d + 4) // 2 + 2))
    return np.concatenate([_fit_block(rows, d, problems[a:a + most], scalings or {}, tol, max_scans)
                           for a in range(0, len(problems), most)])


def _fit_block(rows, d, problems, scalings, tol, max_scans):
    m, p = len(problems), d + 1
    w, trial = np.zeros((m, p)), np.zeros((m, p))
    best = np.full(m, np.inf)
    step, along, move = np.ones(m), np.zeros(m), np.zeros((m, p))
    first, live = None, np.ones(m, bool)
    lasso = np.array([q.l1 for q in problems])
    slope, bend = np.zeros((m, p)), np.zeros((m, p, p))
    for _ in range(max_scans):
        n, loss, g, h = _measures(rows, d, problems, scalings, trial, live)
        n = np.maximum(n, 1.0)
        lam = np.array([1.0 / q.c for q in problems]) / n
        l1, l2 = np.where(lasso, lam, 0.0), np.where(lasso, 0.0, lam)
        value = loss / n + l1 * np.abs(trial).sum(axis=1) + l2 / 2 * (trial ** 2).sum(axis=1)
        good = live & ((value <= best + 1e-4 * step * along + 1e-13 * np.abs(value)) | (step < 1e-8))
        w[good], best[good] = trial[good], value[good]
        slope[good], bend[good] = (g / n[:, None])[good], (h / n[:, None, None])[good]
        smooth = slope + l2[:, None] * w
        least = np.where(w != 0, smooth + l1[:, None] * np.sign(w), np.sign(smooth) * np.maximum(np.abs(smooth) - l1[:, None], 0.0))
        size = np.abs(least).max(axis=1)
        first = np.maximum(size, 1e-12) if first is None else first
        live &= ~(good & ((size <= tol * first) | (step < 1e-8)))
        if not live.any():
            break
        new = good & live
        if new.any():
            u = _newton_points(w[new], slope[new], bend[new], l1[new], l2[new])
            move[new] = u - w[new]
            along[new] = ((slope[new] * move[new]).sum(axis=1) + l1[new] * (np.abs(u).sum(axis=1) - np.abs(w[new]).sum(axis=1))
                          + l2[new] / 2 * ((u ** 2).sum(axis=1) - (w[new] ** 2).sum(axis=1)))
            step[new] = 1.0
        back = live & ~good
        step[back] /= 2
        trial = np.where(live[:, None], w + step[:, None] * move, w)
    return w


def _codes(n_classes: int) -> list[int]:
    return [1] if n_classes == 2 else list(range(n_classes))


def confusions(rows: DataFrame, d: int, n_classes: int, models: list[tuple[int, np.ndarray]], scalings: dict) -> np.ndarray:
    """Confusion matrices (model, true, predicted) of each (fold, class weights) on the rows of its fold: one scan."""
    def scan(batches):
        total = np.zeros((len(models), n_classes, n_classes))
        for batch in batches:
            x_all, label, fold = arrays(batch, d)
            for f in {f for f, _ in models}:
                use = fold == f
                x, y = scaled(x_all[use], scalings.get(f)), label[use].astype(int)
                for i, (at, w) in enumerate(models):
                    if at == f:
                        z = x @ w.T
                        guess = (z[:, 0] > 0).astype(int) if n_classes == 2 else z.argmax(axis=1)
                        np.add.at(total[i], (y, guess), 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["values"])

    found = rows.select("x", "label", "fold").mapInArrow(scan, "values array<double>").agg(
        Summarizer.sum(array_to_vector("values")).alias("s")).select(vector_to_array("s").alias("s")).first()
    return np.array(found["s"]).reshape(len(models), n_classes, n_classes)


def weighted_f1(confusion: np.ndarray) -> float:
    support, predicted, hit = confusion.sum(axis=1), confusion.sum(axis=0), np.diag(confusion)
    f1 = 2 * hit / np.maximum(support + predicted, 1)
    return float((f1 * support).sum() / max(support.sum(), 1))


class _LogisticParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "class codes from 0", TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "number of classes", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", numClasses=2)


class OneVsRestLogistic(Estimator, _LogisticParams, DefaultParamsReadable, DefaultParamsWritable):
    """One logistic problem per class (one in all for two classes), fitted together."""

    c = Param(Params._dummy(), "c", "inverse strength of the penalty", TypeConverters.toFloat)
    l1 = Param(Params._dummy(), "l1", "sum of absolute values instead of squares", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, numClasses=2, c=1.0, l1=False):
        super().__init__()
        self._setDefault(c=1.0, l1=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "OneVsRestLogisticModel":
        rows = df.select(vector_to_array(self.getOrDefault(self.featuresCol)).alias("x"),
                         F.col(self.getOrDefault(self.labelCol)).alias("label"), F.lit(0).alias("fold"))
        head = rows.first()
        if head is None:
            raise ValueError("no rows to fit on")
        k = self.getOrDefault(self.numClasses)
        w = fit_many(rows, len(head["x"]), [Problem(i, self.getOrDefault(self.c), self.getOrDefault(self.l1)) for i in _codes(k)])
        return self._copyValues(model_of(w, k))


class OneVsRestLogisticModel(Model, _LogisticParams, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "one row after another", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, numClasses=2, weights=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def coefficientMatrix(self):
        from pyspark.ml.linalg import DenseMatrix

        w = self._matrix()[:, :-1]
        return DenseMatrix(*w.shape, w.ravel(order="F"))

    def _matrix(self) -> np.ndarray:
        w = np.array(self.getOrDefault(self.weights))
        return w.reshape(len(_codes(self.getOrDefault(self.numClasses))), -1)

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(self.getOrDefault(self.featuresCol))
        add = lambda w: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w[:-1]]), lambda a, b: a * b),
                                    F.lit(float(w[-1])), lambda s, v: s + v)
        z = [add(w) for w in self._matrix()]
        logistic = lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v))
        out = df.withColumn("_z", F.array(*([-z[0], z[0]] if len(z) == 1 else z)))
        out = out.withColumn("_p", F.transform("_z", logistic))
        whole = F.aggregate("_p", F.lit(0.0), lambda s, v: s + v)
        best = (F.array_position("_z", F.array_max("_z")) - 1).cast("double")
        # scores that are all zero in double precision are shared equally
        share = F.when(whole > 0, F.transform("_p", lambda v: v / whole)).otherwise(F.transform("_p", lambda v: F.lit(1.0) / F.size("_p")))
        if len(z) == 1:
            best = (F.col("_z")[1] > 0).cast("double")
        return out.withColumns({"rawPrediction": array_to_vector("_z"), "probability": array_to_vector(share), "prediction": best}).drop("_z", "_p")


def model_of(weights: np.ndarray, n_classes: int) -> OneVsRestLogisticModel:
    return OneVsRestLogisticModel(numClasses=n_classes, weights=[float(v) for v in weights.ravel()])
