"""Kernel regression with the epsilon-insensitive loss, many problems per scan.

The kernel exp(-gamma |x - x'|^2) is represented by landmarks (Nystroem): z(x) = K(x, L) K(L, L)^(-1/2).  Landmarks are
rows drawn by ridge leverage scores from ``POOL`` training rows (the ones with the smallest hash; both numbers are bounds on
what the driver holds).  With every training row a landmark, z gives the kernel exactly.

Objective: |w|^2 / 2 + C sum max(0, |y - w z - b| - epsilon), b unpenalised.  It is solved by iteratively reweighted least squares:
either side of the loss lies below a parabola that touches it, so each step solves a weighted ridge problem and the
objective never rises but by the smoothing of the corners, which shrinks to ``CORNER`` times the spread of y.  One scan
adds up the weighted Gram matrices of all problems (a problem is one point of a grid and the fold it leaves out), a block
per task; the driver solves systems whose size depends on landmarks only.

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

from haze.functions.logistic import arrays, scaled
from haze.session import ship_package

BLOCK = 1 << 22
POOL, LANDMARKS = 2000, 100
CORNER = 1e-4
TOL, MAX_SCANS = 1e-4, 80
SCALE, AUTO = 0.0, -1.0  # widths taken from the data: 1 / (d var(x)) and 1 / d


@dataclass(frozen=True)
class Problem:
    """A regression on the rows outside ``fold`` (-1: all rows)."""
    c: float = 1.0
    epsilon: float = 0.1
    gamma: float = SCALE
    fold: int = -1


@dataclass
class Map:
    """Landmarks (scaled) of one width and fold, and the root that makes kernel values coordinates."""
    gamma: float
    landmarks: np.ndarray
    root: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([kernel(x, self.landmarks, self.gamma) @ self.root, np.ones(len(x))])


@dataclass
class Fitted:
    map: Map
    weights: np.ndarray  # of the coordinates and, last, the constant

    @property
    def coefficients(self) -> np.ndarray:
        """One per landmark: f(x) = K(x, L) coefficients + intercept."""
        return self.map.root @ self.weights[:-1]

    @property
    def intercept(self) -> float:
        return float(self.weights[-1])


def kernel(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    apart = (x ** 2).sum(axis=1)[:, None] + (y ** 2).sum(axis=1)[None, :] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(apart, 0.0))


def _summed(rows: DataFrame, scan, kind: str = "problem") -> dict[int, np.ndarray]:
    """Sums by number of the vectors that ``scan`` yields as (number, values)."""
    def batches(parts):
        total = scan(parts)
        values = [np.asarray(v, float) for v in total.values()]
        ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
        flat = np.concatenate(values) if values else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                         [kind, "values"])

    found = rows.select("x", "label", "fold").mapInArrow(batches, f"{kind} int, values array<double>").groupBy(kind).agg(
        Summarizer.sum(array_to_vector("values")).alias("s")).select(kind, vector_to_array("s").alias("s")).toArrow()
    return {i: np.array(s.values) for i, s in zip(found[kind].to_pylist(), found["s"])}


def _spreads(rows: DataFrame, d: int, folds: list[int], scalings: dict) -> dict[int, tuple[float, float]]:
    """Variance of all scaled values and of y without each fold."""
    def scan(batches):
        total = {f: np.zeros(6) for f in folds}
        for batch in batches:
            x_all, label, fold = arrays(batch, d)
            for f in folds:
                x, y = scaled(x_all[fold != f], scalings.get(f))[:, :-1], label[fold != f]
                total[f] += [x.size, x.sum(), (x ** 2).sum(), len(y), y.sum(), (y ** 2).sum()]
        return total

    spread = lambda n, a, b: max(b / max(n, 1) - (a / max(n, 1)) ** 2, 0.0)
    return {f: (spread(*s[:3]), spread(*s[3:])) for f, s in _summed(rows, scan).items()}


def _map(pool: np.ndarray, gamma: float, landmarks: int, seed: int) -> Map:
    """Landmarks drawn without replacement, with odds by their ridge leverage in the pool."""
    if len(pool) > landmarks:
        k = kernel(pool, pool, gamma)
        ridge = max(np.trace(k) / landmarks * 1e-3, 1e-9)
        leverage = 1.0 - ridge * np.diag(np.linalg.inv(k + ridge * np.eye(len(pool))))
        draw = np.log(np.maximum(leverage, 1e-12)) + np.random.default_rng(seed).gumbel(size=len(pool))
        pool = pool[np.sort(np.argsort(-draw, kind="stable")[:landmarks])]
    value, vector = np.linalg.eigh(kernel(pool, pool, gamma))
    root = np.where(value > value.max(initial=0.0) * 1e-10, 1.0 / np.sqrt(np.maximum(value, 1e-300)), 0.0)
    return Map(gamma, pool, (vector * root) @ vector.T)


def fit_many(rows: DataFrame, d: int, problems: list[Problem], scalings: dict | None = None, landmarks: int = LANDMARKS, seed: int = 42,
             pool: int = POOL, tol: float = TOL, max_scans: int = MAX_SCANS) -> list[Fitted]:
    """Solutions of all problems.  ``rows``: x (array of d doubles), label, fold (int).  ``scalings``: per excluded fold the
    (centres, divisors) fitted without it.  A problem ends when a step lowers its objective by less than ``tol`` of it."""
    ship_package(rows.sparkSession)
    scalings = scalings or {}
    folds = sorted({q.fold for q in problems})
    spreads = _spreads(rows, d, folds, scalings)
    first = rows.select("x", "fold").orderBy(F.xxhash64("x", F.lit(seed)), "x", "fold").limit(max(pool, landmarks)).collect()
    x, at = np.array([r["x"] for r in first], float).reshape(-1, d), np.array([r["fold"] for r in first], int)
    maps: dict[tuple[int, float], Map] = {}
    for f, g in {(q.fold, q.gamma) for q in problems}:
        width = 1.0 / d if g < 0 else g or 1.0 / (d * (spreads.get(f, (0.0, 0.0))[0] or 1.0))
        own = np.unique(scaled(x[at != f], scalings.get(f))[:, :-1], axis=0)
        if not len(own):
            raise ValueError("no rows to fit on")
        maps[f, g] = _map(own, width, landmarks, seed)
    most = max(1, BLOCK // ((landmarks + 1) * (landmarks + 4) // 2 + 2))
    return [s for a in range(0, len(problems), most) for s in _fit_block(rows, d, problems[a:a + most], scalings, maps, spreads, tol, max_scans)]


def _steps(rows, d, problems, scalings, maps, weights, corner, live):
    """Loss, weighted Gram matrix and right side of each live problem at its weights: one scan."""
    groups: dict[tuple[int, float], list[int]] = {}
    for i in live:
        groups.setdefault((problems[i].fold, problems[i].gamma), []).append(i)
    size = {key: m.root.shape[1] + 1 for key, m in maps.items()}

    def scan(batches):
        total = {}
        for key, members in groups.items():
            p = size[key]
            total |= {i: np.zeros(1 + p + p * (p + 1) // 2) for i in members}
        for batch in batches:
            x_all, label, fold = arrays(batch, d)
            for key, members in groups.items():
                use, p = fold != key[0], size[key]
                z, y, upper = maps[key](scaled(x_all[use], scalings.get(key[0]))[:, :-1]), label[use], np.triu_indices(p)
                for i in members:
                    e, r = problems[i].epsilon, y - z @ weights[i]
                    over, under = 0.25 / np.maximum(np.abs(r - e), corner[i]), 0.25 / np.maximum(np.abs(r + e), corner[i])
                    s = total[i]
                    s[0] += np.maximum(np.abs(r) - e, 0.0).sum()
                    s[1:1 + p] += ((over + under) * y + e * (under - over)) @ z
                    root = z * np.sqrt(over + under)[:, None]  # a product with itself: half the work of two matrices
                    s[1 + p:] += (root.T @ root)[upper]
        return total

    out = {}
    for i, s in _summed(rows, scan).items():
        p = len(weights[i])
        gram = np.zeros((p, p))
        gram[np.triu_indices(p)] = s[1 + p:]
        out[i] = s[0], gram + np.triu(gram, 1).T, s[1:1 + p]
    return out


def _fit_block(rows, d, problems, scalings, maps, spreads, tol, max_scans) -> list[Fitted]:
    own = [maps[q.fold, q.gamma] for q in problems]
    weights = [np.zeros(m.root.shape[1] + 1) for m in own]
    spread = [max(spreads[q.fold][1] ** 0.5, 1e-12) for q in problems]
    corner = list(spread)
    best, value = [w.copy() for w in weights], [np.inf] * len(problems)
    live = list(range(len(problems)))
    for _ in range(max_scans):
        found, still = _steps(rows, d, problems, scalings, maps, weights, corner, live), []
        for i in live:
            loss, gram, side = found[i]
            q, w = problems[i], weights[i]
            now = (w[:-1] ** 2).sum() / 2 + q.c * loss
            settled = corner[i] <= CORNER * spread[i] * 1.001 and now >= value[i] - tol * abs(value[i])
            if now < value[i]:
                best[i], value[i] = w, now
            if settled:
                continue
            ridge = np.ones(len(w))
            ridge[-1] = 1e-12
            weights[i] = np.linalg.solve(np.diag(ridge) + 2 * q.c * gram, 2 * q.c * side)
            corner[i] = max(corner[i] / 4, CORNER * spread[i])
            still.append(i)
        live = still
        if not live:
            break
    return [Fitted(m, w) for m, w in zip(own, best)]


def squared_errors(rows: DataFrame, d: int, models: list[tuple[int, Fitted]], scalings: dict) -> np.ndarray:
    """Mean squared error of each (fold, model) on the rows of its fold: one scan."""
    def scan(batches):
        total = np.zeros((len(models), 2))
        for batch in batches:
            x_all, label, fold = arrays(batch, d)
            for f in {f for f, _ in models}:
                x, y, z = scaled(x_all[fold == f], scalings.get(f))[:, :-1], label[fold == f], {}
                for i, (at, m) in enumerate(models):
                    if at == f:
                        if id(m.map) not in z:
                            z[id(m.map)] = m.map(x)
                        total[i] += len(y), ((y - z[id(m.map)] @ m.weights) ** 2).sum()
        return {0: total.ravel()}

    s = _summed(rows, scan)[0].reshape(len(models), 2)
    return s[:, 1] / np.maximum(s[:, 0], 1)


class _KernelParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "target", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label")


class KernelRegression(Estimator, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """One epsilon-insensitive kernel regression."""

    c = Param(Params._dummy(), "c", "weight of the loss", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "errors up to this cost nothing", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel width; 0 means 1/(d var(x)), below 0 1/d", TypeConverters.toFloat)
    landmarks = Param(Params._dummy(), "landmarks", "most landmarks", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, c=1.0, epsilon=0.1, gamma=SCALE, landmarks=LANDMARKS, seed=42):
        super().__init__()
        self._setDefault(c=1.0, epsilon=0.1, gamma=SCALE, landmarks=LANDMARKS, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "KernelRegressionModel":
        rows = df.select(vector_to_array(self.getOrDefault(self.featuresCol)).alias("x"),
                         F.col(self.getOrDefault(self.labelCol)).cast("double").alias("label"), F.lit(0).alias("fold"))
        head = rows.first()
        if head is None:
            raise ValueError("no rows to fit on")
        own = Problem(*[self.getOrDefault(p) for p in (self.c, self.epsilon, self.gamma)])
        found, = fit_many(rows, len(head["x"]), [own], landmarks=self.getOrDefault(self.landmarks), seed=self.getOrDefault(self.seed))
        return self._copyValues(KernelRegressionModel(width=found.map.gamma, intercept=found.intercept,
                                                      coefficients=[float(v) for v in found.coefficients],
                                                      points=[float(v) for v in found.map.landmarks.ravel()]))


class KernelRegressionModel(Model, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Predicts with built-in array functions, in the JVM."""

    width = Param(Params._dummy(), "width", "gamma of the kernel", TypeConverters.toFloat)
    intercept = Param(Params._dummy(), "intercept", "added to the sum", TypeConverters.toFloat)
    coefficients = Param(Params._dummy(), "coefficients", "one per landmark", TypeConverters.toListFloat)
    points = Param(Params._dummy(), "points", "landmarks, one after another", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, width=1.0, intercept=0.0, coefficients=None, points=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        flat, coefficients = self.getOrDefault(self.points), self.getOrDefault(self.coefficients)
        d, gamma = len(flat) // len(coefficients), self.getOrDefault(self.width)
        x = vector_to_array(self.getOrDefault(self.featuresCol))
        landmarks = F.lit([flat[a:a + d] for a in range(0, len(flat), d)])
        apart = lambda point: F.aggregate(F.zip_with("_x", point, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        near = F.zip_with(landmarks, F.lit(coefficients), lambda p, c: c * F.exp(F.lit(-gamma) * apart(p)))
        return df.withColumn("_x", x).withColumn("prediction", F.aggregate(
            near, F.lit(self.getOrDefault(self.intercept)), lambda s, v: s + v)).drop("_x")
