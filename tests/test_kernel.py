"""Epsilon-insensitive kernel regression against the exact dual, solved in numpy."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler

from haze.functions import kernel as K


def exact(k, y, c, eps, rounds=5000):
    """Dual variables and intercept by ADMM: min b'Kb/2 - y'b + eps |b|_1, sum b = 0, |b| <= c."""
    n, rho = len(y), 1.0
    g, u = np.zeros(n), np.zeros(n)
    inv = np.linalg.inv(np.block([[k + rho * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]]))
    for _ in range(rounds):
        s = inv @ np.append(y + rho * (g - u), 0.0)
        b, intercept, before = s[:-1], s[-1], g
        v = b + u
        g = np.clip(np.sign(v) * np.maximum(np.abs(v) - eps / rho, 0.0), -c, c)
        u = u + b - g
        if max(np.abs(b - g).max(), np.abs(g - before).max()) < 1e-6:
            break
    return g, intercept


def primal(k, y, a, b, c, eps):
    return a @ k @ a / 2 + c * np.maximum(np.abs(y - k @ a - b) - eps, 0).sum()


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 500
    x = rng.normal(size=(n, 3)) * [1, 2, 0.5] + [0, 3, 1]
    y = np.sin(x[:, 0] * 2) * 3 + x[:, 1] + rng.laplace(scale=0.3, size=n)
    fold = rng.integers(0, 3, n)
    rows = [(v.tolist(), float(t), int(f)) for v, t, f in zip(x, y, fold)]
    return x, y, fold, spark.createDataFrame(rows, "x array<double>, label double, fold int").repartition(3)


def test_all_rows_as_landmarks_give_the_exact_regression(table):
    x, y, _, df = table
    points = [(0.1, 0.5), (1.0, 0.1), (10.0, 0.2)]
    found = K.fit_many(df, 3, [K.Problem(c, eps, 0.1) for c, eps in points], landmarks=500, tol=1e-7, max_scans=40)
    k = K.kernel(x, x, 0.1)
    for (c, eps), got in zip(points, found):
        a, b = exact(k, y, c, eps)
        order = np.lexsort(got.map.landmarks.T[::-1])
        mine = np.zeros(len(x))
        mine[np.lexsort(x.T[::-1])] = got.coefficients[order]
        assert primal(k, y, mine, got.intercept, c, eps) <= primal(k, y, a, b, c, eps) * 1.003
        assert np.abs(k @ mine + got.intercept - (k @ a + b)).max() < 0.1 * y.std()


def test_landmarks_come_near_the_exact_regression(table):
    """100 landmarks of 500 rows: predictions differ by less than 2 % of the spread of y (root mean square)."""
    x, y, _, df = table
    got, = K.fit_many(df, 3, [K.Problem(1.0, 0.1)])
    k = K.kernel(x, x, 1 / (3 * x.var()))
    a, b = exact(k, y, 1.0, 0.1)
    mine = got.map(x) @ got.weights
    assert ((mine - k @ a - b) ** 2).mean() ** 0.5 < 0.02 * y.std()


def test_shared_scans_equal_single_fits(table):
    x, y, fold, df = table
    scalings = {f: (x[fold != f].mean(axis=0).tolist(), x[fold != f].std(axis=0).tolist()) for f in range(3)}
    problems = [K.Problem(c, e, g, f) for c in (0.1, 10.0) for e in (0.01, 0.5) for g in (K.SCALE, K.AUTO, 0.01) for f in range(3)]
    together = K.fit_many(df, 3, problems, scalings, landmarks=40)
    for i in (7, 35):
        alone, = K.fit_many(df, 3, [problems[i]], scalings, landmarks=40)
        assert np.allclose(alone.weights, together[i].weights, rtol=1e-6, atol=1e-8)
    errors = K.squared_errors(df, 3, [(q.fold, m) for q, m in zip(problems, together)], scalings)
    for q, m, e in zip(problems, together, errors):
        z = (x[fold == q.fold] - scalings[q.fold][0]) / scalings[q.fold][1]
        assert e == pytest.approx(((y[fold == q.fold] - m.map(z) @ m.weights) ** 2).mean())


def test_blocks_do_not_change_results(table, monkeypatch):
    _, _, _, df = table
    problems = [K.Problem(c, 0.1, K.SCALE, f) for c in (0.1, 1.0) for f in range(2)]
    whole = K.fit_many(df, 3, problems, landmarks=20)
    monkeypatch.setattr(K, "BLOCK", 600)
    for a, b in zip(whole, K.fit_many(df, 3, problems, landmarks=20)):
        assert np.allclose(a.weights, b.weights, rtol=1e-6, atol=1e-8)


def test_stage_fits_predicts_and_survives_saving(spark, table, tmp_path):
    x, y, _, df = table
    flat = df.selectExpr("x[0] AS a", "x[1] AS b", "x[2] AS c", "label")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"),
                             K.KernelRegression(c=10.0, epsilon=0.2, gamma=0.3, landmarks=60)]).fit(flat)
    model.write().overwrite().save(str(tmp_path / "m"))
    out = PipelineModel.load(str(tmp_path / "m")).transform(flat).select("a", "b", "c", "label", "prediction").toPandas()
    got, = K.fit_many(df, 3, [K.Problem(10.0, 0.2, 0.3)], landmarks=60)
    want = got.map(out[["a", "b", "c"]].to_numpy()) @ got.weights
    assert np.allclose(out["prediction"], want, atol=1e-4)


def test_constant_target_repeated_rows_and_no_rows(spark):
    same = spark.createDataFrame([([1.0, 2.0], 5.0, 0)] * 30, "x array<double>, label double, fold int")
    got, = K.fit_many(same, 2, [K.Problem()])
    assert len(got.map.landmarks) == 1  # equal rows are one landmark
    assert (got.map(np.array([[1.0, 2.0]])) @ got.weights)[0] == pytest.approx(5.0, abs=0.11)
    with pytest.raises(ValueError):
        K.fit_many(same.limit(0), 2, [K.Problem()])


def test_steps_add_up_to_the_weighted_gram(spark):
    """One scan's Gram matrices equal the weighted products in numpy, for far larger and far smaller weights alike."""
    from haze.functions import kernel as K

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 2)), rng.normal(size=200)
    rows = spark.createDataFrame([(v.tolist(), float(t), 0) for v, t in zip(x, y)], "x array<double>, label double, fold int")
    m = K._map(x[:20], 0.5, 20, 1)
    z = m(x)
    w = rng.normal(size=z.shape[1])
    for corner in (1.0, 1e-6):
        _, gram, _ = K._steps(rows, 2, [K.Problem(1.0, 0.1, 0.5, -1)], {}, {(-1, 0.5): m}, [w], [corner], [0])[0]
        r = y - z @ w
        weight = 0.25 / np.maximum(np.abs(r - 0.1), corner) + 0.25 / np.maximum(np.abs(r + 0.1), corner)
        assert np.allclose(gram, (z * weight[:, None]).T @ z, rtol=1e-9)
