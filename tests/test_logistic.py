"""Many logistic problems per scan against single problems solved in numpy."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from haze.functions import logistic as L


def objective(w, x, y, c, l1):
    z = x @ w
    pen = np.abs(w).sum() if l1 else (w ** 2).sum() / 2
    return np.logaddexp(0, np.where(y, -z, z)).mean() + pen / (c * len(y))


def ridge_by_newton(x, y, c):
    """The l2 problem in numpy, the constant column penalised like the rest."""
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) + w / c
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / c
        step = np.linalg.solve(h, g)
        t = 1.0
        while objective(w - t * step, x, y, c, False) > objective(w, x, y, c, False) - 1e-4 * t * (g @ step) / len(y) and t > 1e-9:
            t /= 2
        w = w - t * step
        if np.abs(step).max() < 1e-12:
            break
    return w


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 1500
    x = rng.normal(size=(n, 4)) * [1, 3, 0.2, 1] + [0, 5, 0, -2]
    score = x @ np.array([[1, -1, 0], [0.5, 0, -0.5], [0, 2, 0], [0, 0, 0]]) + [-2.5, 0, 2.5] + rng.gumbel(size=(n, 3))
    label, fold = score.argmax(axis=1), rng.integers(0, 3, n)
    rows = [(v.tolist(), float(y), int(f)) for v, y, f in zip(x, label, fold)]
    return x, label, fold, spark.createDataFrame(rows, "x array<double>, label double, fold int").repartition(3)


def test_all_problems_equal_single_ones(table):
    x, label, fold, df = table
    scalings = {f: (x[fold != f].mean(axis=0).tolist(), x[fold != f].std(axis=0).tolist()) for f in range(3)}
    problems = [L.Problem(k, c, l1, f) for k in range(3) for c in (0.05, 1.0, 100.0) for l1 in (False, True) for f in range(3)]
    got = L.fit_many(df, 4, problems, scalings)
    for q, w in zip(problems, got):
        use = fold != q.fold
        xs = np.column_stack([(x[use] - scalings[q.fold][0]) / scalings[q.fold][1], np.ones(use.sum())])
        y = label[use] == q.code
        if not q.l1:
            assert w == pytest.approx(ridge_by_newton(xs, y, q.c), abs=1e-5)
            continue
        p = 1 / (1 + np.exp(-xs @ w))
        g, lam = xs.T @ (p - y) / len(y), 1 / (q.c * len(y))
        assert np.all(np.abs(g[w == 0]) <= lam * (1 + 1e-3) + 1e-7)
        assert g[w != 0] == pytest.approx(-lam * np.sign(w[w != 0]), abs=2e-6)
    assert (got[[q.l1 and q.c == 0.05 for q in problems]] == 0).any()  # the absolute penalty leaves weights out


def test_problems_in_turns_and_separable_classes(table, monkeypatch, spark):
    _, _, _, df = table
    problems = [L.Problem(k, 1.0, l1, f) for k in range(3) for l1 in (False, True) for f in range(2)]
    whole = L.fit_many(df, 4, problems)
    monkeypatch.setattr(L, "BLOCK", 40)
    assert L.fit_many(df, 4, problems) == pytest.approx(whole, abs=1e-6)
    far = spark.createDataFrame([([float(v)], float(v > 0), 0) for v in (-3, -2, -1, 1, 2, 3)], "x array<double>, label double, fold int")
    w = L.fit_many(far, 1, [L.Problem(1, 1e6)])[0]
    assert w[0] > 5 and abs(w[1]) < 1e-3


def test_grid_search_equals_single_fits(spark):
    """Fold scores of the shared scans against one chain fitted per point and fold."""
    from haze.config import ClassificationConfig
    from haze.plans import models as M
    from haze.plans import training

    rng = np.random.default_rng(2)
    n = 900
    a, b = rng.normal(size=n), rng.normal(size=n) * 3 + 1
    y = np.digitize(a - 0.4 * b + rng.normal(size=n), [-1, 0.5])
    rows = spark.createDataFrame([(i, float(a[i]), float(b[i]), "pqr"[y[i]]) for i in range(n)], "id long, a double, b double, y string")
    cfg = ClassificationConfig(target_column="y", key=["id"], cv_folds=3, outlier_method="zscore")
    prep = training.prepare(rows, cfg, "classification")
    est, params = M.classifier("logistic", 3, prep.n_train)
    points = M.grid("logistic", params, prep.n_train, "classification")
    assert len(points) == 8
    cv = training.cross_validate(prep, est, points, cfg, "classification")
    train, judge = prep.data.where("is_test = 0"), training._evaluator("classification")
    for i in (0, 3, 6):
        for f in range(3):
            chain = M.chain(prep.features, cfg.scaling_method, est.copy(points[i])).fit(train.where(F.col("fold") != f))
            assert cv.folds[i][f] == pytest.approx(judge.evaluate(chain.transform(train.where(F.col("fold") == f))), abs=1e-3)


def test_model_scores_and_round_trip(table, tmp_path, spark):
    from pyspark.ml.functions import array_to_vector

    x, label, _, df = table
    rows = df.withColumn("features", array_to_vector("x"))
    model = L.OneVsRestLogistic(numClasses=3).fit(rows)
    z = np.column_stack([x, np.ones(len(x))]) @ model._matrix().T
    p = 1 / (1 + np.exp(-z))
    p /= p.sum(axis=1, keepdims=True)
    out = {tuple(r["x"]): r for r in model.transform(rows).collect()}
    for k in range(0, len(x), 50):
        r = out[tuple(x[k])]
        assert r["prediction"] == z[k].argmax() and r["probability"].toArray() == pytest.approx(p[k], rel=1e-9)
    path = str(tmp_path / "m")
    PipelineModel(stages=[model]).write().overwrite().save(path)
    again = PipelineModel.load(path).transform(rows)
    assert again.select("prediction").collect() == model.transform(rows).select("prediction").collect()
    two = L.OneVsRestLogistic(numClasses=2).fit(rows.withColumn("label", (F.col("label") == 1).cast("double")))
    r = two.transform(rows).first()
    assert r["probability"].toArray().sum() == pytest.approx(1) and r["prediction"] == float(r["rawPrediction"][1] > 0)
