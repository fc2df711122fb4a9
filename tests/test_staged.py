"""Grid points read off one ensemble, against trees walked by hand and models fitted on their own."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from haze.plans import staged
from haze.plans.staged import Variant


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    t = x @ [1.0, -2.0, 0.5] + np.sin(3 * x[:, 0]) + rng.normal(scale=0.7, size=400)
    rows = [(r.tolist(), float(np.digitize(v, [-1, 1])), float(v)) for r, v in zip(x, t)]
    df = spark.createDataFrame(rows, "x array<double>, cls double, num double").repartition(3)
    return df.select(array_to_vector("x").alias("features"), "cls", "num").cache()


def as_rows(df, label):
    return df.select("features", F.col(label).alias("label"))


def walked(model, rows, size, variant, boosted=False, k=0):
    """Sum over the first trees, each walked from its root by the saved splits and stopped by the variant's limits."""
    from haze.session import scratch_dir

    spark = rows.sparkSession
    path = scratch_dir(spark, "walk")
    model.write().overwrite().save(path)
    trees = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    out = []
    for r in rows.collect():
        total = 0.0
        for t in range(size):
            n, depth = trees[t][0], 0
            while n["leftChild"] >= 0 and not (variant.depth is not None and depth >= variant.depth) and not (
                    variant.min_split is not None and n["rawCount"] < variant.min_split):
                s = n["split"]
                n = trees[t][n["leftChild"] if r["features"][s["featureIndex"]] <= s["leftCategoriesOrThreshold"][0] else n["rightChild"]]
                depth += 1
            v = np.array(n["impurityStats"]) / sum(n["impurityStats"]) if k else n["prediction"]
            total = total + v * (model.treeWeights[t] if boosted else 1.0)
        out.append((r["label"], total))
    return out


VARIANTS = [Variant(), Variant(depth=3), Variant(depth=1), Variant(min_split=40), Variant(depth=4, min_split=15), Variant(depth=0)]


@pytest.mark.parametrize("block", [64 << 20, 2000])
def test_forests_equal_walked_trees(data, monkeypatch, block):
    monkeypatch.setattr(staged, "BLOCK", block)
    rows = as_rows(data, "cls")
    m = RandomForestClassifier(numTrees=6, maxDepth=8, seed=3).fit(rows)
    got = staged.scores(rows, [m], [2, 6], VARIANTS, 3, boosted=False)
    for v in VARIANTS:
        for size in (2, 6):
            want = np.zeros((3, 3))
            for y, votes in walked(m, rows, size, v, k=3):
                want[int(y), votes.argmax()] += 1
            assert np.array_equal(got[size, v], want)
    rows = as_rows(data, "num")
    m = RandomForestRegressor(numTrees=4, maxDepth=7, seed=3).fit(rows)
    got = staged.scores(rows, [m], [1, 4], VARIANTS, 0, boosted=False)
    for v in VARIANTS:
        for size in (1, 4):
            want = sum((y - s / size) ** 2 for y, s in walked(m, rows, size, v))
            assert got[size, v].tolist() == pytest.approx([400, want])


def test_cut_trees_equal_shallow_fits(data):
    """A tree cut at a depth is the tree fitted to that depth."""
    rows = as_rows(data, "num")
    forest = dict(numTrees=1, subsamplingRate=1.0, featureSubsetStrategy="all", seed=5)
    deep = RandomForestRegressor(maxDepth=9, bootstrap=False, **forest).fit(rows)
    got = staged.scores(rows, [deep], [1], [Variant(depth=d) for d in (1, 2, 5)], 0, boosted=False)
    for d in (1, 2, 5):
        own = DecisionTreeRegressor(maxDepth=d).fit(rows).transform(rows)
        err = own.agg(F.sum((F.col("label") - F.col("prediction")) ** 2)).first()[0]
        assert got[1, Variant(depth=d)][1] == pytest.approx(err)
    rows = as_rows(data, "cls")
    deep = RandomForestClassifier(maxDepth=9, bootstrap=False, **forest).fit(rows)
    found = staged.scores(rows, [deep], [1], [Variant(depth=3)], 3, boosted=False)[1, Variant(depth=3)]
    own = DecisionTreeClassifier(maxDepth=3).fit(rows).transform(rows)
    assert np.trace(found) == own.where("label = prediction").count()


def test_boosting_stages_equal_shorter_fits(data):
    rows = as_rows(data, "num")
    long = GBTRegressor(maxIter=9, maxDepth=3, stepSize=0.2, subsamplingRate=0.8, seed=2).fit(rows)
    got = staged.scores(rows, [long], [3, 9], [Variant()], 0, boosted=True)
    for size in (3, 9):
        short = GBTRegressor(maxIter=size, maxDepth=3, stepSize=0.2, subsamplingRate=0.8, seed=2).fit(rows)
        err = short.transform(rows).agg(F.sum((F.col("label") - F.col("prediction")) ** 2)).first()[0]
        assert got[size, Variant()][1] == pytest.approx(err)
    rows = as_rows(data, "cls")
    gbt = GBTClassifier(maxIter=5, maxDepth=2, seed=2)
    model = OneVsRest(classifier=gbt).fit(rows)
    found = staged.scores(rows, list(model.models), [5], [Variant()], 3, boosted=True)[5, Variant()]
    assert np.trace(found) == model.transform(rows).where("label = prediction").count()


def test_grids_take_few_fits(spark, monkeypatch):
    from haze.config import ClassificationConfig, RegressionConfig
    from haze.plans import models as M
    from haze.plans import training

    rng = np.random.default_rng(6)
    n = 500
    a, b = rng.normal(size=n), rng.normal(size=n)
    rows = spark.createDataFrame([(i, float(a[i]), float(b[i]), "uvw"[int(np.digitize(a[i] * b[i], [-0.3, 0.3]))], float(a[i] * b[i]))
                                  for i in range(n)], "id long, a double, b double, y string, t double")
    fits = []
    real = RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, d: fits.append(1) or real(self, d))
    cfg = ClassificationConfig(target_column="y", key=["id"], cv_folds=2, outlier_method="zscore")
    prep = training.prepare(rows.drop("t"), cfg, "classification")
    monkeypatch.setattr(M, "grid", lambda name, params, *a: M.ParamGridBuilder().addGrid(params.numTrees, [3, 8]).addGrid(
        params.maxDepth, [2, 6]).addGrid(params.minInstancesPerNode, [1, 4]).build())
    cv = training.forest_grid(prep, cfg, "classification", min_splits=(2, 10))
    assert len(cv.points) == 16 and len(fits) == 4 and all(0.2 < m <= 1 for m in cv.means)
    deep = [m for p, m in zip(cv.points, cv.means) if p["maxDepth"] == 6 and p["numTrees"] == 8 and p["minSplit"] == 2]
    assert min(deep) > 0.7
    model, mean, _, cv = training.fit_model(prep, "forest", cfg, "classification", tune=True)
    assert len(cv.points) == 8 and mean == max(cv.means) and model.stages[-1].getNumTrees in (3, 8)
    cfg = RegressionConfig(target_column="t", key=["id"], cv_folds=2, outlier_method="zscore")
    prep = training.prepare(rows.drop("y"), cfg, "regression")
    est, params = M.regressor("gbt")
    points = M.ParamGridBuilder().addGrid(params.maxIter, [2, 6]).addGrid(params.stepSize, [0.1, 0.3]).addGrid(params.maxDepth, [2]).build()
    cv = training.cross_validate(prep, est, points, cfg, "regression")
    train, judge = prep.data.where("is_test = 0"), training._evaluator("regression")
    for i in (0, 3):
        chain = M.chain(prep.features, cfg.scaling_method, est.copy(points[i])).fit(train.where("fold <> 0"))
        assert cv.folds[i][0] == pytest.approx(judge.evaluate(chain.transform(train.where("fold = 0"))), rel=1e-6)
