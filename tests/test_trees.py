"""Deep trees grown in tasks against Spark's learner on the same rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from haze.functions import trees
from haze.session import scratch_dir, written


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 3000
    a, b, c = rng.integers(0, 20, n), rng.integers(0, 31, n), rng.normal(size=n).round(1)
    y = 2.0 * a - 0.5 * b + np.sin(c) + rng.normal(size=n) / 10
    z = (np.digitize(a + b + rng.integers(0, 3, n), [15, 30])).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y, z)], "a double, b double, c double, y double, z double")
    return written(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.repartition(3)), "tree-test")


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(trees, "SMALL", 0)
    monkeypatch.setattr(trees, "LOCAL", 400)  # several scans, many units
    monkeypatch.setattr(trees, "PACK", 64)


@pytest.mark.parametrize("depth", [12, 30])
def test_tree_is_sparks_tree(rows, depth):
    one = DecisionTreeRegressor(labelCol="y", maxDepth=depth, seed=1)
    own, spark_s = trees.fitted(one, rows), one.fit(rows)
    assert isinstance(own, trees.DeepTreesModel)
    found = own.transform(rows).select("a", "b", "c", "y", F.col("prediction").alias("p"))
    same = spark_s.transform(rows).select(F.col("prediction").alias("q"), "a", "b", "c").distinct()
    far = found.join(same, ["a", "b", "c"]).select(F.count(F.lit(1)).alias("n"), F.avg((F.abs(F.col("p") - F.col("q")) > 1e-6).cast("int")).alias("x")).first()
    assert far["x"] < 0.02, far  # Spark's bins count a few values otherwise
    assert np.allclose(own.featureImportances.toArray(), spark_s.featureImportances.toArray(), atol=5e-3)


def test_class_tree(rows):
    one = DecisionTreeClassifier(labelCol="z", maxDepth=30, seed=1)
    own, spark_s = trees.fitted(one, rows), one.fit(rows)
    a, b = (m.transform(rows).select(F.avg((F.col("prediction") == F.col("z")).cast("int"))).first()[0] for m in (own, spark_s))
    assert abs(a - b) < 0.01
    assert np.allclose(own.featureImportances.toArray(), spark_s.featureImportances.toArray(), atol=0.02)
    p = own.transform(rows).first()["probability"]
    assert p.toArray().sum() == pytest.approx(1.0)


def test_forest_and_its_copy(spark, rows):
    forest = RandomForestRegressor(labelCol="y", numTrees=8, maxDepth=15, minInstancesPerNode=2, featureSubsetStrategy="all", seed=3)
    own, spark_s = trees.fitted(forest, rows), forest.fit(rows)
    err = [m.transform(rows).select(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0] for m in (own, spark_s)]
    assert err[0] == pytest.approx(err[1], rel=0.1)
    assert own.featureImportances.toArray() == pytest.approx(spark_s.featureImportances.toArray(), abs=0.02)
    path = scratch_dir(spark, "trees")
    own.write().save(path)
    again = trees.DeepTreesModel.load(path)
    pair = own.transform(rows).select(F.col("prediction").alias("p"), "features").join(
        again.transform(rows).select(F.col("prediction").alias("q"), "features").distinct(), "features")
    assert pair.where("p <> q").isEmpty()


def test_importances_return_no_nodes(rows, monkeypatch):
    real, kept = trees._finished, []
    monkeypatch.setattr(trees, "_finished", lambda *a: kept.append(real(*a)) or kept[-1])
    forest = RandomForestClassifier(labelCol="z", numTrees=60, maxDepth=30, seed=3)
    own = trees.importances(forest, rows)
    assert kept and all(len(r["nodes"]) == 0 and len(r["sums"]) == 0 for r in kept[0])
    assert own == pytest.approx(forest.fit(rows).featureImportances.toArray(), abs=0.05)


def test_constant_target_is_one_leaf(rows):
    own = trees.fitted(DecisionTreeRegressor(labelCol="k", maxDepth=30), rows.withColumn("k", F.lit(2.5)))
    assert own.transform(rows).where("prediction <> 2.5").isEmpty()
    with pytest.raises(ValueError):
        trees.fitted(DecisionTreeRegressor(labelCol="k", maxDepth=30), rows.withColumn("k", F.lit(None).cast("double")))


def test_ensembles_hold_few_rows_a_task(rows, monkeypatch):
    monkeypatch.setattr(trees, "TASK", 100)
    seen, real = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: seen.append(df) or real(self, df))
    trees.fitted(RandomForestClassifier(labelCol="z", numTrees=3, maxDepth=4), rows)
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 30 and max(sizes) <= 200 and sum(sizes) == 3000


def test_equal_gains_go_to_the_reservoirs_order():
    """Every feature is looked at as often as any other, and later features, which take earlier ones' places, may win ties."""
    spec = trees.Spec(1, 30, 1, 0.0, 2, 3, True, 42, 32)
    order = trees._subset(np.arange(1, 20001), 0, 5, spec)
    assert all(len(set(r)) == 3 for r in order[:500])
    assert np.allclose(np.bincount(order.ravel(), minlength=5) / 20000, 0.6, atol=0.02)
    assert np.mean(order[:, 0] >= 3) == pytest.approx(0.4, abs=0.02)
    hist = np.zeros((2, 5, 2, 3))
    hist[:, :, 0] = [4, 4, 0]
    hist[:, :, 1] = [4, 0, 4]
    assert trees.best_of(hist, np.array([[4, 1, 2], [0, 3, 2]]), spec)[1].tolist() == [4, 0]
    code, s = np.array([[0] * 5] * 4 + [[1] * 5] * 4, np.uint8), trees.stats_of(np.repeat([0.0, 1.0], 4), np.ones(8), spec)
    found = trees._best_sparse(code, s, np.zeros(8, int), s.sum(axis=0)[None, :], np.array([[4, 1, 2]]), 2, spec)
    assert found[1].tolist() == [4] and found[2].tolist() == [0]
