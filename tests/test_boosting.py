import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from haze.functions import boosting, trees


def vectors(df):
    return df.withColumn("features", array_to_vector("features"))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 3)), 2)
    x[:, 2] = rng.integers(0, 4, 900)
    t = 100 + x[:, 0] * 3 + np.where(x[:, 1] > 0, x[:, 2], -x[:, 0]) + rng.normal(size=900) / 5
    y = np.digitize(t, np.quantile(t, [0.3, 0.7]))
    return vectors(spark.createDataFrame([(i, [float(v) for v in x[i]], float(t[i]), float(y[i])) for i in range(900)],
                                         "id long, features array<double>, t double, label double")).repartition(3).cache()


def forced(monkeypatch, est, rows):
    monkeypatch.setattr(trees, "SMALL", 0)
    monkeypatch.setattr(boosting, "BLOCK", 100)
    monkeypatch.setattr(boosting, "WRITTEN", 2)
    model = trees.fitted(est, rows)
    assert isinstance(model, boosting.BoostedTreesModel)
    return model


def by_id(df, col):
    return np.array([r[0] if isinstance(r[0], float) else r[0].toArray() for r in df.orderBy("id").select(col).collect()])


@pytest.mark.parametrize("bins", [32, 50])
def test_regression_is_sparks(spark, rows, monkeypatch, bins):
    est = GBTRegressor(labelCol="t", maxIter=6, maxDepth=4, stepSize=0.3, maxBins=bins, minInstancesPerNode=3, seed=1)
    mine, theirs = forced(monkeypatch, est, rows), est.fit(rows)
    assert by_id(mine.transform(rows), "prediction") == pytest.approx(by_id(theirs.transform(rows), "prediction"), rel=1e-6)
    assert mine.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-5)


def test_classes_are_sparks(spark, rows, monkeypatch, tmp_path):
    two = rows.withColumn("label", (F.col("label") > 0).cast("double"))
    one = GBTClassifier(maxIter=5, maxDepth=3, stepSize=0.3, seed=1)
    mine, theirs = forced(monkeypatch, one, two).transform(two), one.fit(two).transform(two)
    for col in ("rawPrediction", "probability", "prediction"):
        assert by_id(mine, col) == pytest.approx(by_id(theirs, col), rel=1e-5, abs=1e-6)
    est = OneVsRest(classifier=one)
    model, theirs = forced(monkeypatch, est, rows), est.fit(rows).transform(rows)
    mine = model.transform(rows)
    for col in ("rawPrediction", "prediction"):
        assert by_id(mine, col) == pytest.approx(by_id(theirs, col), rel=1e-5, abs=1e-6)
    PipelineModel(stages=[model]).save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m").transform(rows)
    assert (by_id(again, "rawPrediction") == by_id(mine, "rawPrediction")).all()


def test_all_classes_share_a_scan(spark, rows, monkeypatch):
    scans, real = [], boosting._level
    monkeypatch.setattr(boosting, "_level", lambda *a: scans.append(1) or real(*a))
    model = forced(monkeypatch, OneVsRest(classifier=GBTClassifier(maxIter=3, maxDepth=3, seed=1)), rows)
    assert len(scans) == 3 * 2 and len(model.trees) == 3 * 3


def test_drawn_rows_and_missing_values(spark, rows, monkeypatch):
    est = GBTRegressor(labelCol="t", maxIter=20, maxDepth=3, stepSize=0.1, subsamplingRate=0.6, seed=1)
    off = by_id(forced(monkeypatch, est, rows).transform(rows), "prediction") - by_id(rows, "t")
    assert (off ** 2).mean() < 0.1 * by_id(rows, "t").var()
    hit = boosting.drawn(1 << 33, 100_000, 4, boosting.Spec(1, 0, 1, 1, 0.1, 0.6, 1, 0.0, 1, 32))
    assert abs(hit.mean() - 0.6) < 0.01 and (hit != boosting.drawn(1 << 33, 100_000, 5, boosting.Spec(1, 0, 1, 1, 0.1, 0.6, 1, 0.0, 1, 32))).any()
    gaps = vectors(spark.createDataFrame([(i, [float("nan") if i % 3 == 0 else float(i % 7), 1.0], 5.0 if i % 3 == 0 else 1.0) for i in range(300)],
                                         "id long, features array<double>, t double"))
    model = forced(monkeypatch, est.copy({est.subsamplingRate: 1.0, est.maxIter: 2}), gaps)
    got = by_id(model.transform(gaps), "prediction")
    missing = np.arange(300) % 3 == 0
    # as with Spark a missing value is in the last bin, with the largest values
    assert len(set(got[missing | (np.arange(300) % 7 == 6)])) == 1 and got[missing][0] > 4 and got[~missing].min() == pytest.approx(1.0, abs=1e-6)


def test_pure_labels(spark, rows, monkeypatch):
    flat = rows.withColumn("t", F.lit(7.0))
    model = forced(monkeypatch, GBTRegressor(labelCol="t", maxIter=3, maxDepth=3, seed=1), flat)
    assert set(by_id(model.transform(flat), "prediction")) == {7.0}
