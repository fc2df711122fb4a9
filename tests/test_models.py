"""Grouped least squares against numpy, model chains, persistence."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from haze.functions.scalers import ExactScaler, ExactScalerModel
from haze.operators import grouped
from haze.plans import models as M


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(11)
    n = 2000
    pdf = pd.DataFrame({"city": rng.choice(["p", "q", "r"], n), "a": rng.normal(size=n), "b": rng.normal(size=n),
                        "id": np.arange(n)})
    pdf["t"] = 3 + 2 * pdf.a - 0.5 * pdf.b + rng.normal(scale=0.1, size=n)
    return spark.createDataFrame(pdf), pdf


def test_group_ols_matches_lstsq(signal):
    df, pdf = signal
    got = {r["city"]: r for r in grouped.fit_per_group(df, "city", ["a", "b"], "t").collect()}
    for c, g in pdf.groupby("city"):
        x = np.column_stack([np.ones(len(g)), g.a, g.b])
        beta = np.linalg.lstsq(x, g.t, rcond=None)[0]
        r = got[c]
        assert [r["intercept"], r["b_a"], r["b_b"]] == pytest.approx(list(beta), rel=1e-8, abs=1e-8)
        assert r["n"] == len(g)


def test_average_and_score(signal):
    df, _ = signal
    coefs = grouped.fit_per_group(df, "city", ["a", "b"], "t")
    avg = grouped.average_models(coefs, ["a", "b"])
    r = avg.first()
    assert r["b_a"] == pytest.approx(2, abs=0.05) and r["b_b"] == pytest.approx(-0.5, abs=0.05)
    scored = grouped.linear_score(df, avg, ["a", "b"])
    err = scored.agg(F.avg(F.abs(F.col("t") - F.col("y_hat")))).first()[0]
    assert err < 0.2


def test_chain_fits_and_round_trips(spark, signal, tmp_path):
    df, _ = signal
    data = df.withColumn("label", (F.col("t") > 3).cast("double"))
    est, _ = M.classifier("logistic", 2, 2000)
    model = M.chain(["a", "b"], "robust", est).fit(data)
    acc = model.transform(data).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.9
    path = str(tmp_path / "chain")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = model.transform(data).select("id", "prediction")
    b = again.transform(data).select("id", F.col("prediction").alias("p2"))
    assert a.join(b, "id").where("prediction != p2").count() == 0
    assert isinstance(again.stages[0], ExactScalerModel)


def test_exact_scaler_fit_on_train_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    test = spark.createDataFrame([(5.0,)], "x double")
    m = ExactScaler(inputCols=["x"], method="standard").fit(train)
    assert m.transform(test).first()["x"] == pytest.approx(3.0)


def test_training_run_writes_its_tables(spark, signal, tmp_path):
    from haze.config import ClassificationConfig, RegressionConfig
    from haze.plans import training

    df, _ = signal
    rows = df.withColumn("y", F.when(F.col("t") > 3, "up").otherwise("down"))
    cfg = ClassificationConfig(target_column="y", key=["id"], models=["tree"], use_hyperparameter_tuning=False, cv_folds=2,
                               outlier_method="zscore", out_dir=str(tmp_path / "c"))
    res = training.train_classification(rows.select("id", "city", "a", "b", "y"), cfg)
    assert res.results.first()["f1"] > 0.9
    read = lambda d, k: spark.read.option("header", True).csv(f"{tmp_path}/{d}/output/{k}")
    assert {r["y"] for r in read("c", "classification_tree_confusion").collect()} == {"up", "down"}
    roc = read("c", "classification_tree_roc").collect()
    assert {r["cls"] for r in roc if float(r["fpr"]) == float(r["tpr"]) == 0.0} == {"up", "down"}
    assert {r["feature"] for r in read("c", "classification_tree_importance").collect()} == set(res.features)
    encoders = [p for p in (tmp_path / "c/models").iterdir() if "label_encoder" in p.name]
    from pyspark.ml.feature import StringIndexerModel
    assert StringIndexerModel.load(str(encoders[0])).labels == ["down", "up"]
    cfg = RegressionConfig(target_column="t", key=["id"], models=["linear"], use_hyperparameter_tuning=False, cv_folds=2,
                           out_dir=str(tmp_path / "r"))
    res = training.train_regression(df, cfg)
    assert res.results.first()["r2"] > 0.95
    resid = read("r", "regression_linear_residuals").collect()
    assert len(resid) == read("r", "regression_linear_actual_predicted").count() > 0
    assert all(abs(float(r["y"]) - float(r["y_hat"]) - float(r["residual"])) < 1e-9 for r in resid)


def test_grid_points_share_the_scaler_and_pick_the_best(spark, signal):
    from haze.config import ClassificationConfig
    from haze.plans import training

    df, _ = signal
    rows = df.withColumn("y", F.when(F.col("t") > 3, "up").otherwise("down")).select("id", "a", "b", "y")
    cfg = ClassificationConfig(target_column="y", key=["id"], cv_folds=2, outlier_method="zscore", grid="small")
    prep = training.prepare(rows, cfg, "classification")
    model, mean, _, cv = training.fit_model(prep, "logistic", cfg, "classification")
    assert len(cv.means) == 2 and mean == max(cv.means) > 0.9 and isinstance(model.stages[0], ExactScalerModel)


def test_grouped_model_on_all_columns(spark, signal):
    from haze.plans import grouped_model

    df, _ = signal
    few = spark.createDataFrame([("rare", 0.0, 0.0, 90000 + i, 5.0) for i in range(5)], df.schema)
    cfg = grouped_model.GroupedModelConfig(target="t", key=["id"], drop=[])
    res = grouped_model.run(df.unionByName(few), cfg)
    assert set(res.features) == {"a", "b", "city_q", "city_r", "city_rare"}
    assert [r["city"] for r in res.skipped.collect()] == ["rare"] and res.per_group.count() == 3
    assert res.metrics.first()["r2"] > 0.9


def test_boosted_classes_get_probabilities(spark, signal, tmp_path):
    from haze.config import ClassificationConfig
    from haze.plans import training

    df, _ = signal
    rows = df.withColumn("y", F.when(F.col("t") > 4, "up").when(F.col("t") > 2, "mid").otherwise("down")).select("id", "a", "b", "y")
    cfg = ClassificationConfig(target_column="y", key=["id"], outlier_method="zscore")
    prep = training.prepare(rows, cfg, "classification")
    model, *_ = training.fit_model(prep, "gbt", cfg, "classification", tune=False, cv=False, maxIter=4, maxDepth=2)
    path = str(tmp_path / "gbt")
    model.write().overwrite().save(path)
    for m in (model, PipelineModel.load(path)):
        for r in m.transform(prep.data).limit(50).collect():
            each = 1 / (1 + np.exp(-2 * r["rawPrediction"].toArray()))
            assert r["probability"].toArray() == pytest.approx(each / each.sum())
            assert r["prediction"] == r["probability"].argmax()
    assert training.evaluate_classifier(model, prep.data.where("is_test = 1"), 3)["roc_auc"] > 0.9
    assert training.feature_importance(model, prep.features).count() == len(prep.features)


def test_train_regression_runs_the_whole_grids(spark, sf_small, monkeypatch):
    import __spark_entry__ as E
    from haze.plans import training

    class Seen(Exception):
        pass

    def caught(df, cfg):
        raise Seen(cfg)

    monkeypatch.setattr(training, "train_regression", caught)
    with pytest.raises(Seen) as seen:
        E.queries()["train_regression"](spark, sf_small)
    cfg, = seen.value.args
    assert cfg.use_hyperparameter_tuning and cfg.grid == "full" and cfg.cv_folds == 5
    assert {"forest", "gbt", "rbf"} <= set(cfg.models) and not cfg.model_params
