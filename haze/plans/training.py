"""Model training runs: clean → outliers → features → select → split → tune → evaluate → pick best.

Every data step is a DataFrame job; model fits are Spark ML jobs.  The
driver only loops over the handful of models and receives per-model scores.
The cleaned, feature-engineered table is written to the shared scratch folder
because selection, tuning and evaluation all scan it.
"""

from __future__ import annotations

import datetime as _dt
import logging
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.config import ClassificationConfig, RegressionConfig
from haze.functions import features as feat
from haze.functions import kernel, logistic, trees
from haze.functions.boosting import BoostedTreesModel
from haze.functions.probabilities import MarginProbabilities
from haze.functions.scalers import fold_scalings
from haze.operators import clean, metrics, quality, select, split
from haze.plans import models as M
from haze.plans import staged
from haze.session import checkpoint_root, written
from haze.sources import files

log = logging.getLogger(__name__)

TIME_COL = "ts"


@dataclass
class Prepared:
    data: DataFrame            # written: features + label (+ key), split flag and fold column
    features: list[str]        # chosen features
    candidates: list[str]      # all numeric features before selection
    labels: list[str] | None   # class names by code (classification)
    n_train: int
    label_model: object = None


@dataclass
class TrainResult:
    results: DataFrame         # leaderboard, best first
    best_name: str
    best_model: PipelineModel
    features: list[str]
    labels: list[str] | None
    models: dict = field(default_factory=dict)
    metadata: DataFrame | None = None
    tables: dict = field(default_factory=dict)  # per model: name -> DataFrame (see ``result_tables``)


def _numeric_features(df: DataFrame, exclude: set[str]) -> list[str]:
    return [c for c in quality.numeric_columns(df) if c not in exclude]


def prepare(df: DataFrame, cfg, task: str) -> Prepared:
    """Cleaning, outliers, features, labels, selection, split and folds (shared by both tasks)."""
    cfg.validate()
    quality.require_nonempty(df)
    target, key = cfg.target_column, list(cfg.key)
    if task == "classification":
        if target not in df.columns or quality.distinct_count(df, target) < 2:
            log.warning("target %r missing or single-class: building terciles of %s", target, cfg.label_source)
            df = feat.add_tercile_label(df, cfg.label_source, target)
    quality.require_columns(df, [target])
    # a timestamp that arrived as text is parsed, never one-hot coded
    if dict(df.dtypes).get(TIME_COL) == "string":
        df = clean.parse_timestamp(df, TIME_COL)
    # missing values: median for numbers, most frequent for strings; the target too
    num = _numeric_features(df, set(key))
    texts = [c for c in quality.string_columns(df) if c not in key]
    strs = [c for c in texts if c != target]
    df = clean.impute_median(df, num)
    df = clean.impute_mode(df, texts)
    # the outlier cascade scans the filled table several times per column: written once, columns pruned per scan
    filled = written(df, "train-filled")
    # outliers over numeric columns except the target, in column order
    out_cols = [c for c in num if c != target]
    df, _fences = clean.remove_outliers(filled, out_cols, cfg.outlier_method)
    # features: one-hot strings, time parts, interactions, polynomials; incomplete rows dropped
    for c in strs:
        df = feat.one_hot(df, c, prefix=c)
    df = df.toDF(*[c.replace(".", "_") for c in df.columns])  # model stages read a dot as a nested field
    df = feat.engineer_features(df, task, TIME_COL)
    exclude = {target, "aqi", TIME_COL, *key}
    if cfg.exclude_derived and task == "classification":
        exclude |= {c for c in df.columns if c.startswith(cfg.label_source)}
    candidates = _numeric_features(df, exclude)
    labels, label_model = None, None
    if task == "classification":
        df, label_model = feat.label_index(df, target, "label")
        df = df.withColumn("label", F.col("label").cast("double"))
        labels = list(label_model.labels)
        if len(labels) < 2:
            raise quality.DataQualityError("classification needs at least 2 classes after cleaning")
    else:
        df = df.withColumn("label", F.col(target).cast("double"))
    df = written(df.select(*key, *candidates, "label"), "train-features")
    # hold-out (stratified by label for classification) and folds of the training rows, one pass
    strata = ["label"] if task == "classification" and getattr(cfg, "use_stratified_split", False) else None
    data = split.holdout_and_folds(df, key, cfg.test_size, cfg.cv_folds, cfg.random_state, strata=strata)
    # model fitting is CPU-bound per row: never fit on fewer partitions than there are cores
    # (small inputs get coalesced to one partition by AQE); large inputs keep their partitioning
    cores = df.sparkSession.sparkContext.defaultParallelism
    if data.select(F.spark_partition_id()).distinct().count() < cores:
        data = data.repartition(cores)
    data = written(data, "train-data")
    sel_rows = data.where(F.col("is_test") == 0) if cfg.select_on_train else data
    chosen = _select(sel_rows, candidates, cfg, task)
    n_train = data.where(F.col("is_test") == 0).count()
    return Prepared(data, chosen, candidates, labels, n_train, label_model)


def _select(df: DataFrame, candidates: list[str], cfg, task: str) -> list[str]:
    k = min(cfg.max_features, len(candidates))
    if cfg.feature_selection == "selectk":
        return select.select_k_best(df, candidates, "label", k, task)
    if cfg.feature_selection == "rfe":
        r = select.rfe(df, candidates, "label", k, task, n_trees=50, seed=cfg.random_state)
        return [x["feature"] for x in r.where("ranking = 1").collect()]
    first = select.select_k_best(df, candidates, "label", min(20 if task == "classification" else 15, len(candidates)), task)
    r = select.rfe(df, first, "label", min(cfg.max_features, len(first)), task, n_trees=50, seed=cfg.random_state)
    return [x["feature"] for x in r.where("ranking = 1").collect()]


def _evaluator(task: str):
    if task == "classification":
        return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="f1")
    return RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="mse")


@dataclass
class CrossValidated:
    """Mean and population std of the fold scores of every grid point."""
    points: list
    means: list[float]
    stds: list[float]
    folds: list[list[float]]   # per point


def _estimator(prep: Prepared, name: str, cfg, task: str, model_kw: dict):
    n_classes = len(prep.labels) if prep.labels else 0
    if task == "classification":
        return M.classifier(name, n_classes, prep.n_train, cfg.random_state, **model_kw)
    return M.regressor(name, cfg.random_state, **model_kw)


def _vectors(fitted: PipelineModel, rows: DataFrame) -> DataFrame:
    """Scaled vectors, written: a lost executor rereads them instead of scaling again from the start."""
    return written(fitted.transform(rows).select("features", "label"), "vectors")


def cross_validate(prep: Prepared, est, points: list, cfg, task: str) -> CrossValidated:
    """Scores of every grid point on every fold.

    Scaler and assembler are fitted once per fold and the vectors written; the points are fitted on
    them, ``cfg.parallelism`` at a time.  Logistic and kernel grids share their scans and ensembles their fits.
    """
    if isinstance(est, logistic.OneVsRestLogistic):
        return _cross_validate_logistic(prep, est, points, cfg)
    if isinstance(est, kernel.KernelRegression):
        return _cross_validate_kernel(prep, est, points, cfg)
    if len(points) > 1 and _staged_by(est):
        return _cross_validate_staged(prep, est, points, cfg, task)
    train, judge = prep.data.where(F.col("is_test") == 0), _evaluator(task)
    scores = [[0.0] * cfg.cv_folds for _ in points]
    for f in range(cfg.cv_folds):
        rows = train.where(F.col("fold") != f)
        pre = M.inputs(prep.features, cfg.scaling_method).fit(rows)
        fit_on, check_on = _vectors(pre, rows), _vectors(pre, train.where(F.col("fold") == f))

        def one(i):
            scores[i][f] = float(judge.evaluate(trees.fitted(est.copy(points[i]), fit_on).transform(check_on)))

        with ThreadPool(max(1, cfg.parallelism)) as pool:
            pool.map(inheritable_thread_target(prep.data.sparkSession)(one), range(len(points)))
    return _summary(points, scores)


def _summary(points: list, scores: list[list[float]]) -> CrossValidated:
    means = [sum(s) / len(s) for s in scores]
    stds = [(sum((x - m) ** 2 for x in s) / len(s)) ** 0.5 for s, m in zip(scores, means)]
    return CrossValidated(points, means, stds, scores)


def _array_rows(prep: Prepared) -> DataFrame:
    """x, label and fold of the training rows."""
    rows = prep.data.where(F.col("is_test") == 0)
    return rows.select(F.array(*[F.col(f"`{c}`").cast("double") for c in prep.features]).alias("x"), "label", "fold")


def _cross_validate_logistic(prep: Prepared, est, points: list, cfg) -> CrossValidated:
    """All points, classes and folds in the same scans; every fold's scaler is fitted without its rows, in the same jobs too."""
    rows, d, k = _array_rows(prep), len(prep.features), len(prep.labels)
    scalings = fold_scalings(prep.data.where(F.col("is_test") == 0), prep.features, cfg.scaling_method, "fold", cfg.cv_folds)
    at = [(i, f) for i in range(len(points)) for f in range(cfg.cv_folds)]
    value = lambda p, i: points[i].get(p, est.getOrDefault(p))
    codes = [1] if k == 2 else list(range(k))
    w = logistic.fit_many(rows, d, [logistic.Problem(c, value(est.c, i), value(est.l1, i), f) for i, f in at for c in codes], scalings)
    w = w.reshape(len(at), len(codes), d + 1)
    counts = logistic.confusions(rows, d, k, [(f, w[j]) for j, (_, f) in enumerate(at)], scalings)
    scores = [[0.0] * cfg.cv_folds for _ in points]
    for j, (i, f) in enumerate(at):
        scores[i][f] = logistic.weighted_f1(counts[j])
    return _summary(points, scores)


def _cross_validate_kernel(prep: Prepared, est, points: list, cfg) -> CrossValidated:
    """All points and folds in the same scans, as the logistic grid."""
    rows, d = _array_rows(prep), len(prep.features)
    scalings = fold_scalings(prep.data.where(F.col("is_test") == 0), prep.features, cfg.scaling_method, "fold", cfg.cv_folds)
    at = [(i, f) for i in range(len(points)) for f in range(cfg.cv_folds)]
    problems = [kernel.Problem(*[points[i].get(p, est.getOrDefault(p)) for p in (est.c, est.epsilon, est.gamma)], f) for i, f in at]
    found = kernel.fit_many(rows, d, problems, scalings, est.getOrDefault(est.landmarks), est.getOrDefault(est.seed))
    errors = kernel.squared_errors(rows, d, [(f, m) for (_, f), m in zip(at, found)], scalings)
    scores = [[0.0] * cfg.cv_folds for _ in points]
    for (i, f), e in zip(at, errors):
        scores[i][f] = float(e)
    return _summary(points, scores)


def _staged_by(est) -> tuple[str, ...]:
    """The parameters of an ensemble whose grid values all follow from one fit at the largest."""
    if isinstance(est, (M.RandomForestClassifier, M.RandomForestRegressor)):
        return "numTrees", "maxDepth"
    tree = est.getClassifier() if isinstance(est, M.OneVsRest) else est
    return ("maxIter",) if isinstance(tree, (M.GBTClassifier, M.GBTRegressor)) else ()


def _cross_validate_staged(prep: Prepared, est, points: list, cfg, task: str, min_splits: tuple = (None,)) -> CrossValidated:
    """One fit per fold and combination of the parameters that change splits, scored for all sizes, depths and least node sizes
    (``staged.Variant``).  With ``min_splits`` every point is scored once for each of them, in turn."""
    staged_names, forest = _staged_by(est), isinstance(est, (M.RandomForestClassifier, M.RandomForestRegressor))
    tree = est.getClassifier() if isinstance(est, M.OneVsRest) else est
    k, checked = len(prep.labels) if prep.labels else 0, checkpoint_root(prep.data.sparkSession)
    assert checked  # tree fits keep their node ids there
    value = lambda p, name: {q.name: v for q, v in p.items()}.get(name, tree.getOrDefault(name))
    fits: dict[tuple, list[int]] = {}
    for i, p in enumerate(points):
        fits.setdefault(tuple(sorted((q.name, v) for q, v in p.items() if q.name not in staged_names)), []).append(i)
    scores = [[0.0] * cfg.cv_folds for _ in range(len(points) * len(min_splits))]
    train = prep.data.where(F.col("is_test") == 0)
    for f in range(cfg.cv_folds):
        rows = train.where(F.col("fold") != f)
        pre = M.inputs(prep.features, cfg.scaling_method).fit(rows)
        # fitted on the partitions of the written training rows, as a chain is: Spark draws rows by partition, and files read back come in another order
        fit_on, check_on = pre.transform(rows).select("features", "label"), _vectors(pre, train.where(F.col("fold") == f))

        def one_fit(item):
            fixed, members = item
            most = {name: max(value(points[i], name) for i in members) for name in staged_names}
            one = est.fit(fit_on, {tree.getParam(name): v for name, v in (*fixed, *most.items())})
            sizes = sorted({value(points[i], staged_names[0]) for i in members})
            cut = lambda i, m: staged.Variant(value(points[i], "maxDepth"), m) if forest else staged.Variant()
            variants = list(dict.fromkeys(cut(i, m) for i in members for m in min_splits))
            models = list(one.models) if isinstance(est, M.OneVsRest) else [one]
            found = staged.scores(check_on, models, sizes, variants, k, boosted=not forest)
            for i in members:
                for j, m in enumerate(min_splits):
                    r = found[value(points[i], staged_names[0]), cut(i, m)]
                    scores[i * len(min_splits) + j][f] = logistic.weighted_f1(r) if k else float(r[1] / max(r[0], 1))

        with ThreadPool(max(1, cfg.parallelism)) as pool:
            pool.map(inheritable_thread_target(prep.data.sparkSession)(one_fit), fits.items(), chunksize=1)
    spread = [p if m is None else {**{q.name: v for q, v in p.items()}, "minSplit": m} for p in points for m in min_splits]
    return _summary(spread, scores)


def forest_grid(prep: Prepared, cfg, task: str, min_splits: tuple = (2, 5, 10)) -> CrossValidated:
    """The whole grid of the forest, least node sizes included: trees x depth x leaf x split from one fit per leaf size and fold.

    Points are dicts.  ``minSplit`` has no parameter in Spark's forest; a model with it is scored from its nodes (``haze.plans.staged``).
    """
    est, params = _estimator(prep, "forest", cfg, task, {})
    return _cross_validate_staged(prep, est, M.grid("forest", params, prep.n_train, task, cfg.grid), cfg, task, min_splits)


def chained(pre: PipelineModel, fitted) -> PipelineModel:
    """Scaler, assembler and model as one; one-against-the-rest margins get probabilities."""
    margins = isinstance(fitted, OneVsRestModel) or isinstance(fitted, BoostedTreesModel) and fitted.getOrDefault(fitted.numModels) > 1
    after = [MarginProbabilities()] if margins else []
    return PipelineModel(stages=[*pre.stages, fitted, *after])


def fit_model(prep: Prepared, name: str, cfg, task: str, tune: bool | None = None, cv: bool = True, **model_kw):
    """Tune (k-fold on the fold column) or just cross-validate one model; the best point is fitted again
    on all training rows.  Returns (PipelineModel, cv_mean, cv_std, CrossValidated); without ``cv`` the
    model is only fitted and the scores are None."""
    checkpoint_root(prep.data.sparkSession)  # tree models keep their node ids there
    tune = cfg.use_hyperparameter_tuning if tune is None else tune
    est, params = _estimator(prep, name, cfg, task, model_kw)
    points = (M.grid(name, params, prep.n_train, task, cfg.grid) if tune else []) or [{}]
    best, scored = 0, None
    if cv or len(points) > 1:
        scored = cross_validate(prep, est, points, cfg, task)
        best = (max if task == "classification" else min)(range(len(points)), key=lambda i: scored.means[i])
    train = prep.data.where(F.col("is_test") == 0)
    pre = M.inputs(prep.features, cfg.scaling_method).fit(train)
    vectors = _vectors(pre, train)
    fitted = trees.fitted(est.copy(points[best]), vectors)
    model = chained(pre, fitted)
    if scored is None:
        return model, None, None, None
    return model, scored.means[best], scored.stds[best], scored


def cross_val_scores(prep: Prepared, name: str, cfg, task: str, **model_kw) -> DataFrame:
    """Score of one model on each fold (fit on the other folds): a (fold, score) table."""
    est, _ = _estimator(prep, name, cfg, task, model_kw)
    scores = cross_validate(prep, est, [{}], cfg, task).folds[0]
    return prep.data.sparkSession.createDataFrame(list(enumerate(scores)), "fold int, score double")


def _class_scores(pred: DataFrame, n_classes: int) -> tuple[str, DataFrame]:
    col = "probability" if "probability" in pred.columns else "rawPrediction"
    return col, pred.withColumn("_p", vector_to_array(F.col(col)))


def evaluate_classifier(model: PipelineModel, test: DataFrame, n_classes: int) -> dict:
    pred = model.transform(test)
    # written once: several scans follow, and each would predict again
    pred = written(pred.select("label", "prediction", *[c for c in ("probability", "rawPrediction") if c in pred.columns]), "judged")
    m = metrics.classification_metrics(pred.select(F.col("label").alias("y"), F.col("prediction").alias("y_hat"))).first()
    _col, scored = _class_scores(pred, n_classes)
    if n_classes == 2:
        auc = metrics.roc_auc(scored.select("label", F.col("_p")[1].alias("s")), F.col("label") == 1.0, "s").first()["auc"]
    else:
        long = scored.select("label", F.posexplode("_p").alias("cls", "s")).withColumn("cls", F.col("cls").cast("double"))
        ovr = metrics.roc_auc_ovr(long, "label", "cls", "s")
        auc = ovr.where(F.col("cls") == "weighted").first()["auc"]
    return {"accuracy": m["accuracy"], "precision": m["precision"], "recall": m["recall"], "f1": m["f1"], "roc_auc": auc}


def evaluate_regressor(model: PipelineModel, test: DataFrame) -> dict:
    pred = written(model.transform(test).select("label", "prediction"), "judged")
    m = metrics.regression_metrics(pred.select(F.col("label").alias("y"), F.col("prediction").alias("y_hat")),
                                   msle=False).first()
    return {k: m[k] for k in ("r2", "mse", "rmse", "mae", "mape", "explained_variance")}


def result_tables(model: PipelineModel, prep: Prepared, task: str) -> dict[str, DataFrame]:
    """The tables behind a model's report on the hold-out rows.

    Classification: confusion (by class name), roc (per class, from (0, 0)) and importance; regression:
    actual against predicted, residuals and importance.  Models without importances leave it out.
    """
    pred = model.transform(prep.data.where(F.col("is_test") == 1))
    out: dict[str, DataFrame] = {}
    try:
        out["importance"] = feature_importance(model, prep.features)
    except ValueError:
        pass
    if task == "regression":
        both = pred.select(F.col("label").alias("y"), F.col("prediction").alias("y_hat"))
        out["actual_predicted"] = both
        out["residuals"] = both.withColumn("residual", F.col("y") - F.col("y_hat"))
        return out
    names = F.array(*[F.lit(n) for n in prep.labels])
    named = lambda c: F.get(names, F.col(c).cast("int"))
    out["confusion"] = metrics.confusion_matrix(pred.select(named("label").alias("y"), named("prediction").alias("y_hat")))
    _, scored = _class_scores(pred, len(prep.labels))
    long = scored.select("label", F.posexplode("_p").alias("code", "score")).select(
        F.get(names, F.col("code")).alias("cls"), (F.col("label") == F.col("code")).alias("is_cls"), "score")
    out["roc"] = metrics.roc_curve(long, F.col("is_cls"), "score", by=["cls"])
    return out


def train(df: DataFrame, cfg, task: str) -> TrainResult:
    """Fit every configured model, evaluate on the hold-out, rank, keep the best."""
    prep = prepare(df, cfg, task)
    test = prep.data.where(F.col("is_test") == 1)
    rows, fitted, tables = [], {}, {}
    names = M.CLASSIFIER_NAMES if task == "classification" else M.REGRESSOR_NAMES
    for pos, name in enumerate(cfg.models):
        model, cv_mean, cv_std, _ = fit_model(prep, name, cfg, task, **cfg.model_params.get(name, {}))
        fitted[name] = model
        tables[name] = {k: written(t, f"{name}-{k}") for k, t in result_tables(model, prep, task).items()}
        if task == "classification":
            r = evaluate_classifier(model, test, len(prep.labels))
            r.update(cv_f1_mean=cv_mean, cv_f1_std=cv_std)
        else:
            r = evaluate_regressor(model, test)
            r.update(cv_rmse_mean=cv_mean ** 0.5, cv_mse_std_sqrt=cv_std ** 0.5)
        rows.append({"model": names[name], "key": name, "pos": pos, **r})
    score = "f1" if task == "classification" else "r2"
    # strict '>' while scanning in listing order: the first listed model wins a tie
    best = None
    for r in rows:
        if best is None or (r[score] is not None and r[score] > best[score]):
            best = r
    spark = df.sparkSession
    results = spark.createDataFrame(rows).orderBy(F.desc(score), F.asc("pos"))
    meta = files.run_metadata(spark, best["model"], prep.features, cfg.to_dict(), {"task": task})
    if cfg.out_dir:
        stamp = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
        fitted[best["key"]].write().overwrite().save(f"{cfg.out_dir}/models/best_{task}_model_{stamp}")
        if prep.label_model is not None:
            prep.label_model.write().overwrite().save(f"{cfg.out_dir}/models/label_encoder_{stamp}")
        results.write.mode("overwrite").option("header", True).csv(f"{cfg.out_dir}/output/{task}_results")
        files.write_metadata(meta, f"{cfg.out_dir}/output/{task}_model_info")
        for name, found in tables.items():
            for k, t in found.items():
                t.write.mode("overwrite").option("header", True).csv(f"{cfg.out_dir}/output/{task}_{name}_{k}")
    return TrainResult(results, best["model"], fitted[best["key"]], prep.features, prep.labels, fitted, meta, tables)


def train_classification(df: DataFrame, cfg: ClassificationConfig | None = None) -> TrainResult:
    return train(df, cfg or ClassificationConfig(), "classification")


def train_regression(df: DataFrame, cfg: RegressionConfig | None = None) -> TrainResult:
    return train(df, cfg or RegressionConfig(), "regression")


def predict(model: PipelineModel, df: DataFrame, features: list[str], labels: list[str] | None = None,
            keep: list[str] | None = None) -> DataFrame:
    """Predict with a fitted chain on the chosen features; class codes are decoded to names."""
    quality.require_columns(df, features)
    out = model.transform(df.select(*(keep or []), *features))
    cols = [*(keep or []), "prediction"]
    if labels:
        out = feat.label_decode(out, "prediction", labels, "predicted_label")
        cols.append("predicted_label")
    return out.select(*cols)


def feature_importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """(feature, importance) sorted descending: tree importances, or mean |coefficient| for linear models."""
    import numpy as np
    last = next(s for s in reversed(model.stages) if not isinstance(s, MarginProbabilities))
    inner = getattr(last, "models", None)
    if hasattr(last, "featureImportances"):
        imp = last.featureImportances.toArray()
    elif inner:
        vals = []
        for m in inner:
            if hasattr(m, "featureImportances"):
                vals.append(m.featureImportances.toArray())
            else:
                vals.append(np.abs(m.coefficients.toArray()))
        imp = np.mean(vals, axis=0)
    elif hasattr(last, "coefficientMatrix"):
        imp = np.abs(last.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(last, "coefficients"):
        imp = np.abs(last.coefficients.toArray())
    else:
        raise ValueError("model has neither importances nor coefficients")
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
