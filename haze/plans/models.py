"""Spark ML estimators, scaler+model chains and parameter grids for the reference's models.

Mapping of the reference's models (scikit-learn / XGBoost) to Spark ML:

* logistic regression → ``haze.functions.logistic``: one against the rest, l1 or
  l2 penalty on all weights including the intercept, whole grids in shared scans
* random forest → ``RandomForest*`` (depth None → 30, Spark's cap;
  ``min_samples_leaf`` → ``minInstancesPerNode``; ``min_samples_split`` is
  applied to the fitted nodes, see ``haze.plans.staged``)
* boosted trees (XGBoost) → ``GBT*``; more than two classes:
  ``OneVsRest(GBTClassifier)``, probabilities by ``haze.functions.probabilities``
* RBF support-vector regression → ``haze.functions.kernel``: the same loss and
  penalty on Nystroem landmarks, whole grids in shared scans
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder

from haze.functions.kernel import AUTO, SCALE, KernelRegression
from haze.functions.logistic import OneVsRestLogistic
from haze.functions.scalers import ExactScaler

MAX_DEPTH = 30  # Spark's tree depth cap stands for "no limit"
# Deep trees: let each pass over the data grow more nodes, and keep node ids per row between levels
# (checkpointed to spark.checkpoint.dir) instead of re-walking every tree from the root.
TREE_SPEED = dict(maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10)

CLASSIFIER_NAMES = {"logistic": "Logistic Regression", "forest": "Random Forest", "gbt": "Gradient Boosting",
                    "tree": "Decision Tree"}
REGRESSOR_NAMES = {"forest": "Random Forest", "gbt": "Gradient Boosting", "rbf": "Support Vector Regression",
                   "linear": "Linear Regression", "tree": "Decision Tree"}


def classifier(name: str, n_classes: int, n_train: int, seed: int = 42, **kw):
    """(estimator, params object to grid over) for a classifier name."""
    multi = n_classes > 2
    if name == "logistic":
        lr = OneVsRestLogistic(numClasses=n_classes, c=kw.get("C", 1.0), l1=kw.get("l1", False))
        return lr, lr
    if name == "forest":
        rf = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=kw.get("numTrees", 100),
                                    maxDepth=kw.get("maxDepth", 15), minInstancesPerNode=kw.get("minLeaf", 1),
                                    featureSubsetStrategy="sqrt", seed=seed, **TREE_SPEED)
        return rf, rf
    if name == "gbt":
        gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=kw.get("maxIter", 100),
                            maxDepth=kw.get("maxDepth", 6), stepSize=kw.get("stepSize", 0.3),
                            subsamplingRate=kw.get("subsample", 1.0), seed=seed, **TREE_SPEED)
        if multi:
            return OneVsRest(classifier=gbt, featuresCol="features", labelCol="label",
                             parallelism=min(n_classes, 4)), gbt
        return gbt, gbt
    if name == "tree":
        t = DecisionTreeClassifier(featuresCol="features", labelCol="label", maxDepth=kw.get("maxDepth", MAX_DEPTH), seed=seed,
                                   maxMemoryInMB=1024)
        return t, t
    raise ValueError(f"unknown classifier {name!r}")


def regressor(name: str, seed: int = 42, **kw):
    if name == "forest":
        rf = RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=kw.get("numTrees", 100),
                                   maxDepth=kw.get("maxDepth", 15), minInstancesPerNode=kw.get("minLeaf", 2),
                                   featureSubsetStrategy="all", seed=seed, **TREE_SPEED)
        return rf, rf
    if name == "gbt":
        g = GBTRegressor(featuresCol="features", labelCol="label", maxIter=kw.get("maxIter", 100),
                         maxDepth=kw.get("maxDepth", 6), stepSize=kw.get("stepSize", 0.1),
                         subsamplingRate=kw.get("subsample", 0.8), seed=seed, **TREE_SPEED)
        return g, g
    if name == "rbf":
        svr = KernelRegression(c=kw.get("C", 1.0), epsilon=kw.get("epsilon", 0.1), gamma=kw.get("gamma", SCALE), seed=seed)
        return svr, svr
    if name == "linear":
        lin = LinearRegression(featuresCol="features", labelCol="label", regParam=0.0, solver="normal")
        return lin, lin
    if name == "tree":
        t = DecisionTreeRegressor(featuresCol="features", labelCol="label", maxDepth=kw.get("maxDepth", MAX_DEPTH), seed=seed,
                                  maxMemoryInMB=1024)
        return t, t
    raise ValueError(f"unknown regressor {name!r}")


def inputs(features: list[str], scaling: str) -> Pipeline:
    """Scaler → assembler: fitted once per fold, shared by every point of a grid."""
    return Pipeline(stages=[ExactScaler(inputCols=features, method=scaling),
                            VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")])


def chain(features: list[str], scaling: str, estimator) -> Pipeline:
    """Scaler → assembler → model as one estimator."""
    return Pipeline(stages=[*inputs(features, scaling).getStages(), estimator])


def grid(name: str, params, n_train: int, task: str, size: str = "full"):
    """Parameter grid (list of ParamMaps) for a model (fixed values), or its 2-point version for tests."""
    b = ParamGridBuilder()
    small = size == "small"
    if name == "logistic":
        b.addGrid(params.c, [1.0, 10.0] if small else [0.1, 1.0, 10.0, 100.0])
        if not small:
            b.addGrid(params.l1, [True, False])
    elif name == "forest":
        b.addGrid(params.numTrees, [10, 20] if small else [50, 100, 200])
        if not small:
            b.addGrid(params.maxDepth, [10, 15, 20, MAX_DEPTH])
            b.addGrid(params.minInstancesPerNode, [1, 2, 4])
    elif name == "gbt":
        b.addGrid(params.maxIter, [10, 20] if small else [50, 100, 200])
        if not small:
            b.addGrid(params.stepSize, [0.05, 0.1, 0.2])
            b.addGrid(params.maxDepth, [3, 5, 7])
            b.addGrid(params.subsamplingRate, [0.8, 0.9, 1.0])
    elif name == "rbf":
        b.addGrid(params.c, [1.0, 10.0] if small else [0.1, 1.0, 10.0, 100.0])
        if not small:
            b.addGrid(params.gamma, [SCALE, AUTO, 0.001, 0.01, 0.1, 1.0])
            b.addGrid(params.epsilon, [0.01, 0.1, 0.2, 0.5])
    elif name in ("tree", "linear"):
        pass
    else:
        raise ValueError(f"no grid for {name!r}")
    return b.build()
