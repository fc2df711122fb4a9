"""Averaged per-group linear model: hold-out → per-group OLS → weighted average → score → metrics.

Refitting the same data round after round changes nothing, so one pass is the whole computation.
Features are all numeric columns and the one-hot coded text columns (without the first
category), less target, key and a drop list; test rows get exactly the columns fitted on train.
The shared scaler is fitted on the training rows.  The split flag stays on the row: train and test are
filters, and one aggregation gives every group's size and statistics, so nothing is joined back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.functions import features as feat
from haze.functions import scalers
from haze.operators import grouped, metrics, quality, split


@dataclass
class GroupedModelConfig:
    group: str = "city"
    features: list[str] | None = None   # None: all columns, as described above
    drop: list[str] = field(default_factory=lambda: ["ts"])
    target: str = "target"
    key: list[str] = field(default_factory=lambda: ["reading_id"])
    scale: bool = True
    test_size: float = 0.1
    min_samples: int = 20
    seed: int = 42

    def __post_init__(self):
        if not 0.0 < self.test_size < 1.0:
            raise ValueError("test_size must be in (0, 1)")
        if self.min_samples < 2:
            raise ValueError("min_samples must be at least 2")


@dataclass
class GroupedModelResult:
    per_group: DataFrame
    averaged: DataFrame
    skipped: DataFrame
    scored: DataFrame
    metrics: DataFrame
    features: list[str]


def run(df: DataFrame, cfg: GroupedModelConfig | None = None) -> GroupedModelResult:
    cfg = cfg or GroupedModelConfig()
    quality.require_columns(df, [cfg.group, cfg.target, *(cfg.features or []), *cfg.key])
    data = quality.drop_null_rows(df, [cfg.target])
    marked = split.fraction_sample(data, cfg.key, cfg.test_size, cfg.seed, out="_test")
    train, test = marked.where(F.col("_test") == 0), marked.where(F.col("_test") == 1)
    names = cfg.features
    if names is None:
        out = {cfg.target, *cfg.key, *cfg.drop, "_test"}
        texts = quality.string_columns(df, exclude=tuple(out))
        numbers = quality.numeric_columns(df, exclude=tuple(out))
        coded = marked
        for c in texts:
            values = feat.category_values(train, c)
            coded = feat.one_hot(coded, c, drop_first=True, values=values, keep_source=True)
            numbers += [f"{c}_{v}" for v in values[1:]]
        names = numbers
        train, test = coded.where(F.col("_test") == 0), coded.where(F.col("_test") == 1)
        test = test.select(*[F.col(f"`{c}`") for c in train.columns])
    if cfg.scale:
        centers, divisors = scalers.fit_scaling(train, names, "standard")
        train, test = (scalers.apply_scaling(d, names, centers, divisors) for d in (train, test))
    stats = grouped.sufficient_stats(train, cfg.group, names, cfg.target)
    skipped = stats.where(F.col("n") < cfg.min_samples).select(cfg.group, F.col("n").alias("n_rows"))
    per_group = grouped.solve_ols(stats.where(F.col("n") >= cfg.min_samples), cfg.group, names)
    averaged = grouped.average_models(per_group, names)
    scored = grouped.linear_score(test.drop("_test"), averaged, names)
    m = metrics.regression_metrics(scored, cfg.target, "y_hat")
    return GroupedModelResult(per_group, averaged, skipped, scored, m, names)
