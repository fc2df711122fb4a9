"""Run configurations (defaults follow the reference's own defaults)."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

OUTLIER_METHODS = ("iqr", "zscore")
SCALING_METHODS = ("robust", "standard", "minmax")
SELECTION_METHODS = ("selectk", "rfe", "both")


@dataclass
class _Common:
    target_column: str
    key: list[str] = field(default_factory=lambda: ["reading_id"])
    test_size: float = 0.2
    random_state: int = 42
    cv_folds: int = 5
    outlier_method: str = "iqr"
    scaling_method: str = "robust"
    feature_selection: str = "selectk"
    use_hyperparameter_tuning: bool = True
    grid: str = "full"            # "full" = the reference's grids, "small" = two points per model
    parallelism: int = 2          # models fitted at once inside a grid search
    exclude_derived: bool = False  # drop features computed from the label source (off = reference)
    select_on_train: bool = False  # choose features on the training rows only (off = reference)
    out_dir: str | None = None
    model_params: dict = field(default_factory=dict)  # per model name: constructor overrides

    def validate(self):
        if self.outlier_method not in OUTLIER_METHODS:
            raise ValueError(f"outlier_method must be one of {OUTLIER_METHODS}")
        if self.scaling_method not in SCALING_METHODS:
            raise ValueError(f"scaling_method must be one of {SCALING_METHODS}")
        if self.feature_selection not in SELECTION_METHODS:
            raise ValueError(f"feature_selection must be one of {SELECTION_METHODS}")
        if not 0.0 < self.test_size < 1.0:
            raise ValueError("test_size must be in (0, 1)")
        if self.cv_folds < 2:
            raise ValueError("cv_folds must be at least 2")
        return self

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class ClassificationConfig(_Common):
    target_column: str = "aqi_class"
    max_features: int = 15
    use_stratified_split: bool = True
    models: list[str] = field(default_factory=lambda: ["logistic", "forest", "gbt"])
    label_source: str = "pm25"    # tercile labels are built from this column when the target is absent


@dataclass
class RegressionConfig(_Common):
    target_column: str = "pm25"
    max_features: int = 10
    models: list[str] = field(default_factory=lambda: ["forest", "gbt", "rbf"])
