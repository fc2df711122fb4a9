"""Schema and data-quality checks (plan-time where possible, one small action otherwise)."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class DataQualityError(ValueError):
    pass


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Raise listing every missing column (checked on the schema, no job)."""
    missing = missing_columns(df, required)
    if missing:
        raise DataQualityError(f"Missing required columns: {missing}")
    return df


def is_nonempty(df: DataFrame) -> bool:
    return not df.isEmpty()


def require_nonempty(df: DataFrame, what: str = "Input data") -> DataFrame:
    """Raise when the frame has no row (a LIMIT 1 job, never a full count)."""
    if not is_nonempty(df):
        raise DataQualityError(f"{what} is empty")
    return df


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop the columns that exist; absent names are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns in schema order (booleans are not numbers here)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def select_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    require_columns(df, cols)
    return df.select(*cols)


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in any (or the given) column; NaN counts as missing."""
    cols = subset or df.columns
    cond = None
    for c in cols:
        dt = df.schema[c].dataType
        ok = F.col(c).isNotNull()
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            ok = ok & ~F.isnan(c)
        cond = ok if cond is None else cond & ok
    return df if cond is None else df.where(cond)


def in_range(col: str | Column, lo: float, hi: float) -> Column:
    """Inclusive range predicate."""
    c = F.col(col) if isinstance(col, str) else col
    return c.between(F.lit(lo), F.lit(hi))


def align_columns(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """Select exactly ``columns`` in that order; absent ones become ``fill``, extra ones are dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).cast("double").alias(c) for c in columns])


def check_feature_width(train_cols: list[str], test_cols: list[str]) -> None:
    if len(train_cols) != len(test_cols):
        raise DataQualityError(
            f"Feature mismatch: train has {len(train_cols)} features, test has {len(test_cols)}")


def unseen_labels(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Labels present in ``test`` but not in ``train`` (anti join on the distinct labels)."""
    t = test.select(label).where(F.col(label).isNotNull()).distinct()
    return t.join(train.select(label).distinct(), on=label, how="left_anti")


def warn_unseen_labels(train: DataFrame, test: DataFrame, label: str) -> list:
    found = [r[0] for r in unseen_labels(train, test, label).collect()]
    if found:
        log.warning("Test set has labels not seen in training: %s", found)
    return found


def distinct_count(df: DataFrame, col: str) -> int:
    return df.agg(F.count_distinct(col)).first()[0]


def require_several_classes(df: DataFrame, label: str) -> int:
    n = distinct_count(df, label)
    if n < 2:
        raise DataQualityError(f"Need at least 2 classes in '{label}', found {n}")
    return n


def min_group_size(df: DataFrame, group: str, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """Split rows into kept groups (>= min_rows) and a per-group report of the skipped ones.

    Group sizes come from one partial/final aggregation; the kept rows are a
    semi join on the (small, one row per group) size table.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    keep = sizes.where(F.col("n_rows") >= min_rows).select(group)
    skipped = sizes.where(F.col("n_rows") < min_rows)
    return df.join(keep, on=group, how="left_semi"), skipped


def head(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """First ``n`` rows in a stated order (a top-k: only n rows leave each task)."""
    return df.orderBy(*order_by).limit(n)
