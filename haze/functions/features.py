"""Column-expression features: time parts, interactions, bands, one-hot, label codes.

Everything here is a built-in expression (whole-stage codegen); the only
jobs are the small distinct-value / quantile lookups that a data-dependent
encoding needs before it can be written as expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haze.operators.quantile import exact_quantiles

EPS_RATIO = 1e-8

# EPA AQI bands, upper edges inclusive, in order.  Values above
# the last edge (and NaN) are "Hazardous".
AQI_BANDS = [
    (50.0, "Good"),
    (100.0, "Moderate"),
    (150.0, "Unhealthy for Sensitive Groups"),
    (200.0, "Unhealthy"),
    (300.0, "Very Unhealthy"),
]
AQI_TOP = "Hazardous"

# Left-closed bin edges for the notebook's digitised target.
DIGITIZE_EDGES = [0.0, 50.0, 100.0, float("inf")]


def add_time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """hour, day_of_week (Monday = 0), month, is_weekend (int) — only if ``ts`` exists."""
    if ts not in df.columns:
        return df
    t = F.col(ts)
    return (df.withColumn("hour", F.hour(t)).withColumn("day_of_week", F.weekday(t))
              .withColumn("month", F.month(t))
              .withColumn("is_weekend", (F.weekday(t) >= 5).cast("int")))


def ratio(num: Column, den: Column, eps: float = EPS_RATIO) -> Column:
    """num / (den + eps) without a divide-by-zero error under ANSI."""
    return F.try_divide(num, den + F.lit(eps))


def add_interaction_features(df: DataFrame, task: str = "classification") -> DataFrame:
    """Products and the temperature/humidity ratio, each only when its inputs exist."""
    cols = set(df.columns)
    if task == "classification" and {"pm25", "temperature"} <= cols:
        df = df.withColumn("pm25_temp_interaction", F.col("pm25") * F.col("temperature"))
    if {"temperature", "humidity"} <= cols:
        df = df.withColumn("temp_humidity_ratio", ratio(F.col("temperature"), F.col("humidity")))
    if task == "regression" and {"pressure", "temperature"} <= cols:
        df = df.withColumn("pressure_temp_interaction", F.col("pressure") * F.col("temperature"))
    return df


def safe_log1p(x: Column) -> Column:
    """ln(1 + x); null for x <= -1 (such rows are dropped later, as NaN would be)."""
    return F.when(x > F.lit(-1.0), F.log1p(x))


def add_poly_features(df: DataFrame, task: str = "classification") -> DataFrame:
    cols = set(df.columns)
    if task == "classification":
        if "pm25" in cols:
            df = df.withColumn("pm25_squared", F.col("pm25") * F.col("pm25")) \
                   .withColumn("pm25_log", safe_log1p(F.col("pm25")))
    else:
        if "wind_speed" in cols:
            df = df.withColumn("wind_speed_squared", F.col("wind_speed") * F.col("wind_speed"))
        if "aqi" in cols:
            df = df.withColumn("aqi_squared", F.col("aqi") * F.col("aqi")) \
                   .withColumn("aqi_log", safe_log1p(F.col("aqi")))
    return df


def engineer_features(df: DataFrame, task: str = "classification", ts: str = "ts") -> DataFrame:
    """Time + interaction + polynomial features, then rows with a missing feature are dropped."""
    from haze.operators.quality import drop_null_rows
    out = add_poly_features(add_interaction_features(add_time_features(df, ts), task), task)
    new_cols = [c for c in out.columns if c not in df.columns]
    return drop_null_rows(out, new_cols) if new_cols else out


def aqi_band(x: Column) -> Column:
    """EPA band name; null or NaN falls through to the top band, as in the reference."""
    expr = None
    for edge, name in AQI_BANDS:
        cond = x <= F.lit(edge)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(AQI_TOP))


def tercile_thresholds(df: DataFrame, col: str) -> tuple[float, float]:
    return tuple(exact_quantiles(df, [col], [0.33, 0.66])[col])


def tercile_class(x: Column, p33: float, p66: float) -> Column:
    return F.when(x <= F.lit(p33), "Low").when(x <= F.lit(p66), "Medium").otherwise("High")


def add_tercile_label(df: DataFrame, col: str = "pm25", label: str = "label") -> DataFrame:
    p33, p66 = tercile_thresholds(df, col)
    return df.withColumn(label, tercile_class(F.col(col), p33, p66))


def digitize(x: Column, edges: list[float] | None = None) -> Column:
    """numpy ``digitize(x, edges) - 1`` (left-closed bins): below the first edge -1,
    at or past the last edge (inf, NaN) ``len(edges) - 1``."""
    edges = DIGITIZE_EDGES if edges is None else edges
    top = len(edges) - 1
    expr = F.when(x.isNull() | F.isnan(x), F.lit(top))
    for i, e in enumerate(edges):
        expr = expr.when(x < F.lit(e), F.lit(i - 1))
    return expr.otherwise(F.lit(top)).cast("int")


def category_values(df: DataFrame, col: str) -> list:
    """Sorted distinct non-null values: the names of the columns that one-hot coding makes."""
    return sorted(r[0] for r in df.select(F.col(f"`{col}`")).where(F.col(f"`{col}`").isNotNull()).distinct().collect())


def one_hot(df: DataFrame, col: str, prefix: str | None = None, drop_first: bool = False,
            values: list | None = None, keep_source: bool = False) -> DataFrame:
    """One int column per sorted category ``{prefix}_{value}``; null gives all zeros.

    Names are used as they are; quote them (backticks) to read one that holds a dot.
    """
    vals = values if values is not None else category_values(df, col)
    if drop_first:
        vals = vals[1:]
    p = prefix or col
    flags = [F.coalesce((F.col(f"`{col}`") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{p}_{v}") for v in vals]
    rest = [F.col(f"`{c}`") for c in df.columns if keep_source or c != col]
    return df.select(*rest, *flags)


def label_index(df: DataFrame, label: str, out: str = "label_idx"):
    """Fit a StringIndexer with classes sorted a..z (0-based); returns (frame, fitted model).

    A null label keeps a null code and is no class.
    """
    from pyspark.ml.feature import StringIndexer
    known = df.where(F.col(label).isNotNull())
    model = StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc",
                          handleInvalid="keep").fit(known)
    code = F.when(F.col(label).isNotNull(), F.col(out)).cast("int")
    return model.transform(df).withColumn(out, code), model


def label_decode(df: DataFrame, index_col: str, labels: list[str], out: str = "label_decoded") -> DataFrame:
    from pyspark.ml.feature import IndexToString
    return IndexToString(inputCol=index_col, outputCol=out, labels=labels).transform(
        df.withColumn(index_col, F.col(index_col).cast("double")))
