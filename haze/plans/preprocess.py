"""Batch preprocessing of raw readings (validate, fill, dedupe, band, encode, scale)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.functions import features, scalers
from haze.operators import clean, dedupe, quality
from haze.sources.files import READING

# from the fixed schema of a reading
REQUIRED = [f.name for f in READING.fields if f.name != "reading_id"]
NUMERIC = [f.name for f in READING.fields if f.dataType.typeName() == "double"]


@dataclass
class PreprocessConfig:
    keys: list[str] = field(default_factory=lambda: ["city", "ts"])
    order_col: str = "reading_id"
    numeric: list[str] = field(default_factory=lambda: list(NUMERIC))
    band_col: str = "aqi"
    scale_method: str = "standard"
    check_nonempty: bool = True


def clean_readings(df: DataFrame, cfg: PreprocessConfig | None = None) -> DataFrame:
    """Validate → parse time → median fill (before dedupe, as the reference does) →
    drop incomplete rows → keep-first dedupe on (city, ts) → AQI band.

    The band is taken *before* scaling (scaling first would put every row
    in one band).
    """
    cfg = cfg or PreprocessConfig()
    quality.require_columns(df, REQUIRED)
    if cfg.check_nonempty:
        quality.require_nonempty(df)
    if dict(df.dtypes)["ts"] == "string":
        df = clean.parse_timestamp(df, "ts")
    df = clean.impute_median(df, cfg.numeric)
    df = quality.drop_null_rows(df)
    df = dedupe.dedupe_keep_first(df, cfg.keys, cfg.order_col)
    return df.withColumn("aqi_class", features.aqi_band(F.col(cfg.band_col)))


def preprocess(df: DataFrame, cfg: PreprocessConfig | None = None) -> DataFrame:
    """Full preprocessing: ``clean_readings`` + one-hot city + exact scaling of the numeric columns."""
    cfg = cfg or PreprocessConfig()
    cleaned = clean_readings(df, cfg)
    encoded = features.one_hot(cleaned, "city", prefix="city")
    return scalers.scale(encoded, cfg.numeric, cfg.scale_method)
