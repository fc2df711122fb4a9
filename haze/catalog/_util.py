"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haze.sources.tables import view, view_sql  # noqa: F401  (re-exported)

PLACES = 6


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Round every double column (the oracle rounds the same way)."""
    return df.select(*[
        F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name) for f in df.schema.fields])


class Views:
    """Lazily built fixture views for one (spark, sf_dir), shared inside one query."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir, self._cache = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self._cache)
