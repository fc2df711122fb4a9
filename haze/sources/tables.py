"""Driver tables and the fixture views built on them.

Every fixture view is one SQL text with ``{table}`` placeholders.  Spark runs
it through ``spark.sql(text, **dataframes)`` (the DataFrames become
parameters, no named temp views are left behind); the DuckDB oracle runs
the same text with the placeholders replaced by its pre-registered views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixture views (see FIXTURES.md §3).  Column order of `readings` is the raw
# reading order; it matters for the outlier cascade.
VIEWS: dict[str, str] = {
    "readings": """
        SELECT event_id AS reading_id, event_type AS city, CAST(ts AS TIMESTAMP) AS ts,
               value AS pm25, value AS aqi,
               CAST(15 + user_id % 20 AS DOUBLE) AS temperature,
               CAST(40 + event_id % 50 AS DOUBLE) AS humidity,
               CAST(1000 + user_id % 30 AS DOUBLE) AS pressure,
               CAST(event_id % 120 AS DOUBLE) / 10 AS wind_speed
        FROM {events}""",
    "readings_gaps": """
        SELECT reading_id, CASE WHEN reading_id % 17 = 5 THEN NULL ELSE city END AS city, ts,
               CASE WHEN reading_id % 10 = 3 THEN NULL ELSE pm25 END AS pm25,
               aqi, temperature,
               CASE WHEN reading_id % 13 = 7 THEN NULL ELSE humidity END AS humidity,
               pressure, wind_speed
        FROM {readings}""",
    "readings_dups": """
        SELECT * FROM {readings}
        UNION ALL
        SELECT reading_id + 1000000 AS reading_id, city, ts, pm25 + 1 AS pm25, aqi, temperature,
               humidity, pressure, wind_speed
        FROM {readings} WHERE reading_id % 5 = 0""",
    "readings_signal": """
        SELECT *, 2 * temperature - 0.5e0 * humidity + 3 * wind_speed + pm25 / 50 AS target
        FROM {readings}""",
    "shipments": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
               l_discount, l_tax, l_returnflag, l_shipdate
        FROM {lineitem}""",
    "pred_class": """
        SELECT event_id, event_type AS y,
               CASE WHEN event_id % 4 = 0 THEN 'error' ELSE event_type END AS y_hat,
               value AS score
        FROM {events}""",
    "pred_reg": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice / 1000.0e0 AS y,
               l_extendedprice / 1000.0e0 * 0.9e0 + l_quantity / 10.0e0 AS y_hat
        FROM {lineitem}""",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def _deps(name: str) -> list[str]:
    return _PLACEHOLDER.findall(VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str, _cache: dict | None = None) -> DataFrame:
    """A driver table or fixture view as a Spark DataFrame (lazy; nothing is read yet)."""
    cache = {} if _cache is None else _cache
    if name in cache:
        return cache[name]
    if name in TABLES:
        df = read_table(spark, sf_dir, name)
    else:
        args = {d: view(spark, sf_dir, d, cache) for d in set(_deps(name))}
        df = spark.sql(VIEWS[name], **args)
    cache[name] = df
    return df


def view_sql(*names: str) -> str:
    """A DuckDB ``WITH`` prefix defining the given fixture views (and what they need)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in TABLES or n in order:
            return
        for d in _deps(n):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({_PLACEHOLDER.sub(lambda m: m.group(1), VIEWS[n]).strip()})" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
