"""Keep-first de-duplication, bag union and append-with-dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_keep_first(df: DataFrame, keys: list[str], order_by: str | list[str]) -> DataFrame:
    """One row per key: the first one in ``order_by`` order (pandas ``drop_duplicates(keep='first')``).

    Written as a hash aggregation with ``min_by`` rather than a window: the
    aggregation combines map-side, so a hot key (many copies) is reduced in
    every input task before the shuffle instead of landing whole in one sort.
    Null keys form one group, as in pandas.  A null order value comes last; equal order values are
    settled by the other columns, so the surviving row does not depend on how rows are dealt.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.dropDuplicates(keys)
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    ties = [c for c in others if c not in order and kinds[c] not in ("map", "variant")]
    order_key = F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))],
                         *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)])
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in others]), order_key).alias("_first"))
    return first.select(*[F.col(k) for k in keys], *[F.col(f"_first.{c}").alias(c) for c in others]).select(*df.columns)


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Bag union matching columns by name; a column missing on one side is null there."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def append_dedupe(history: DataFrame, new: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """History ∪ new rows, one row per key, history rows winning (they come first).

    ``order_by`` orders rows inside each side; the history side sorts before
    the new side.  Write the result to a new path, never over the one read.
    """
    h = history.withColumn("_side", F.lit(0))
    n = new.withColumn("_side", F.lit(1))
    both = union_by_name(h, n)
    return dedupe_keep_first(both, keys, ["_side", order_by]).drop("_side")
