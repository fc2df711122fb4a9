"""Table statistics and profile tables.

Rule: one aggregation job per stage for *all* columns (medians, moments,
correlations), never a job per column.  Every aggregate used here is
partial/final (map-side combine), so a hot group costs no single task more
than its share of input.

Quantiles are exact at any size; see ``haze.operators.quantile``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haze.operators.quantile import exact_quantiles, grouped_quantiles


def _pname(p: float) -> str:
    s = f"{p * 100:g}".replace(".", "_")
    return f"p{s}"


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Wide one-row table: ``{col}_{pNN}`` for every column and probability, exact."""
    found = exact_quantiles(df, cols, probs)
    return df.sparkSession.range(1).select(*[
        F.lit(v).cast("double").alias(f"{c}_{_pname(p)}") for c in cols for p, v in zip(probs, found[c])])


def medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Per-column median (nulls and NaN skipped) as a driver dict."""
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def _missing(c: str, dt) -> Column:
    m = F.col(c).isNull()
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        m = m | F.isnan(c)
    return m


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Long table (column, n_null): one aggregation over all columns, then unpivot."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(_missing(c, df.schema[c].dataType)).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_null")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count) descending, nulls excluded."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(col)))


def most_frequent(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent non-null value per column; a tie goes to the smallest value.

    All columns in one shuffle: rows are unpivoted to (column, value), counted
    with a partial aggregation, and the winner is a ``min_by`` over
    (-count, value).  Values come back as strings.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull())
    counts = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("neg_n"), F.col("value"))).alias("mode"),
        F.max("n").alias("n"))


def mean_std(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population standard deviation per column (long form)."""
    wide = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"))])
    return _to_long(wide, cols, ["mean", "std"])


def min_max(df: DataFrame, cols: list[str]) -> DataFrame:
    wide = df.agg(*[x for c in cols for x in (F.min(F.col(c).cast("double")).alias(f"{c}__min"),
                                              F.max(F.col(c).cast("double")).alias(f"{c}__max"))])
    return _to_long(wide, cols, ["min", "max"])


def _to_long(wide: DataFrame, cols: list[str], stats: list[str]) -> DataFrame:
    """One-row wide stats ``{col}__{stat}`` to one row per column."""
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in cols
    ])).alias("r")).select("r.*")


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 %, max per column: one aggregation and exact quantiles."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    found = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    wide = df.agg(*aggs).select("*", *[F.lit(v).cast("double").alias(f"{c}__{p}") for c in cols
                                       for p, v in zip(("p25", "p50", "p75"), found[c])])
    return _to_long(wide, cols, ["count", "mean", "std", "min", "p25", "p50", "p75", "max"])


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def pearson(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson r; null when either side is constant (no divide error)."""
    both = a.isNotNull() & b.isNotNull()
    aa = F.when(both, a)
    bb = F.when(both, b)
    return F.try_divide(F.covar_pop(aa, bb), F.stddev_pop(aa) * F.stddev_pop(bb))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """All-pairs Pearson matrix in long form (col_a, col_b, corr): one aggregation.

    d(d-1)/2 co-moment aggregates ride in one pass; the symmetric half and the
    diagonal are filled in on the one-row result.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "col_a string, col_b string, corr double")
    wide = df.agg(*[pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    entries = []
    for i, (a, b) in enumerate(pairs):
        entries.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"{i}").alias("corr")))
        entries.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"{i}").alias("corr")))
    for c in cols:
        entries.append(F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.lit(1.0).alias("corr")))
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def nullity_corr(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Correlation of missingness flags, over columns that are neither never- nor always-null."""
    cols = cols or df.columns
    flags = df.select(*[_missing(c, df.schema[c].dataType).cast("double").alias(c) for c in cols])
    stats = flags.agg(*[F.avg(c).alias(c) for c in cols]).first()
    keep = [c for c in cols if stats[c] is not None and 0.0 < stats[c] < 1.0]
    return corr_matrix(flags, keep)


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed; empty bins kept.

    Two passes: the range (one row, read back as two numbers), then counts per
    bin joined onto the ``bins``-row bin table.
    """
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = rng["lo"], rng["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, n long")
    b = F.col("bin")
    if hi > lo:
        width = (F.lit(hi) - F.lit(lo)) / F.lit(bins)
        edge_lo, edge_hi = F.lit(lo) + b * width, F.lit(lo) + (b + 1) * width
    else:  # numpy widens a zero range to [lo - 0.5, lo + 0.5]
        edge_lo, edge_hi = F.lit(lo) - 0.5 + b / F.lit(bins), F.lit(lo) - 0.5 + (b + 1) / F.lit(bins)
    edges = spark.range(bins).withColumnRenamed("id", "bin").select(
        b.cast("int").alias("bin"), edge_lo.alias("bin_lo"), edge_hi.alias("bin_hi"))
    binned = (df.where(x.isNotNull() & ~F.isnan(x))
              .select(bin_index(x, F.lit(lo), F.lit(hi), bins).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    return (edges.join(binned, "bin", "left")
            .select("bin", "bin_lo", "bin_hi", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """numpy-style equal-width bin index; range 0 puts everything in the middle bin."""
    idx = F.floor((x - lo) / (hi - lo) * F.lit(bins)).cast("int")
    return F.when(hi > lo, F.least(idx, F.lit(bins - 1))).otherwise(F.lit(bins // 2))


def boxplot(df: DataFrame, value: str, group: str, whisker: float = 1.5) -> DataFrame:
    """Box-plot numbers per group: quartiles, whiskers at the extreme data inside the fences, flier count.

    Pass 1: exact quartiles per group.  Pass 2: the one-row-
    per-group quartile table is joined back (AQE broadcasts it when it is
    small) and whiskers/fliers are one more aggregation.
    """
    x = F.col(value).cast("double")
    q = grouped_quantiles(df, value, [group], [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
         .withColumn("fence_lo", F.col("q1") - whisker * F.col("iqr")) \
         .withColumn("fence_hi", F.col("q3") + whisker * F.col("iqr"))
    v = F.col("x")
    inside = (v >= F.col("fence_lo")) & (v <= F.col("fence_hi"))
    # the quartile table is used once: its columns ride along as grouping keys of the second pass
    w = df.where(x.isNotNull()).select(group, x.alias("x")).join(q, group)
    return w.groupBy(group, "q1", "median", "q3", "iqr").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
        F.count_if(~inside).alias("n_fliers")
    ).select(group, "n", "q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi", "n_fliers")


def weighted_average(df: DataFrame, value_cols: list[str], weight: str, by: list[str] | None = None) -> DataFrame:
    """sum(w*x)/sum(w) per value column."""
    w = F.col(weight).cast("double")
    aggs = [F.try_divide(F.sum(F.col(c) * w), F.sum(w)).alias(c) for c in value_cols]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def score_summary(fold_scores: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Mean and population std of per-fold scores."""
    aggs = [F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(F.lit(1)).alias("n_folds")]
    return fold_scores.groupBy(*by).agg(*aggs) if by else fold_scores.agg(*aggs)
