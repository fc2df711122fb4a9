"""Exact quantiles at any size, linear interpolation as in numpy.

Ungrouped (``exact_quantiles``): a bounded sketch brackets each wanted rank, then counts make it exact.  One scan
summarises every column: chunks of rows are sorted and thinned to ``POINTS`` weighted order statistics, and summaries are joined
by their weights, so that any rank read from them is off by at most ``ERROR`` of the rows.  A second scan
counts the rows below and on the ends of each bracket and gathers the values strictly between them, a few in a
thousand; the wanted value is read from its rank among them.  The counts prove that the bracket holds the rank; one that
does not is widened and counted again.  Where a bracket may still hold more than ``LEAF`` rows, its
inside is summarised again first, each time a few hundred times fewer rows.  No scan shuffles rows: a task sends
one summary, or a few values, per bracket, joined in groups of tasks before the driver; repeated values cost nothing, since they are counted.

Grouped (``grouped_quantiles``): one row per group and distinct value, range-partitioned, with counts
summed over whole partitions first; a group of any size spans as many partitions as it needs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haze.session import ship_package, written

POINTS = 2048
ERROR = 2 / POINTS  # four thinnings (chunk, several chunks, task, group of tasks) of half a point's weight each
CHUNK = 1 << 16
CHUNKS = 16  # thinned chunks that a task holds before it joins them
LEAF = 16_384


def number(col: str | Column) -> Column:
    """The value as a double; NaN counts as missing."""
    x = (F.col(f"`{col}`") if isinstance(col, str) else col).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    at = (n - 1) * p
    low = math.floor(at)
    return low, min(low + 1, n - 1), at - low


def _thin(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``POINTS`` order statistics in equal steps of weight; fewer values are kept as they are, sorted."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    if len(values) <= POINTS:
        return values, weights
    upto = np.cumsum(weights)
    at = np.searchsorted(upto, (np.arange(POINTS) + 0.5) * upto[-1] / POINTS)
    return values[at], np.full(POINTS, upto[-1] / POINTS)


class _Summary:
    def __init__(self):
        self.parts, self.chunks, self.wait, self.rows = [], [], [], 0

    def add(self, x: np.ndarray) -> None:
        self.wait.append(x)
        self.rows += len(x)
        if self.rows >= CHUNK:
            self._close()

    def _close(self) -> None:
        x = np.concatenate([np.zeros(0), *self.wait])
        self.chunks.append(_thin(x, np.ones(len(x))))
        self.wait, self.rows = [], 0
        if len(self.chunks) >= CHUNKS:
            self.parts.append(_joined(self.chunks))
            self.chunks = []

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        self._close()
        return _joined(self.parts + self.chunks)


def _joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    values, weights = (np.concatenate([np.zeros(0), *[np.asarray(p[k], float) for p in parts]]) for k in (0, 1))
    return _thin(values, weights)


_ROW = "span int, b long, l long, n long, h long, v array<double>, w array<double>"


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.float64())] * 2]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["span", "b", "l", "n", "h", "v", "w"])


def _measure(df: DataFrame, spans: list[tuple], leaf: list[bool]) -> list[dict]:
    """Per span (column, low, high): rows below low (b), on it (l), strictly inside (n) and on high (h), and the inside's
    values (leaf) or a summary of them (v, with weights w): one scan for all spans."""
    spark = df.sparkSession
    ship_package(spark)
    cols = sorted({c for c, _, _ in spans})
    at = {c: i for i, c in enumerate(cols)}
    plan = [(at[c], low, high, whole) for (c, low, high), whole in zip(spans, leaf)]

    def scan(batches):
        count, inside = np.zeros((len(plan), 4), np.int64), [[] if whole else _Summary() for *_, whole in plan]
        for batch in batches:
            have = []
            for column in batch.columns:
                x = column.to_numpy(zero_copy_only=False)
                have.append(np.sort(x[~np.isnan(x)]))
            for i, (k, low, high, whole) in enumerate(plan):
                x = have[k]
                a, b = (0, 0) if low is None else (np.searchsorted(x, low), np.searchsorted(x, low, "right"))
                c, d = (len(x), len(x)) if high is None else (np.searchsorted(x, high), np.searchsorted(x, high, "right"))
                count[i] += (a, b - a, max(c - b, 0), 0 if high in (None, low) else d - c)
                (inside[i].append if whole else inside[i].add)(x[b:max(b, c)])
        rows = []
        for i, (*_, whole) in enumerate(plan):
            v, w = (np.concatenate([np.zeros(0), *inside[i]]), np.zeros(0)) if whole else inside[i].end()
            rows.append((i, *count[i].tolist(), v, w))
        yield _record(rows)

    def grouped(batches):
        by = {}
        for batch in batches:
            for r in _rows(batch):
                by.setdefault(r["span"], []).append(r)
        if by:
            yield _record([_one(i, rows, leaf[i]) for i, rows in by.items()])

    rows = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(cols)])
    groups = max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = rows.mapInArrow(scan, _ROW).repartition(groups).mapInArrow(grouped, _ROW)
    by = {}
    for batch in parts.toArrow().to_batches():
        for r in _rows(batch):
            by.setdefault(r["span"], []).append(r)
    return [dict(zip("_blnhvw", _one(i, by.get(i, []), leaf[i]))) for i in range(len(spans))]


def _rows(batch: pa.RecordBatch):
    """Rows as dicts whose lists stay arrays of eight bytes a value."""
    plain = [batch.column(k).to_pylist() for k in ("span", "b", "l", "n", "h")]
    for i, r in enumerate(zip(*plain)):
        yield dict(zip(("span", "b", "l", "n", "h"), r)) | {k: batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in "vw"}


def _one(i: int, rows: list, whole: bool) -> tuple:
    v, w = _joined([(r["v"], r["w"]) for r in rows]) if not whole else (np.concatenate([np.zeros(0), *[np.asarray(r["v"], float) for r in rows]]), np.zeros(0))
    return (i, *[sum(r[k] for r in rows) for k in "blnh"], v, w)


def _bracket(m: dict, rank: int, span: tuple, miss: int) -> tuple[float | None, float | None, float]:
    """Ends that hold the rank (inside a summarised span) and a bound of the rows strictly between them."""
    _, low, high = span
    upto = np.cumsum(m["w"])
    off = ERROR * m["n"] * 4 ** miss + 3
    a = int(np.searchsorted(upto, rank - off, "right")) - 1  # the last point that lies safely below
    b = int(np.searchsorted(upto, rank + off))  # the first one safely above
    most = (upto[b] if b < len(upto) else m["n"]) - (upto[a - 1] if a > 0 else 0) + 2 * ERROR * m["n"]
    return (m["v"][a] if a >= 0 else low), (m["v"][b] if b < len(upto) else high), most


def _select(df: DataFrame, wanted: dict[str, list[float]]) -> tuple[dict[str, int], dict[tuple[str, int], float]]:
    """Rows with a value in each column, and the value at each rank that the wanted quantiles need."""
    first = _measure(df, [(c, None, None) for c in wanted], [False] * len(wanted))
    counts = {c: m["n"] for c, m in zip(wanted, first)}
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple] = {}  # (low, high, bound of the rows between, times a summary was wrong)
    for c, m in zip(wanted, first):
        for r in {r for p in wanted[c] if m["n"] for r in _ranks(m["n"], p)[:2]}:
            if m["n"] == len(m["v"]):  # nothing was thinned out
                found[c, r] = m["v"][r]
            else:
                open_[c, r] = (*_bracket(m, r, (c, None, None), 0), 0)
    while open_:
        spans = sorted({(c, lo, hi) for (c, _), (lo, hi, *_) in open_.items()}, key=str)
        bound = {s: max(x[2] for (c, _), x in open_.items() if (c, *x[:2]) == s) for s in spans}
        leaf = [bound[s] <= LEAF for s in spans]
        seen = dict(zip(spans, zip(_measure(df, spans, leaf), leaf)))
        for key, (low, high, _, miss) in list(open_.items()):
            c, r = key
            m, whole = seen[c, low, high]
            if r < m["b"] or r >= m["b"] + m["l"] + m["n"] + m["h"]:  # the summary was further off than it may be
                open_[key] = (*((None, high) if r < m["b"] else (low, None)), math.inf, miss + 1)
                continue
            at = r - m["b"] - m["l"]
            if at < 0:
                found[key] = low
            elif at >= m["n"]:
                found[key] = high
            elif whole:
                if not m.get("sorted"):
                    m["v"], m["sorted"] = np.sort(m["v"]), True
                found[key] = float(m["v"][at])
            else:
                lo, hi, most = _bracket(m, at, (c, low, high), miss)
                open_[key] = (lo, hi, 0 if (lo, hi) == (low, high) else most, miss)
                continue
            del open_[key]
    return counts, found


def summaries(df: DataFrame, cols: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted values and weights of each column: all values, or ``POINTS`` order statistics; one scan."""
    return [(np.asarray(m["v"], float), np.asarray(m["w"], float)) for m in _measure(df, [(c, None, None) for c in cols], [False] * len(cols))]


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Every quantile of every column, nulls and NaN skipped; None for a column without values."""
    if not cols:
        return {}
    counts, at = _select(df, {c: probs for c in cols})
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    for c in (c for c in cols if counts[c]):
        for k, p in enumerate(probs):
            low, high, part = _ranks(counts[c], p)
            a, b = at[c, low], at[c, high]
            out[c][k] = a if a == b else a + (b - a) * part
    return out


def grouped_quantiles(df: DataFrame, value: str, by: list[str], probs: list[float], names: list[str]) -> DataFrame:
    """One row per group with a column per quantile; groups without values are absent, a null key is a group."""
    x = number(value)
    counts = df.where(x.isNotNull()).groupBy(*by, x.alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    parts = df.sparkSession.sparkContext.defaultParallelism * 4
    ranged = written(counts.repartitionByRange(parts, *by, "_x").withColumn("_p", F.spark_partition_id()), "quantile")
    sums = ranged.groupBy(*by, "_p").agg(F.sum("_n").alias("_s"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, F.col("_p"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"),
                       F.sum("_s").over(whole).alias("_total"))
    run = Window.partitionBy(*by, "_p").orderBy("_x")
    local = ranged.withColumn("_upto", F.sum("_n").over(run))
    renamed = base.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col("_p").alias("_q"), "_base", "_total")
    same = F.col("_p") == F.col("_q")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    placed = local.join(renamed, same).select(
        *by, "_x", "_total", (F.col("_base") + F.col("_upto")).alias("_end"), (F.col("_base") + F.col("_upto") - F.col("_n")).alias("_start"))
    aggs = []
    for p, name in zip(probs, names):
        at = (F.col("_total") - 1) * F.lit(float(p))
        low = F.floor(at)
        high = F.least(low + 1, F.col("_total") - 1)
        pick = lambda k: F.max(F.when((F.col("_start") <= k) & (F.col("_end") > k), F.col("_x")))
        a, b = pick(low), pick(high)
        aggs.append(F.when(a == b, a).otherwise(a + (b - a) * F.max(at - low)).alias(name))
    return placed.groupBy(*by).agg(*aggs)
