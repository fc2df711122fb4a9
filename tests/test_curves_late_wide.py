"""Thinned curves, wide correlations, late rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haze.operators import metrics, wide
from haze.streaming import ingest, late


def curve(scores, positive, thin):
    """(threshold, fpr, tpr) from the definition: cumulative counts by falling score; second differences of zero go."""
    u = np.unique(scores)[::-1]
    fps = np.array([((scores >= s) & ~positive).sum() for s in u], float)
    tps = np.array([((scores >= s) & positive).sum() for s in u], float)
    keep = np.ones(len(u), bool)
    if thin and len(u) > 2:
        keep[1:-1] = (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0)
    return sorted([(np.inf, 0.0, 0.0), *zip(u[keep], (fps / fps[-1])[keep], (tps / tps[-1])[keep])])


def test_thinned_curve_equals_definition(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g, n in (("a", 400), ("b", 60), (None, 30)):
        s = rng.integers(0, 200 if g == "a" else 15, n) / 10
        rows += [(g, float(v), bool(p)) for v, p in zip(s, rng.random(n) < 0.4)]
    rows += [("run", float(i), i < 50) for i in range(100)] + [("one", 1.0, True), ("one", 1.0, False)]
    df = spark.createDataFrame(rows, "g string, s double, p boolean").repartition(5)
    for thin, fn in ((True, metrics.roc_curve_thinned), (False, metrics.roc_curve)):
        got = fn(df.where("g IS NOT NULL"), F.col("p"), "s", by=["g"]).collect()
        for g in ("a", "b", "run", "one"):
            sel = [(v, p) for k, v, p in rows if k == g]
            want = curve(np.array([v for v, _ in sel]), np.array([p for _, p in sel]), thin)
            mine = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in got if r["g"] == g)
            assert len(mine) == len(want) and np.allclose(np.array(mine)[:, 1:], np.array(want)[:, 1:])
            if g == "run" and thin:
                assert len(mine) == 4  # the start, the first point, the corner and the end
            x, y = np.array(sorted(mine, key=lambda t: (t[1], t[2])))[:, 1:].T
            full = np.array(sorted(curve(np.array([v for v, _ in sel]), np.array([p for _, p in sel]), False), key=lambda t: (t[1], t[2])))[:, 1:].T
            assert np.trapezoid(y, x) == pytest.approx(np.trapezoid(full[1], full[0]))
    whole = metrics.roc_curve_thinned(df, F.col("p"), "s").collect()
    want = curve(np.array([v for _, v, _ in rows]), np.array([p for *_, p in rows]), True)
    assert np.allclose(sorted((r["fpr"], r["tpr"]) for r in whole), sorted((b, c) for _, b, c in want))


def test_buckets_follow_rows(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("v"))
    for buckets in (None, 5):
        got = {r["x"]: r["cum_v"] for r in metrics.prefix_sums(df, "x", ["v"], buckets=buckets).collect()}
        assert got == {float(i): float(i) for i in range(3000)}


def test_wide_corr_equals_pairwise_numpy(spark, monkeypatch):
    monkeypatch.setattr(wide, "TILE", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7)) + 1e6
    x[:, 5] = 4.0
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 6] = np.nan
    cols = [f"c.{i}" for i in range(7)]
    rows = [[None if np.isnan(v) and i % 2 else float(v) for v in r] for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols)).repartition(4)
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in wide.wide_corr(df, cols).collect()}
    assert len(got) == 49
    for i in range(7):
        for j in range(7):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            v = got[cols[i], cols[j]]
            if i == j:
                assert v == 1.0
            elif both.sum() < 2 or 5 in (i, j):
                assert v is None
            else:
                assert v == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert wide.wide_corr(df.limit(0), cols).where("corr IS NOT NULL AND col_a <> col_b").count() == 0


def test_late_rows_reach_history(spark, tmp_path):
    """Three batches; rows three days late under a delay of one day; the last batch replayed."""
    day = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    batches = [
        [(1, "p", day(10)), (2, "p", day(9)), (3, "q", day(10)), (4, "p", day(10)), (5, "q", None)],
        [(6, "p", day(7)), (7, "q", day(10)), (8, "q", day(12)), (9, "p", day(7)), (10, "p", day(9, 1))],
        [(11, "p", day(7)), (12, "q", day(8)), (13, "q", day(12)), (14, "p", day(11, 12)), (0, "q", day(8)), (15, "q", None)],
    ]
    root, arrival = str(tmp_path), []
    for i, b in enumerate(batches):
        df = spark.createDataFrame(b, "reading_id long, city string, t string").select("reading_id", "city", F.to_timestamp("t").alias("ts"))
        df.coalesce(1).write.option("timestampFormat", ingest.JSON_TS_FORMAT).json(f"{root}/landing/part={i}")
        late.ingest_with_late(spark, f"{root}/landing/*", f"{root}/sink", f"{root}/ckpt", max_files_per_trigger=None).awaitTermination()
        arrival += [(i, *r) for r in b]
    got = {(r["city"], r["ts"] and str(r["ts"])): (r["reading_id"], r["was_late"])
           for r in late.merge_late(spark, f"{root}/sink", ingest.READING_JSON).collect()}
    want = {}
    for _, rid, city, t in sorted(arrival, key=lambda r: (r[0], r[1])):
        want.setdefault((city, t), rid)
    assert {k: v[0] for k, v in got.items()} == want
    assert {k for k, v in got.items() if v[1]} == {("p", day(7)), ("q", day(8)), ("q", None)}
    in_time = spark.read.parquet(f"{root}/sink/rows")
    assert in_time.count() == in_time.select("city", "ts").distinct().count() == 6
