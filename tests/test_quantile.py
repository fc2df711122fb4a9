import numpy as np
import pytest
from pyspark.sql import functions as F

from haze.operators import clean, quantile, stats

PROBS = [0.0, 0.25, 0.33, 0.5, 0.75, 0.999, 1.0]


def test_small_columns_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 3000
    cols = {"normal": rng.normal(size=n), "ties": rng.integers(0, 3, n).astype(float), "one": np.full(n, 7.5),
            "wide": 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n), "mostly": np.where(rng.random(n) < 0.9, 0.0, rng.normal(size=n))}
    rows = [tuple(float(c[i]) for c in cols.values()) for i in range(n)]
    df = spark.createDataFrame(rows + [(None,) * 5, (float("nan"),) * 5], ", ".join(f"`{c}` double" for c in cols)).repartition(6)
    for leaf, points, chunk in ((50_000, 2048, 1 << 16), (40, 64, 100)):
        monkeypatch.setattr(quantile, "LEAF", leaf)
        monkeypatch.setattr(quantile, "POINTS", points)
        monkeypatch.setattr(quantile, "ERROR", 2 / points)
        monkeypatch.setattr(quantile, "CHUNK", chunk)
        got = quantile.exact_quantiles(df, list(cols), PROBS)
        for c, v in cols.items():
            want = np.quantile(v, PROBS)
            assert got[c] == pytest.approx(list(want), rel=1e-12, abs=1e-300), c


def test_millions_of_distinct_values_equal_numpy(spark):
    n = 3_000_000
    df = spark.range(0, n, 1, 8).select((F.pmod(F.col("id") * 2654435761, F.lit(4294967296)) / 7.0).alias("x"))
    x = (np.arange(n, dtype=np.int64) * 2654435761 % 4294967296) / 7.0
    assert quantile.exact_quantiles(df, ["x"], PROBS)["x"] == pytest.approx(list(np.quantile(x, PROBS)), rel=1e-12)


def test_groups_equal_numpy(spark):
    rng = np.random.default_rng(5)
    groups = rng.choice(["a", "b", "c", None], 4000, p=[0.9, 0.05, 0.04, 0.01])
    x = np.round(rng.normal(size=4000), 2)
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(groups, x)] + [("d", None)], "g string, x double")
    got = {r["g"]: tuple(r)[1:] for r in quantile.grouped_quantiles(df, "x", ["g"], PROBS, [f"q{i}" for i in range(7)]).collect()}
    assert got.keys() == {"a", "b", "c", None}
    for g in got:
        assert got[g] == pytest.approx(tuple(np.quantile(x[[h == g for h in groups]], PROBS)))


def test_empty_and_types(spark):
    df = spark.createDataFrame([(1, None), (2, None), (None, None)], "i int, n double")
    assert quantile.exact_quantiles(df, ["i", "n"], [0.5]) == {"i": [1.5], "n": [None]}
    assert stats.medians(df.limit(0), ["i"]) == {"i": None}
    filled = clean.impute_median(df, ["i", "n"])
    assert dict(filled.dtypes)["i"] == "double" and sorted(r["i"] for r in filled.collect()) == [1.0, 1.5, 2.0]
    assert dict(clean.impute_median(df.dropna(subset=["i"]), ["i"]).dtypes)["i"] == "int"


def test_no_value_maps_in_plans(spark):
    import inspect

    import haze.functions.features as features
    import haze.functions.scalers as scalers

    for module in (stats, clean, features, scalers, quantile):
        source = inspect.getsource(module)
        assert "F.percentile(" not in source and " median(" not in source.replace("def ", "")


def test_a_sketch_that_breaks_its_promise_is_noticed(spark, monkeypatch):
    """Brackets that miss the rank are widened: the answer comes from counts alone."""
    rng = np.random.default_rng(9)
    x = np.where(rng.random(4000) < 0.3, 0.0, rng.normal(size=4000))
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
    honest = quantile._bracket
    for ends in ((5.0, 9.0), (-9.0, -5.0), (0.0, 0.0)):
        calls = []
        monkeypatch.setattr(quantile, "_bracket", lambda m, r, span, miss, e=ends, k=calls: (
            honest(m, r, span, miss) if miss else k.append(1) or (*e, 5)))
        for leaf in (50_000, 30):
            monkeypatch.setattr(quantile, "LEAF", leaf)
            assert quantile.exact_quantiles(df, ["x"], PROBS)["x"] == pytest.approx(list(np.quantile(x, PROBS)), rel=1e-12)
    monkeypatch.setattr(quantile, "_bracket", honest)


def test_two_aggregations_for_many_columns(spark, monkeypatch):
    """The second scan gathers a few values per bracket, not the column."""
    seen = []
    real = quantile._measure

    def spy(df, spans, leaf):
        out = real(df, spans, leaf)
        seen.append([(k, len(m["v"])) for m, k in zip(out, leaf)])
        return out

    monkeypatch.setattr(quantile, "_measure", spy)
    df = spark.range(0, 400_000, 1, 8).select(*[F.xxhash64("id", F.lit(i)).cast("double").alias(f"c{i}") for i in range(4)])
    quantile.exact_quantiles(df, [f"c{i}" for i in range(4)], [0.25, 0.5, 0.75])
    assert len(seen) == 2 and seen[0] == [(False, quantile.POINTS)] * 4
    assert all(k for k, _ in seen[1]) and max(n for _, n in seen[1]) <= 400_000 * 8 / quantile.POINTS


def test_summaries_join_their_chunks():
    """A task of any size holds a bounded number of thinned chunks, and the summary stays within its error."""
    from haze.operators import quantile as q

    one, most = q._Summary(), 0
    x = np.random.default_rng(1).permutation(40 * q.CHUNK).astype(float)
    for a in range(0, len(x), q.CHUNK):
        one.add(x[a:a + q.CHUNK])
        most = max(most, len(one.chunks))
    v, w = one.end()
    assert most < q.CHUNKS and len(v) <= q.POINTS
    upto = np.cumsum(w)
    at = np.searchsorted(v, len(x) / 2)
    assert abs(upto[at] - len(x) / 2) <= q.ERROR * len(x)
    batch = q._record([(0, 1, 2, 3, 4, v, w)])
    r = next(q._rows(batch))
    assert isinstance(r["v"], np.ndarray) and np.array_equal(r["v"], v)
