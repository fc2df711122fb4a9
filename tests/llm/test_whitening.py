import numpy as np
import pytest

import __spark_entry__ as E
from haze.llm import whitening as W


def brute(rows, components=16):
    """rows: (id, vector) that count -> n, per row (deviation, whitened), explained; signs free."""
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * x - s) / n
    f = (n * fit - s) / n
    cov = f.T @ f / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, len(e), int((e > 1e-9 * e.sum()).sum()))
    return n, ((n * x - s) ** 2).sum(axis=1), y @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(found, rows, components=16):
    n, dev, white, explained = brute(rows, components)
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], []).append(r)
    sign = None
    assert len(by) == len({i for i, _ in rows})
    for k, (i, _) in enumerate(rows):
        got = sorted(by[i], key=lambda r: r["component"])[:len(explained)]
        assert [r["component"] for r in got] == list(range(1, len(explained) + 1))
        assert all(r["n"] == n and r["deviation"] == dev[k] and r["identity_error"] <= 1e-4 for r in got)
        w = np.array([r["whitened"] for r in got])
        sign = np.sign(w * white[k]) if sign is None else sign
        assert w * sign == pytest.approx(white[k], abs=1e-6)
        assert [r["explained"] for r in got] == pytest.approx(list(explained), rel=1e-9)


def test_query_equals_numpy(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
        check(E.queries()["op11_whitening"](spark, f"/root/testdata/{sf}").collect(), rows)


@pytest.mark.parametrize("kind", ["random", "close", "equal", "diagonal", "low rank", "tiny", "huge", "one", "two"])
def test_eigensolver(kind):
    rng = np.random.default_rng(4)
    d = {"one": 1, "two": 2}.get(kind, 60)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = np.sort(rng.uniform(1, 100, d))[::-1]
    if kind == "close":
        e[:20] = 50 + np.arange(20)[::-1] * 1e-7
    if kind == "equal":
        e[3:12] = e[3]
    if kind == "low rank":
        e[5:] = 0
    scale = {"tiny": 1e-150, "huge": 1e150}.get(kind, 1.0)
    a = (np.diag(e) if kind == "diagonal" else (q * e) @ q.T) * scale
    a = (a + a.T) / 2
    k = min(16, d)
    values, vectors = W.leading_components(a, k)
    want = np.linalg.eigvalsh(a)[::-1][:k]
    assert np.abs(values - want).max() <= 1e-12 * want[0]
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-10
    assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-11 * want[0]


def test_defined_cases(spark):
    rng = np.random.default_rng(1)
    vec = lambda: rng.normal(size=5).round(3).tolist()
    good = [(i, vec()) for i in range(40)]
    hot = vec()
    good += [(100 + i, hot) for i in range(60)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (204, []), (205, [1.0, 2.0])]
    rows = [(i, v, "n", 7) for i, v in good + bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, x int").repartition(5)
    found = W.long_form(W.whitened(df)).collect()
    check(found, good)
    assert W.whitened(df.limit(0)).count() == 0
    same = df.where("vec_id >= 100 AND vec_id < 200")
    assert W.whitened(same).count() == 0  # no variance at all
    twice = W.long_form(W.whitened(df.unionByName(df))).collect()
    assert len(twice) == 2 * len(found) and {r["n"] for r in twice} == {r["n"] for r in found}
    few = spark.createDataFrame([(None, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0]), (2, [0.0, 0.5, 0.0])], "vec_id long, embedding array<float>")
    got = W.long_form(W.whitened(few)).collect()
    assert {r["component"] for r in got} == {1, 2} and {r["vec_id"] for r in got} == {None, 1, 2}
