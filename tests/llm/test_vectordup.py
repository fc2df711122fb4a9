import numpy as np
import pytest

import __spark_entry__ as E
from haze.llm import vectordup as V


def brute(rows, cosine=0.9):
    """(id, n_links, component) of each row by all pairs."""
    usable = []
    for k, (_, v) in enumerate(rows):
        if v and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v):
            usable.append(k)
    m = np.array([rows[k][1] for k in usable], float)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return links(rows, usable, m @ m.T >= cosine)


def links(rows, usable, near):
    np.fill_diagonal(near, False)
    parent = list(range(len(usable)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in zip(*np.nonzero(near)):
        parent[find(a)] = find(b)
    low = {}
    for i, k in enumerate(usable):
        d = rows[k][0]
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    out = [(d, 0, d) for d, _ in rows]
    for i, k in enumerate(usable):
        out[k] = (rows[k][0], int(near[i].sum()), low.get(find(i)))
    return sorted(out, key=str)


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((max(1, n // 25), d))
    which = rng.integers(0, len(centre), n)
    which[:n // 3] = 0  # one group holds a third
    return centre[which] + rng.standard_normal((n, d)) * rng.choice([0.0, 0.15, 0.3, 0.6, 2.0], n)[:, None]


@pytest.mark.parametrize("unit, pivots, blocks", [(4096, 256, 4), (40, 6, 4), (25, 1, 2), (60, 9, 8)])
def test_equals_all_pairs(spark, monkeypatch, unit, pivots, blocks):
    monkeypatch.setattr(V, "PIVOTS", pivots)
    monkeypatch.setattr(V, "BLOCKS", blocks)
    monkeypatch.setattr(V.Space.__init__, "__defaults__", (blocks,))
    monkeypatch.setattr(V.links, "__defaults__", (0.9, unit, pivots))
    m = clustered(400, 8, unit)
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted((tuple(r) for r in V.groups(df, unit=unit).collect()), key=str)
    assert got == brute(rows)
    assert sum(n for _, n, _ in got) > 400


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    m = np.array([v for _, v in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = links(rows, list(range(len(rows))), m @ m.T >= 0.9)
    got = sorted((tuple(r) for r in E.queries()["op12_subspace_neardup"](spark, sf).collect()), key=str)
    assert got == sorted([(*w, w[0] == w[2]) for w in want], key=str)


def test_defined_cases(spark):
    rng = np.random.default_rng(2)
    one = rng.standard_normal(8)
    rows = [(i, one.tolist()) for i in range(50, 80)] + [(3, (one * 1e200).tolist()), (4, (one * 1e-200).tolist()), (5, (-one).tolist()),
            (6, (one + 0.05).tolist()), (7, None), (8, [0.0] * 8), (9, [None] + one[1:].tolist()), (10, [float("nan")] + one[1:].tolist()),
            (11, [float("inf")] + one[1:].tolist()), (12, []), (13, one[:5].tolist()), (None, one.tolist()), (None, None), (50, one.tolist()),
            (14, [0.0] * 7 + [1.0]), (15, [-0.0] * 7 + [1.0])]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, class string, copies int")
    got = sorted((tuple(r) for r in V.groups(df).collect()), key=str)
    assert got == brute(rows)
    assert V.groups(df.limit(0)).count() == 0
    assert [tuple(r) for r in V.groups(df.where("vec_id = 7")).collect()] == [(7, 0, 7)]


def test_pairs_on_the_budget_are_found(spark):
    """Pairs whose distance is dealt evenly over the blocks, just above and just below the cosine."""
    turn = V.rotation(64)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        step = rng.standard_normal(64)
        for lo, hi in V.block_edges(64):
            step[lo:hi] /= np.linalg.norm(step[lo:hi])
        step = turn @ step
        step -= (step @ a) * a
        step /= np.linalg.norm(step)
        c = 0.9 + (1e-6 if k % 2 else -1e-6)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * step).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in V.groups(df, unit=16).collect()}
    assert got == {i: (1, i - i % 2) if i // 2 % 2 else (0, i) for i in range(120)}


def test_rounds_leave_no_shuffle_and_no_link_out(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 16))
    rows = [(i, [float(x) for x in centres[i % 6] + (0.12 if i % 2 else 0.5) * rng.standard_normal(16)]) for i in range(240)]
    df = spark.createDataFrame([*rows, (900, rows[0][1]), (901, None)], "vec_id long, embedding array<double>")
    m = V.unit_length(np.array([r[1] for r in [*rows, (900, rows[0][1])]]))
    near = m @ m.T >= V.COSINE
    ids = [*range(240), 900]
    monkeypatch.setattr(V, "DEALT", 0.0)
    monkeypatch.setattr(V, "LEAST", 500)
    jobs, made = [], V._rounds
    monkeypatch.setattr(V, "_rounds", lambda *a: jobs.extend(made(*a)) or made(*a))
    got = {r["doc_id"]: r["n_links"] for r in V.groups(df, unit=16).collect()}
    assert got == {901: 0} | {i: int(n) - 1 for i, n in zip(ids, near.sum(axis=1))} and len(jobs) > 2
    assert spark.conf.get(V.CLEANED, None) in (None, "false")


def test_rounds_hold_every_unit_once():
    sizes = [(0, 0, 5), (0, 1, 9), (1, 0, 3), (1, 1, 3), (1, 2, 50), (2, 0, 1)]
    rounds = V._rounds(sizes[::-1], 10)
    units = [(b, u) for r in rounds for b, (low, high) in r.items() for u in range(low, high + 1)]
    assert sorted(units) == [s[:2] for s in sizes] and len(units) == len(set(units))
    n = dict(((b, u), k) for b, u, k in sizes)
    assert all(sum(n[b, u] for b, (low, high) in r.items() for u in range(low, high + 1)) <= 10 or len(r) == 1 for r in rounds)
