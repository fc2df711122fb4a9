import random
import re
from collections import defaultdict

import numpy as np

import __spark_entry__ as E
from haze.llm import graph, neardup
from haze.llm._bytes import shingle_sets, word_hashes

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(rows, width, percent):
    """component of each row index by comparing all that share a shingle."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        near = {j for g in s for j in where[g]}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for g in s:
            where[g].append(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(len(sets[i]), low.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(tuple(r) for r in E.queries()["op8_superminhash"](spark, sf).collect())
    assert got == [(d, n, c, d == c) for (d, _), (n, c) in zip(rows, brute(rows, 2, 80))]


def test_shingle_sets_equal_brute_force():
    rng = random.Random(3)
    texts = ["", " ", "One", "one", "É a\x0bb", "A b c A B c d", "x" * 3000, " ".join(rng.choice("ab cd") for _ in range(400))]
    for width in (1, 2, 5):
        s, bounds = shingle_sets([t.encode() for t in texts], width)
        got = [frozenset(s[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
        assert [len(x) for x in got] == [len(shingles(t, width)) for t in texts]
        for i, a in enumerate(texts):
            for j, b in enumerate(texts):
                assert len(got[i] & got[j]) == len(shingles(a, width) & shingles(b, width))


def test_long_texts_hash_like_short_ones(monkeypatch):
    import haze.llm._bytes as B

    text = " ".join(f"w{i % 97}" for i in range(3000)).encode()
    whole, _ = word_hashes([text, b"", text[:50]])
    monkeypatch.setattr(B, "BLOCK", 100)
    monkeypatch.setattr(B, "_tables", {})  # tables are made for the block size
    cut, owner = word_hashes([text, b"", text[:50]])
    assert np.array_equal(whole, cut) and set(owner.tolist()) == {0, 2}


def test_signature_estimates_similarity_with_less_variance_than_independent_hashes():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(150):
        a = rng.integers(0, 2**63, 60).astype(np.uint64)
        b = np.concatenate([a[:40], rng.integers(0, 2**63, 20).astype(np.uint64)])
        s = neardup.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 60, 120]))
        errors.append((s[0] == s[1]).mean() - 40 / 80)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.25 / neardup.SLOTS  # independent MinHash: J(1-J)/slots
    full = neardup.signatures(np.arange(1, 2000, dtype=np.uint64), np.array([0, 1999]))
    assert (full >> 32).max() <= 3  # stopped early


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert graph.components(df.limit(0)).count() == 0


def test_edges_open_bands_and_dedup(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]

    def near(k, n):
        w = list(base)
        r = random.Random(k)
        for i in r.sample(range(60), n):
            w[i] = f"v{k}x{i}"
        return " ".join(w)

    rows = [(i, near(i, rng.choice([0, 3, 6, 9, 14]))) for i in range(10, 120)]
    rows += [(1, None), (2, ""), (3, " \n"), (None, "lonely words here"), (4, "Lonely words  here"), (4, "lonely WORDS here"),
             (5, "uno"), (6, "UNO"), (7, "z " * 4000), (None, None), (8, "k l m n o p q")]
    df = spark.createDataFrame([(d, t, "c", b"k") for d, t in rows],
                               "doc_id long, text string, component string, set_key binary")
    monkeypatch.setattr(neardup, "ROWS", 2)
    for width in (1, 3):
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.groups(df, width=width).collect()), key=str)
        assert got == sorted(((d, n, c) for (d, _), (n, c) in zip(rows, brute(rows, width, 80))), key=str)
    kept = neardup.deduplicated(df, width=3)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    comps = {c for (d, _), (n, c) in zip(rows, brute(rows, 3, 80)) if n}
    assert ids == sorted([c for c in comps] + [1, 2, 3, None], key=str)
    assert neardup.groups(df.limit(0)).count() == 0


def test_words_made_to_collide(spark):
    a, b = "a", "b"
    for _ in range(10):  # polynomial hashes of these agree modulo 2**64 for every odd base
        a, b = a + b, b + a
    rows = [(1, a), (2, b), (3, f"{a} x"), (4, f"{b} x"), (5, a.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.groups(df, width=2).collect())
    assert got == [(d, n, c) for (d, _), (n, c) in zip(rows, brute(rows, 2, 80))] == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 1, 1)]


def test_hashes_equal_integer_arithmetic():
    import haze.llm._bytes as B

    raw = np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8)
    key = B.draw_key()
    h = B.Hashes(raw, key)
    for (total, back, p), base in zip(h.parts, key):
        p = int(p)
        want, t = [0], 0
        for i, c in enumerate(raw.tolist()):
            t = (t + (c + 1) * pow(base, i, p)) % p
            want.append(t)
        assert total.tolist() == want and [int(x) for x in back[:50]] == [pow(pow(base, -1, p), i, p) for i in range(50)]
    at = np.arange(len(raw) - 63)
    assert np.array_equal(h.sliding(64), h.of(at, at + 64))
    shifted = B.Hashes(np.concatenate([raw[1000:], raw]), key)
    assert np.array_equal(shifted.sliding(64)[:500], h.sliding(64)[1000:1500])
    old = B._SEGMENT
    B._SEGMENT = 100
    assert np.array_equal(B.Hashes(raw, key).sliding(64), h.sliding(64))
    B._SEGMENT = old
