import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

import __spark_entry__ as E
from haze.llm import resample as R

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest=1):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
    return len(w), [" ".join(w[i:i + k]).encode() for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, longest=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    of = lambda t: [zlib.crc32(f) % buckets for f in runs(t, longest)[1]]
    s, t = Counter(b for _, x in docs for b in of(x)), Counter(b for x in target for b in of(x))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for d, x in docs:
        f = of(x)
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), runs(x)[0]))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    ranked = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)]
    return sorted([*ranked, *[(*r[:4], None) for r in rows if r[4] < min_words]], key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows_of(E.queries()["op13_importance_resampling"](spark, sf)) == brute(docs, bench)


def test_crc_matrix_equals_zlib():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        m = rng.integers(0, 256, (50, n), dtype=np.uint8)
        assert R.crc_matrix(m).tolist() == [zlib.crc32(x.tobytes()) for x in m]


def test_features_equal_brute_force(monkeypatch):
    rng = random.Random(2)
    texts = ["", "One two  TWO_x", "é É ö3~z", "a" * 700 + " b", "\x7f\x00", " ".join(rng.choice(["ab", "c", "Äx", "9"]) for _ in range(500)), "end"]
    for longest in (1, 2, 4):
        crc, who, words = R.features([t.encode() for t in texts], longest)
        for i, t in enumerate(texts):
            n, f = runs(t, longest)
            assert words[i] == n and sorted(crc[who == i].tolist()) == sorted(map(zlib.crc32, f))


def test_defined_cases(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["red", "Blue", "grün", "x1", "y" * 400])
    docs = [(i, " ".join(word() for _ in range(rng.choice([5, 19, 20, 60])))) for i in range(80)]
    docs += [(200, None), (201, ""), (None, " ".join(["red"] * 30)), (None, None), (202, "red " * 30000)] + [(7, "blue " * 40)] * 30
    target = ["red x1 red", None, "", "grün"]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, score int, part int").repartition(4)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, _id int")
    for longest in (1, 3):
        assert rows_of(R.resampled(df, aim, longest=longest, buckets=97, percent=40)) == brute(docs, target, longest, 97, percent=40)
    assert R.resampled(df.limit(0), aim).count() == 0
    none = rows_of(R.resampled(df, aim.limit(0)))
    assert none == brute(docs, [])
    assert rows_of(R.resampled(df, aim, buckets=100_000)) == brute(docs, target, buckets=100_000)
