import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

import __spark_entry__ as E
from haze.llm import repeats

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_query_equals_brute_force(spark, docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in E.queries()["op9_repeated_substrings"](spark, SF).collect()}
    assert got == dict(zip(docs, brute(docs.values(), 400)))
    assert any(v[1] for v in got.values())


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 300)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    p, q = word(90), word(45)
    texts = [None, "", "ab" * 200, word(30), p, p, word(20) + p + word(33), word(50) + p[:60] + word(9), q + p[20:80] + q,
             q * 3, "x" * 700, word(500) + p[5:50] + word(20), "é" * 35, word(3) + "é" * 20] + [word(60) + q + word(20) for _ in range(30)]
    rows = [(i if i % 7 else None, t, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    want = brute(texts, 40)
    for most in (4096, 2):
        monkeypatch.setattr(repeats, "BUCKET_RANKS", most)
        got = sorted((tuple(r) for r in repeats.removal_report(df, length=40, gram=12).collect()), key=str)
        assert got == sorted(((r[0], *w) for r, w in zip(rows, want)), key=str)
    full = repeats.without_repeats(df, length=40, gram=12).collect()
    assert sorted((r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
                  for r in full) == sorted(want)
    assert repeats.removal_report(df.limit(0)).count() == 0


def swapped_pair(doublings):
    """Two unlike strings whose polynomial hashes agree modulo 2**64 for every odd base."""
    a, b = "a", "b"
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def test_texts_made_to_collide(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = []
    for k in range(12):
        a, b = swapped_pair(6 + k % 2 * 4)
        head, tail = word(250), word(250)
        texts += [head + a + tail, head + b + tail]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in repeats.removal_report(df).collect())
    assert got == [(i, *w) for i, w in enumerate(brute(texts, 400))]


def test_matching_holds_few_buckets(monkeypatch):
    """Packed runs are matched as their buckets end, not when the partition does, wherever the batches are cut."""
    monkeypatch.setattr(repeats, "MATCH", 60, raising=False)
    rng = np.random.default_rng(4)
    rows = [(i, i // 5, 1 + int(i % 11 == 0), int(rng.integers(0, 3)), rng.integers(1, 5, int(rng.integers(1, 9)))) for i in range(400)]
    seen = Counter()
    for _, bucket, c, first, names in rows:
        for off, w in enumerate(names):
            seen[bucket, first - off, w] += c
    want = {i: [o for o, w in enumerate(names) if seen[b, first - o, w] > 1] for i, b, _, first, names in rows}
    taken = []

    def batches():
        for at in range(0, len(rows), 7):
            part = rows[at:at + 7]
            taken.append(at)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.int64()) for k in range(4)]
                                             + [pa.array([r[4].astype(np.uint64).tobytes() for r in part], pa.binary())],
                                             ["id", "bucket", "c", "dist", "names"])

    got, most = {}, 0
    for out in repeats._matched(batches()):
        most = max(most, len(taken))
        taken.clear()
        got |= {r["id"]: r["offs"] for r in out.to_pylist()}
    assert got == {i: offs for i, offs in want.items() if offs}
    assert most <= 6


def test_planted_passages_leave_and_clean_texts_stay(spark):
    """``n_removed`` tells removal, from 400 bytes on; ``n_bytes`` is the length of the input either way."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(6, 10))) for _ in range(n))
    passages, short = [words(60) for _ in range(4)], words(60)[:399]
    planted = {i: f"{words(rng.randint(5, 40))} {passages[i % 4]} {words(rng.randint(5, 40))}" for i in range(40)}
    clean = {i: words(rng.randint(20, 160)) for i in range(40, 80)} | {i: f"{words(30)}{i}{short}{i}{words(30)}" for i in (80, 91, 102)}
    texts = planted | clean
    got = {r["doc_id"]: r for r in repeats.removal_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert len(got) == len(texts) and all(r["n_bytes"] == len(texts[i]) for i, r in got.items())
    assert all(got[i]["n_removed"] >= len(passages[i % 4]) >= 400 and got[i]["n_spans"] == 1 for i in planted)
    assert all(got[i]["n_removed"] == 0 and got[i]["kept_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest() for i in clean)
