import hashlib
import re

import __spark_entry__ as E
from haze.llm import decontaminate as D

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def brute(text, items):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        for g in {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) == g:
                    hit |= set(range(i, i + n))
                    ids.add(str(item))
    return len(w), len(hit), sorted(ids), hit


def test_query_equals_brute_force(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(words(t)[i:i + 10]) for _, t in items for i in range(len(words(t)) - 9)}
    rows = E.queries()["op1_decontaminate"](spark, SF).collect()
    assert len(rows) == len(docs) and any(r["contaminated"] for r in rows)
    for r in rows:
        w = words(docs[r["doc_id"]])
        near = any(tuple(w[i:i + 10]) in grams for i in range(len(w) - 9))
        n, hit, ids, _ = brute(docs[r["doc_id"]], items) if near else (len(w), 0, [], None)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(ids))
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0)


ITEMS = [(2, "Short item"), (10, "a b c d e f g h i j k l m"), (None, "Ünï çode ß"), (3, None), (4, "..."), (2, "short  ITEM"),
         (5, "A b c d e f g h i j")]
DOCS = [(1, "Say: a-b c d e f g h i j k, and on", None, "x"), (2, "no short. item! here SHORT", 1, "x"), (3, None, 1, None),
        (4, "", 1, ""), (None, "short item short item", 2, "x"), (5, "...Ünï çode ß; Ünï çode ẞ end", 3, "k"),
        (2, "no short. item! here SHORT", 1, "x"), (6, "clean text 10", 9, "h"),
        (7, "k l " + "a b c d e f g h i j k l m " * 60 + "tail", 9, "h")]


def test_edges_and_span_removal(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame(DOCS, "doc_id long, text string, hits int, key string")
    got = sorted(D.annotated(df, items).select("row.doc_id", "row.text", "n_words", "n_hit", "items").collect(), key=str)
    named = [("null" if i is None else i, t) for i, t in ITEMS]
    assert got == sorted([(d[0], d[1], *brute(d[1], named)[:3]) for d in DOCS], key=str)
    for limit in (D.BROADCAST_BYTES, 0):
        out = D.decontaminated(df, items, broadcast_bytes=limit)
        assert out.columns == df.columns
        rows = out.collect()
        for r in rows:
            n, hit, _, _ = brute(r["text"], [])
            assert n > 0 or not words(r["text"])
        want = []
        for d in DOCS:
            n, hit, _, where = brute(d[1], named)
            if not hit or hit < n:
                want.append((d[0], [w for i, w in enumerate(words(d[1])) if i not in where]))
        assert sorted([(r["doc_id"], words(r["text"])) for r in rows], key=str) == sorted(want, key=str)
        assert {r["text"] for r in rows if r["doc_id"] == 6} == {"clean text 10"}
    assert {r["doc_id"] for r in D.decontaminated(df, items, remove="documents").collect()} == {3, 4, 6}
    assert D.annotated(df.limit(0), items).count() == 0
    assert all(r["n_hit"] == 0 for r in D.annotated(df, items.limit(0)).collect())
