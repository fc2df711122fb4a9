import re
from collections import defaultdict

import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as dirty
from tests.llm.test_decontaminate import words
from tests.llm.test_neardup import shingles
from tests.llm.test_personal import brute as private

SF = "/root/testdata/sf0.001"


def test_every_stage_takes_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            kept[k] = {r["doc_id"]: r for r in docs.collect()}
            assert len(kept[k]) == docs.count()
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] == 1}
    assert len(good & kept[0].keys()) >= 0.95 * len(good) and len(kept[0]) < len(texts)
    # one of each near-duplicate group, nothing else
    left = list(kept[1])
    sets = {d: shingles(texts[d], 5) for d in kept[0]}
    def near(a, b):
        both = len(sets[a] & sets[b])
        return both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
    assert not any(near(a, b) for i, a in enumerate(left) for b in left[:i])
    assert all(any(near(d, o) for o in kept[0] if o != d) for d in kept[0].keys() - kept[1].keys())
    # no benchmark window and no base personal data is left; other texts are untouched
    changed = 0
    grams = {tuple(words(t)[i:i + 10]) for _, t in items for i in range(len(words(t)) - 9)}
    for d, r in kept[2].items():
        w = words(texts[d])
        near = any(tuple(w[i:i + 10]) in grams for i in range(len(w) - 9))
        n_hit = dirty(texts[d], items)[1] if near else 0
        assert (r["text"] != texts[d]) == (n_hit > 0)
        changed += n_hit > 0
    assert changed
    assert kept[3].keys() == kept[2].keys()
    for d, r in kept[3].items():
        before = kept[2][d]["text"]
        assert not private(r["text"])
        if r["text"] != before:
            assert re.search("<(email|ip|card|phone)>", r["text"])
        else:
            assert not private(before)
        assert r["n_chars"] == len(r["text"])
    bins = defaultdict(int)
    for r in docs.collect():
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 4096 and {r["doc_id"] for r in docs.collect()} == kept[3].keys()


def test_run_equals_the_stages(spark):
    rows = P.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() >= rows.select("doc_id").distinct().count() > 0
