import re

import __spark_entry__ as E
from haze.llm import quality

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, st string, n_words long, verdict string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else None
    if twice is None:
        from collections import Counter
        twice = {g for g, n in Counter(grams).items() if n > 1}
    hit = {k for i, g in enumerate(grams) if g in twice for k in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(hit))


def test_query_equals_brute_force(spark, docs):
    rows = E.queries()["op7_quality_rules"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_list_separates_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r["doc_id"]: r["kept"] for r in E.queries()["op7_quality_rules"](spark, sf).collect()}
    marks = [(kept[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    bad = [k for k, q in marks if q == 0]
    good = [k for k, q in marks if q == 1]
    assert sum(bad) / len(bad) < 0.2 and sum(good) / len(good) > 0.95


def test_edges(spark):
    long = "one two three four five " * 40
    rows = [(1, None, "x", 7, "v"), (2, "", None, None, None), (None, "a\x0bb é\n\n \n", "", 1, ""),
            (3, long, None, 1, None), (3, long, None, 1, None), (4, "k l m\nk l m\n" + "w " * 3, "", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int")
    out, rules = quality.rated(df, labels, ["doc_id"])
    assert rules == []
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                  for r in out.collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    kept = quality.filtered(df, labels)
    assert kept.columns == df.columns and kept.count() == 0
    assert quality.rated(df.limit(0), labels.limit(0), ["doc_id"])[0].count() == 0


def test_rules_are_learned_and_ordered(spark):
    rows = [(i, ("word%d " % i) * 1 + " ".join(f"w{i}x{k}" for k in range(20)) + ("".join(f" ***{k}" for k in range(9)) if i % 3 == 0 else ""))
            for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    out, rules = quality.rated(df, labels, ["doc_id"])
    assert rules and all(c.feature in quality.FEATURES for r in rules for c in r)
    good = {r["doc_id"] for r in out.collect() if r["verdict"] == "keep"}
    assert good == {i for i in range(300) if i % 3}


def statistics(spark, rows):
    """Learning rows (words, symbols, digits, bad, prune) as statistics."""
    names = ["n_words", "n_symbols", "n_digits"]
    rest = ["word_chars", "n_upper", "n_marks", "n_dup_lines", "n_lines", "n_repeat_words", "n_distinct_words"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names) + ", bad boolean, prune boolean")
    return df.selectExpr("*", "100000L AS word_chars", *[f"0L AS {n}" for n in rest[1:]])


def caught(df, rules):
    out = df.withColumn("v", quality.verdict(rules)).where("v like 'reject:%' and v <> 'reject:base'")
    return {(r["bad"], r["n"]) for r in out.groupBy("bad").agg({"*": "count"}).toDF("bad", "n").collect()}


def test_defect_in_the_outer_percent(spark):
    df = statistics(spark, [(1000, i, 0, i >= 3960, i % 3 == 0) for i in range(4000)])
    rules = quality.learn_rules(df)
    assert rules and all(len({(c.feature, c.above) for c in r}) == len(r) for r in rules)
    assert (True, 40) in caught(df, rules) or (True, 39) in caught(df, rules)
    assert sum(n for bad, n in caught(df, rules) if not bad) <= 4


def test_a_failed_conjunction_does_not_end_the_list(spark):
    # the best start holds in the growing rows alone; the defect in another statistic is learned after it
    rows = [(1000, 500 if i % 3 else 0, 0, i % 3 > 0, i % 3 == 0) for i in range(300)]
    rows = [(w, 500 if k < 60 else s, 0, bad, prune) for k, (w, s, _, bad, prune) in enumerate(rows)]
    rows += [(1000, 1, 900, True, i % 3 == 0) for i in range(60)] + [(1000, 1, 0, False, i % 3 == 0) for i in range(3000)]
    df = statistics(spark, rows)
    rules = quality.learn_rules(df)
    assert any(c.feature == "f_digits" for r in rules for c in r)


def test_more_than_eight_rules(spark):
    rows = [(1000 + 100 * (i // 100), 0, 0, (i // 100) % 2 == 1, i % 3 == 0) for i in range(2400)]
    df = statistics(spark, rows)
    rules = quality.learn_rules(df)
    assert len(rules) > 8 and caught(df, rules) == {(True, 1200)}


def test_filtered_computes_the_statistics_once(spark, monkeypatch):
    calls, made = [], quality.text_statistics
    monkeypatch.setattr(quality, "text_statistics", lambda *a: calls.append(1) or made(*a))
    rows = [(i % 30, " ".join(f"w{i}x{k}" for k in range(20)) + (" ***" if i % 3 == 0 else ""), f"s{i}") for i in range(60)]
    df = spark.createDataFrame([*rows, (None, rows[1][1], "n"), (None, rows[0][1], "n")], "Doc_ID long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    got = sorted((tuple(r) for r in quality.filtered(df, labels).collect()), key=str)
    want = [r for r in rows if "***" not in r[1]] + [(None, rows[1][1], "n")]
    assert got == sorted(want, key=str) and len(calls) == 1


def test_starts_grown_side_by_side_give_the_same_list(spark, monkeypatch):
    import random
    draw, plain = random.Random(3), {f: 0.0 for f in ("n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_digits", "n_dup_lines",
                                                      "n_lines", "n_repeat_words", "n_distinct_words")}
    rows = []
    for i in range(900):  # the label leans on three statistics, none of which is precise alone
        a, b, c = draw.random(), draw.random(), draw.random()
        rows.append({**plain, "n_words": 100.0, "word_chars": 500.0, "n_symbols": 40 * a, "n_digits": 40 * b, "n_upper": 40 * c, "n_lines": 1.0,
                     "bad": a + b + c + draw.random() > 2.6, "prune": i % 3 == 0})
    df, sides, seen = spark.createDataFrame(rows), quality._sides, []
    monkeypatch.setattr(quality, "_sides", lambda left, bins: seen.append(1) or sides(left, bins))
    lists = []
    for at_once in (1, 4):
        monkeypatch.setattr(quality, "AT_ONCE", at_once)
        lists.append(quality.learn_rules(df, bins=4, min_precision=0.97))
    assert lists[0] == lists[1] and len(seen) > 4


def test_cells_count_the_cuts_below(spark):
    cuts = [0.0, 1e-05, 0.5, 2.0, 1e20]
    values = [-1.0, 0.0, 1e-05, 0.3, 0.5, 0.50001, 2.0, 3.0, 1e20, 1e21]
    got = spark.createDataFrame([(v,) for v in values], "f double").selectExpr("f", f"{quality._cell('f', cuts, 7)} AS c").collect()
    assert [r["c"] for r in got] == [7 + sum(c < r["f"] for c in cuts) for r in got]
