import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from haze.llm import personal

SF = "/root/testdata/sf0.001"
# the contract's patterns, run plainly
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for k, c in enumerate(d[::-1]):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text)
            if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_query_equals_brute_force(spark, docs):
    rows = E.queries()["op4_personal_data"](spark, SF).collect()
    assert len(rows) == len(docs)
    n_base = n_more = 0
    for r in rows:
        base = brute(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(line(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(s[0] == k for s in base) for k in personal.KINDS]
        got = r["spans"].split(",") if r["spans"] else []
        assert set(line(base).split(",") if base else []) <= set(got)
        n_base, n_more = n_base + len(base), n_more + len(got) - len(base)
    assert n_base > 10 and n_more <= 0.1 * n_base


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@1-+ ()%é25", max_size=60))
def test_base_equals_patterns(text):
    assert personal.base_spans(text) == brute(text)


def test_address_parts_of_any_length():
    zeros = "0" * 5000
    assert personal.base_spans(zeros + ".1.2.3") == [("ip", 0, 5006)]
    assert personal.base_spans(f"a 1.{zeros}.{zeros}255.3 b") == [("ip", 2, 10010)]
    assert personal.base_spans(zeros + "256.1.2.3") == []


def test_base_is_linear_on_long_runs():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "@a" * 100_000, "a.1@b.c" * 50_000):
        personal.base_spans(t)


def sample():
    texts = []
    for i in range(300):
        texts.append(f"word{'x' * (i % 5)} and others call +1 ({200 + i}) 555-{1000 + 7 * i} please or mail u{i}.x@h{i % 9}.example.org "
                     f"then version {i % 9}.{i % 7} or server 10.{i % 250}.3.{i % 200} of {1900 + i % 150} items")
    return texts


def test_distant_repeats_take_the_label():
    model = personal.fit(sample())
    text = ("reach us at +1 (321) 555-7788 or later and much further on in the very same text they "
            "wrote 555-7788 again; the year 1987 and version 4.2 stay")
    graph = personal.Field()
    graph.add(0, text, personal.base_spans(text))
    assert graph.skip
    more = personal.added_spans(graph, model).get(0, [])
    assert [text[a:b] for k, a, b in more if k == "phone"] == ["555-7788"] and len(more) == 1
    alone = personal.Field()
    alone.add(0, "the year 1987 and version 4.2 stay", [])
    assert not personal.added_spans(alone, model)


def test_label_reaches_any_number_of_repeats():
    model = personal.fit(sample())
    full, bare = "reach us at +13215557788 or later. ", "they wrote 3215557788 again; "
    for n in (5, 30, 500):
        for before in (0, n // 2, n):
            text = bare * before + full + bare * (n - before)
            graph = personal.Field()
            graph.add(0, text, personal.base_spans(text))
            more = personal.added_spans(graph, model).get(0, [])
            assert [(k, text[a:b]) for k, a, b in more] == [("phone", "3215557788")] * n


def test_a_text_is_labelled_alike_alone_and_among_others():
    model = personal.fit(sample())
    texts = ["call +13215557788 or " + "bare 3215557788 and 12-34 77 " * n + f"u{n}@h.example.org" for n in (1, 9, 60)] + ["", "7"]
    def labels(some):
        graph = personal.Field()
        for i, t in some:
            graph.add(i, t, personal.base_spans(t))
        return personal.added_spans(graph, model)
    together = labels(list(enumerate(texts)))
    assert together and together == {k: v for i, t in enumerate(texts) for k, v in labels([(i, t)]).items()}


def test_edges_and_redaction(spark):
    rows = [(1, None, "a", 1), (2, "", "b", 2), (None, "mail a.b@c.de, ip 10.0.0.1! card 4111 1111 1111 1111 é", None, 3),
            (3, "+49 (30) 1234567 " * 2000, "x", None), (3, "no data", "x", None), (3, "no data", "x", None),
            (4, "1@2.3 +1 234 567 8901", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, row int")
    got = personal.report(df).collect()
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in got), key=str) == sorted(
        ((r[0], hashlib.sha256(line(brute(r[1])).encode()).hexdigest()) for r in rows), key=str)
    out = personal.redacted(df)
    assert out.columns == df.columns
    texts = [r["text"] for r in out.collect()]
    assert "mail <email>, ip <ip>! card <card> é" in texts and "<phone> " * 2000 in texts and None in texts
    assert personal.report(df.limit(0)).count() == 0
