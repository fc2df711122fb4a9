import gzip
import hashlib
import io
from collections import defaultdict

import __spark_entry__ as E
from haze.llm import archives as A

SF = "/root/testdata/sf0.01"


def brute(rows, least=1000):
    last = {}
    by = defaultdict(list)
    for i, (page, _, html) in enumerate(rows):
        body = (html or "").encode()
        if len(body) >= least:
            by[body].append((page is not None, page or 0, i))
    for body, found in by.items():
        last[body] = max(found)
    out = []
    for i, (page, _, html) in enumerate(rows):
        body = (html or "").encode()
        again = body in last and last[body][1] != page
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response",
                    last[body][1] if again else None))
    return out


def test_query_equals_brute_force(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = sorted(tuple(r) for r in E.queries()["op2_arc_to_warc"](spark, SF).collect())
    assert got == sorted(brute(rows))


def test_edges(spark):
    big = "<p>é</p>" * 300
    rows = [(i, f"http://x.org/{i} a\nb", big if i % 3 else f"{i}{big}") for i in range(60)]
    rows += [(None, None, None), (99, "", "short"), (98, None, "short"), (97, "u", "a\r\n\r\nHTTP/1.1 200\r\n\r\nWARC/1.1\r\n" + "z" * 2000),
             (96, "u", "x" * 999), (95, "u", "x" * 999), (94, "u", "y" * 1000), (93, "u", "y" * 1000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, path string").repartition(5)
    got = sorted((tuple(r) for r in A.pages_through_archives(spark, df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert A.pages_through_archives(spark, df.limit(0)).count() == 0


def test_both_versions_keep_every_byte():
    for version in (1, 2):
        bodies = [b"", b"a\nb\n", bytes(range(256)) * 5]
        raw = A.arc_head(version, "n.arc") + b"".join(
            A.arc_record(version, "n.arc", 0, k, f"http://h/{k} x", b, "20210203040506") for k, b in enumerate(bodies))
        got = list(A.parse_arc(io.BytesIO(raw)))
        assert [A.split_http(r["body"])[1] for r in got] == bodies and not any(r["truncated"] for r in got)
        assert [r["url"] for r in got] == [f"http://h/{k}%20x" for k in range(3)]
        cut = list(A.parse_arc(io.BytesIO(raw[:-300])))
        assert len(cut) == 3 and cut[-1]["truncated"]
        noisy = list(A.parse_arc(io.BytesIO(A.arc_head(version, "n") + b"not a header\n\n" + raw[len(A.arc_head(version, "n.arc")):])))
        assert len(noisy) == 3 and noisy[0]["bad"] == 1


def test_warc_records_parse_back():
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\nX-Page-Id: 7\r\n\r\nabc"
    r = {"url": "http://h/", "ip": "192.0.2.1", "date": "2021", "mime": "text/html", "body": body, "truncated": True}
    ref = {"id": "<urn:uuid:1>", "url": "http://g/", "date": "20200101000000"}
    raw = A.converted("a.arc.gz", 0, r, None) + A.converted("a.arc.gz", 1, r, ref) + A.converted(
        "a.arc.gz", 2, r | {"body": b"dns stuff", "truncated": False}, None)
    got = list(A.parse_warc(io.BytesIO(raw)))
    assert [h["warc-type"] for h, _ in got] == ["response", "revisit", "resource"]
    assert got[0][1] == body and got[1][1].endswith(b"\r\n\r\n") and got[2][1] == b"dns stuff"
    assert got[0][0]["warc-date"] == "2021-01-01T00:00:00Z" and "warc-truncated" in got[0][0]
    assert got[1][0]["warc-payload-digest"] == got[0][0]["warc-payload-digest"]
    assert len({h["warc-record-id"] for h, _ in got}) == 3
    torn = gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(raw)[:-40]))
    assert len(list(A.parse_warc(torn))) >= 1
