import math
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as E
from haze.llm import urls
from haze.llm.catalog import URL_RULES

SF = "/root/testdata/sf0.01"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].translate(AZ), rest[cut:]
    return host, tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]


def rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


def brute_scores(texts, order=urls.ORDER):
    """Witten-Bell interpolated models of both classes over {text: (label, n)}, by plain counting."""
    def model(label):
        counts = [defaultdict(Counter) for _ in range(order + 1)]
        for s, (lab, n) in texts.items():
            if lab == label:
                p = urls.PAD * order + s + urls.END
                for i in range(order, len(p)):
                    for k in range(order + 1):
                        counts[k][p[i - k:i]][p[i]] += n

        def prob(ctx, c):
            p = urls.UNIFORM
            for k in range(order + 1):
                seen = counts[k].get(ctx[order - k:])
                if seen:
                    p = (seen[c] + len(seen) * p) / (sum(seen.values()) + len(seen))
            return p
        return prob

    a, b = model("allow"), model("block")
    out = {}
    for s in texts:
        p = urls.PAD * order + s + urls.END
        r = [math.log(a(p[i - order:i], p[i]) / b(p[i - order:i], p[i])) for i in range(order, len(p))]
        out[s] = sum(r) / len(r)
    return out


def test_query_hosts_paths_and_rules(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = E.queries()["op6_url_filter"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path = split(pages[r["page_id"]])
        name, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name)
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_scores_equal_brute_force(spark):
    texts = defaultdict(lambda: [None, 0])
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        host, path = split(r["url"])
        t = texts[host + path]
        t[0], t[1] = rule(host, path)[1], t[1] + 1
    df = spark.createDataFrame([(s, lab, n) for s, (lab, n) in texts.items()], "s string, label string, n long")
    want = brute_scores({s: tuple(v) for s, v in texts.items()})
    got = {r["s"]: r["score"] for r in urls.language_scores(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], abs=1e-9) for s in want)


def test_model_follows_the_labels(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'spam'}{i % 7}.site/{'a' * (i % 5)}{i}") for i in range(200)]
    rules = [urls.Rule(f"spam{k}.site", "/", "block") for k in range(5)] + [
        urls.Rule(f"good{k}.site", "/", "allow") for k in range(5)]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    free = [r for r in out if r["rule"] is None]
    assert free and all((r["verdict"] == "allow") == (r["page_id"] % 2 == 1) for r in free)


def test_whole_urls_are_modelled(spark):
    ways = ["http://{}.site/p?go={}", "http://{}.site/p#{}", "{}.site/p?go={}"]
    rows = [(i, ways[i % 3].format(f"h{i // 6 % 9}", ("prize%d" if i % 2 else "atlas%d") % (i // 6 % 4)), i % 2) for i in range(216)]
    rows += [(i + 300, f"http://{'bad' if i % 2 else 'ok'}.site/p{'#' if i % 3 else '?go='}{('prize%d' if i % 2 else 'atlas%d') % (i % 5)}", i % 2)
             for i in range(200)]
    rows += [(600, None, 0)]
    rules = [urls.Rule("bad.site", "/", "block"), urls.Rule("ok.site", "/", "allow")]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), rules).collect()
    assert len(out) == len(rows)
    assert all((r["verdict"] == "block") == (r["bad"] == 1) for r in out)
    assert all((r["score"] is None) == (r["url"] is None) for r in out if r["rule"] is None)


def test_modelled_text(spark):
    want = {None: None, "": "", "no SCHEME?x": "no SCHEME?x", "x://": "x://", "HTTP://A.Net/P?Q#F": "HTTP://a.net/P?Q#F",
            "a://B.org?X": "a://b.org?X", "s://H#F://G": "s://h#F://G"}
    df = spark.createDataFrame([(k,) for k in want], "url string")
    host, _ = urls.host_path(df["url"])
    assert {r["url"]: r["m"] for r in df.select("url", urls.modelled(df["url"], host).alias("m")).collect()} == want


def test_edges(spark):
    rows = [(1, None, "h", 1.5), (2, "no scheme", "h", 1.5), (3, "x://", None, None), (4, "HTTP://A.NET/é#f", "", 0.0),
            (5, "a://b.org?x/fr/", "", 0.0), (6, "s://SUB.example.NET/en/?q", "", 0.0), (None, "q://" + "z" * 5000, "", 0.0),
            (4, "HTTP://A.NET/é#f", "", 0.0)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, score double")
    got = urls.judge(df, URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = split(r["url"])
        assert (r["host"], r["path"]) == (host, path) and r["rule"] == rule(host, path)[0]
    assert {r["verdict"] for r in got if not r["host"]} == {"allow"}
    assert urls.judge(df.limit(0), URL_RULES).count() == 0
