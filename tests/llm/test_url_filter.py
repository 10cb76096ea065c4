import random

from pyspark.sql import functions as F

from tidefence.llm import url_filter as U
from tidefence.llm.queries import RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    best = None
    for r in RULES:
        fits = (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
        if fits and (best is None or len(r.text) > len(best.text)):
            best = r
    return best


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.NET/en/1", "http://example.net", "http://example.net/en/", "http://xexample.net/en/2", "http://m.example.com/de/3?x=/y#z",
    "http://example.com/DE/3", "ftp://a.org/fr/4/", "http://org/fr/", "http://b.org#/fr/", "http://c.org?q=http://d.net/x", "//e.net/x", "x://y://z.net/k", "http://ünicode.net/ä/1", "http://n.net/a\nb/c?d",
]


def test_urls_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.page_id: r for r in U.judge(df, RULES).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = split(url)
        r = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, r and r.text), url
        assert got[i].verdict in ("allow", "block") and (r is None or got[i].verdict == r.verdict)


def test_templates(spark):
    r = random.Random(1)
    rows = [("h.com", f"/en/{r.randint(1, 9999)}.html") for _ in range(50)] + [("h.com", f"/tag/{w}") for w in ("".join(r.choices("abcdefghij", k=9)) for _ in range(80))] + [("h.com", "/about"), ("h.com", "/a/b/c/d/e/f")]
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(rows)], "page_id long, url string")
    t = [x.template for x in U.judge(df, []).orderBy("page_id").collect()]
    assert set(t[:50]) == {"/en/{n}.html"} and set(t[50:130]) == {"/tag/*"} and t[130] == "/about" and t[131] == "/a/b/c/d/**"


def test_labelled_templates_are_rejected_and_others_are_not(spark):
    rows = [f"http://s.com/bad/{i}" for i in range(30)] + [f"http://s.com/good/{i}" for i in range(30)] + [f"http://t.com/free/{i}" for i in range(10)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    # rules that label even numbers only
    rules = [U.Rule(f"s.com/bad/{i}", "block") for i in range(10, 30, 2)] + [U.Rule(f"s.com/good/{i}", "allow") for i in range(10, 30, 2)]
    got = {r.page_id: r.verdict for r in U.judge(df, rules).collect()}
    assert {got[i] for i in range(30)} == {"block"} and {got[i] for i in range(30, 70)} == {"allow"}


def test_shapes(spark):
    values = {"12": "{n}", "12.html": "{n}.html", "2024-05-06": "{date}", "deadbeef01": "{hex}", "a1b": "{mixed}", "plain": "plain", "plain.html": "plain.html", "v2.txt": "{mixed}.txt"}
    df = spark.createDataFrame([(k,) for k in values], "s string")
    assert [r[0] for r in df.select(U.shape_of(F.col("s"))).collect()] == list(values.values())


def test_hot_host_empty_table_and_clashes(spark):
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://hot.net/en/"), "id").alias("url"), F.lit(1).alias("rule"), F.lit(1).alias("key"), F.lit(1).alias("host"), F.lit(1).alias("n"))
    got = U.judge(df, RULES)
    assert got.count() == 3000 and got.filter("verdict = 'block'").count() == 3000
    assert U.judge(df.limit(0), RULES).count() == 0
    twice = U.judge(df.union(df), RULES)
    assert twice.count() == 6000
