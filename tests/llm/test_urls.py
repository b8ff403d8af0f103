import re

from tracewright.llm import urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("b.example.com", "", "block"), (None, "/", "block")]
URLS = ["http://Example.com/en/1?x=1", "https://WWW.example.com/en/2#t", "http://notexample.com/en/", "http://a.net/es/9", "http://net/fr/", "ftp://x.b.example.com", "http://b.example.com/en/", "nothing", None, "", "://", "http://a.com", "http://a.com/?q://z", "x://y://z/es/", "http://com.example/en/", "http://é.COM/\nx", "http://a..com/en", "http://.net/es/"]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_judge(spark):
    rows = [(i, u, "html") for i, u in enumerate(URLS * 5)] + [(None, URLS[0], None)] * 2
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = [tuple(r) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), rules).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *brute(u))) for i, u, _ in rows)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


def test_sample_is_bounded(spark):
    """The ranges' sample follows its own size, not the table's; long urls are cut in it."""
    rows = spark.range(40_000).selectExpr("id as page_id", "concat('http://h', id % 7, '.example.com/en/', repeat('p', 600), id) as url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urls.judge(rows, rules, sample=300, longest=50)
    assert got.count() == 40_000 and got.select("rule", "verdict").distinct().collect() == [("example.com/en/", "block")]
