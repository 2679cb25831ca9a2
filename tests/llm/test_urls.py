"""Url verdicts against a look at every rule, on nested, odd and repeated rules and urls."""

import random

import pytest

from vigilia.llm import url_rules

RULES = "host string, path string, verdict string"


def slow(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    whole = rest.split("#")[0].split("?")[0]
    host, path = (whole[: whole.index("/")], whole[whole.index("/") :]) if "/" in whole else (whole, "")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = {}
    for h, p, v in rules:
        if h is None or p is None or v is None or set(h) & set("/?#"):
            continue
        h = "".join(c.lower() if c.isascii() else c for c in h)
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            fit.setdefault((len(h) + len(p), len(h), h + p), set()).add(v)
    if not fit:
        return host, path, None, default
    size = max(fit)
    return host, path, size[2], "block" if "block" in fit[size] else "allow"


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(4)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, spark.createDataFrame(rules, RULES)).collect()}
    assert got == {i: slow(u, rules) for i, u in enumerate(urls)}


def test_odd_urls(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("COM", "/", "allow"), ("b.com", "/x", "allow"), ("b.com", "/x", "block"),
             (None, "/", "block"), ("com", None, "block"), ("a/b", "/", "block"), ("é.fr", "/ü", "block"), ("-x.com", "", "block"), ("com", "", "allow"), ("1.com", "/\x00", "block")]
    urls = [None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://WWW.EXAMPLE.COM/en/?q#f", "http://www.example.com/EN/", "x://a://com/", "http://notcom/",
            "http://example.com?en/", "http://example.com#/en/", "http://a.-x.com/", "http://.com/", "http://com./", "http://b.com/x" + "y" * 5000, "http://x.é.fr/ü", "http://é.fr/ü/z",
            "http://a\nb.com/x\ny", "http://1.com/\x00a", "http://a..com/", "http://com/x" * 3, "http://user@b.com:80/x"] * 3
    check(spark, urls, rules)


@pytest.mark.parametrize("seed", range(3))
def test_random_rules(spark, seed):
    rnd = random.Random(seed)
    host = lambda: ".".join(rnd.choice(["a", "b", "-", "a-", ""]) for _ in range(rnd.randint(1, 4)))
    path = lambda: rnd.choice(["", "/"]) + "".join(rnd.choice("ab/") for _ in range(rnd.randint(0, 4)))
    rules = [(host() if rnd.random() < 0.9 else "", path(), rnd.choice(["allow", "block"])) for _ in range(120)]
    check(spark, [f"h://{host()}{('/' + path()) if rnd.random() < 0.9 else ''}" for _ in range(1500)], rules)


def test_nothing(spark):
    none = spark.createDataFrame([], RULES)
    assert [tuple(r) for r in url_rules.judge(spark.createDataFrame([(1, "a://b/c")], "page_id long, url string"), none, default="block").collect()] == [(1, "a://b/c", "b", "/c", None, "block")]
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([("com", "/", "allow")], RULES)).count() == 0


def test_no_python_on_the_path(spark, sf_dir):
    plan = url_rules.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Arrow", "ExistingRDD", "CartesianProduct", "NestedLoop") if w in plan]


def test_hot_host_fills_many_ranges(spark):
    """All urls of one host: their pairs lie in every range of the sweep, not in one."""
    points = spark.range(4000).selectExpr("'h' AS host", "concat('/', id) AS path", "CAST('h.' AS BINARY) AS at")
    marks = spark.sql("SELECT CAST('h.' AS BINARY) AS at, array('h.') AS stack")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = url_rules.sweep(points, marks, ["at"], "stack")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.where("stack = array('h.')").count() == 4000
    sizes = [r["count"] for r in out.sparkSession.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_range").count().collect()]
    assert len(sizes) >= 2 and max(sizes) < 2000
