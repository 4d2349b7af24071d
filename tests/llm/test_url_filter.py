"""The Bloom filter cascade and URL verdicts against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from visilake.llm import url_filter

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(("listed", "universe"), [(1, 5000), (300, 20_000), (5000, 5000), (4000, 6000), (0, 100)])
def test_cascade_is_exact_over_its_universe(spark, listed, universe):
    every = spark.range(universe).select(F.concat(F.lit("k"), "id").alias("key"))
    keys = every.where(F.substring("key", 2, 9).cast("int") < listed).unionByName(every.limit(0)).unionByName(every.where(F.substring("key", 2, 9).cast("int") < listed))
    cascade = url_filter.Cascade(keys, every.unionByName(spark.sql("SELECT cast(null AS string) AS key")))
    found = every.select("key", cascade.contains(F.col("key")).alias("held")).collect()
    assert len(found) == universe and all(r["held"] == (int(r["key"][1:]) < listed) for r in found)
    assert spark.sql("SELECT cast(null AS string) AS key").select(cascade.contains(F.col("key")).alias("held")).first()["held"] is False


def test_levels_go_on_until_nothing_wrong_passes(spark):
    every = spark.range(30_000).select(F.col("id").cast("string").alias("key"))
    cascade = url_filter.Cascade(every.where("int(key) % 3 = 0"), every)
    assert len(cascade.levels) >= 3  # the first filters have false positives, so the others decide
    wrong = every.where(cascade.levels[0].passes(F.col("key"))).where("int(key) % 3 <> 0").count()
    assert wrong > 0
    assert every.where(cascade.contains(F.col("key")) != (F.col("key").cast("int") % 3 == 0)).count() == 0


URLS = [
    "http://a.example.com/en/1?x#y", "https://www.example.com/en/2", "https://WWW.Example.COM/en/2", "http://example.com/en/", "http://example.com/en", "http://example.com/EN/3",
    "http://example.com", "http://com/", "http://x.net/es/1", "http://net/fr/", "http://x.net/de/", "http://evilnet/es/1", "http://x.org/es/1", "no scheme", "", None, "://", "http://", "http:///en/", "a://b://c.net/es/",
    "http://casino-win.x.org/1", "http://m.casino-win.x.org", "http://m.casino-win.x.org/a", "http://casinos.x.org/a", "http://x-ads-y.net/de/", "http://deep.x-ads-y.net/fr/1", "http://spam/", "http://pills.net./x",
    "http://" + "a." * 3000 + "com/" + "en/" * 3000, "http://x.com/\nen/", "http://ÄÖ.example.com/en/ü", "http://a.example.com/en/1?x#y", "http://user@www.example.com:80/en/", "http://bets.example.com/en/1",
]


def expected(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)

    def fits(key):
        h, p = key.split("/", 1)
        return (host == h or host.endswith("." + h)) and path.startswith("/" + p)

    longest = lambda keys: max((k for k in keys if fits(k)), key=len, default=None)
    rule, held = longest([k for k, _ in url_filter.RULES]), longest(listed)
    return host, path, rule, dict(url_filter.RULES)[rule] if rule else "block" if held else "allow", held


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(URLS)] + [(None, URLS[0], None), (0, URLS[0], "<p>")], PAGES)
    listed = {r["key"] for r in url_filter.listed_hosts(pages).collect()}
    assert listed == {"casino-win.x.org/", "x-ads-y.net/", "pills.net./", "bets.example.com/"}
    found = url_filter.verdict_rows(pages.selectExpr("*", "1 AS host", "2 AS path", "'x' AS key", "3 AS rule", "4 AS verdict")).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        url = URLS[r["page_id"] or 0]
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["listed"]) == expected(url, listed), url


def test_other_lists(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/x/y/z", ""), (2, "http://a.b.c/x/", ""), (3, "http://b.c/x/y", "")], PAGES)
    rules = spark.createDataFrame([("b.c/x/y", "block"), ("a.b.c/x/y/z", "allow")], "key string, verdict string")
    none = rules.where("false").select("key")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules, none).collect()} == {1: ("a.b.c/x/y/z", "allow"), 2: (None, "allow"), 3: ("b.c/x/y", "block")}
    assert {r["verdict"] for r in url_filter.judge(pages, rules.where("false"), none).collect()} == {"allow"}
    empty = url_filter.verdict_rows(pages.where("false"))
    assert empty.collect() == [] and empty.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]


def test_no_python_on_the_main_path(spark):
    pages = spark.createDataFrame([(1, "http://spam.x.org/", "")], PAGES)
    plan = url_filter.verdict_rows(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
