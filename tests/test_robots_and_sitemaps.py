from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import robots, sitemap

RULES = "rules array<struct<allow:boolean,pattern:string>>, path string"


def fold(rules, path):
    """The rules one after another: a later allow may take over, a later disallow never does."""
    length, allow = None, True
    for a, p in rules:
        if path.startswith(p) and (length is None or (a and len(p) >= length)):
            length, allow = len(p), a
    return allow


def longest(rules, path):
    hits = [(len(p), a) for a, p in rules if path.startswith(p)]
    return max(hits)[1] if hits else True


@pytest.mark.parametrize("mode, plain", [("ordered", fold), ("rfc9309", longest)])
def test_modes_against_plain_versions(spark, mode, plain):
    rng = random.Random(2)
    rows = [([(rng.random() < 0.5, "/" + "".join(rng.choices("ab", k=rng.randrange(4)))) for _ in range(rng.randrange(6))], "/" + "".join(rng.choices("ab", k=rng.randrange(5)))) for _ in range(3000)]
    rows += [([(True, "/"), (False, "/private/")], "/private/x"), ([(False, "/private/"), (True, "/")], "/private/x"), ([(False, "/"), (True, "/pub")], "/pub/a")]
    got = spark.createDataFrame(rows, RULES).select("rules", "path", robots.allowed(F.col("rules"), F.col("path"), mode).alias("ok")).collect()
    for r in got:
        assert r["ok"] == plain([(x["allow"], x["pattern"]) for x in r["rules"]], r["path"])


def test_parse(spark):
    body = "User-agent: other\nUser-agent: *\nDisallow: /a*\nallow:/b # c\nDisallow:\nCrawl-Delay: 3\nUser-agent: x\nDisallow: /never\nCrawl-delay: 99\nUser-agent: TIDEPOOL\nDisallow: *\nCrawl-delay: 1.5\nCrawl-delay: soon"
    row = robots.parse(spark.createDataFrame([("o", body), ("e", "")], "origin string, body string")).where("origin = 'o'").head()
    assert [(r["allow"], r["pattern"]) for r in row["rules"]] == [(False, "/a"), (True, "/b"), (False, "")] and row["crawl_delay"] == 3.0


def test_outcomes(spark):
    files = spark.createDataFrame([("ok", 200, [(False, "/x")]), ("gone", 404, None), ("shut", 403, None), ("down", 503, None)], "origin string, status int, rules array<struct<allow:boolean,pattern:string>>")
    asked = spark.createDataFrame([("ok", "/x"), ("ok", "/y"), ("gone", "/x"), ("shut", "/x"), ("down", "/x"), ("unknown", "/x")], "origin string, path string")
    got = {(r["origin"], r["path"]): r["robots"] for r in robots.evaluate(asked, files).collect()}
    assert got == {("ok", "/x"): "denied", ("ok", "/y"): "allowed", ("gone", "/x"): "no_rules", ("shut", "/x"): "fail_closed", ("down", "/x"): "fail_closed", ("unknown", "/x"): "fail_closed"}
    assert {r["robots"] for r in robots.evaluate(asked, files, ignore=True).collect()} == {"allowed"}


def test_sitemaps(spark):
    index = "<sitemapindex>" + "".join(f"<loc>https://o.example/{i}.xml</loc>" for i in range(40)) + "</sitemapindex>"
    rows = [("https://o.example/i.xml", index)] + [(f"https://o.example/{i}.xml", f"<loc> https://o.example/p{i} </loc><loc>http://o.example/n</loc><loc></loc><loc>https://o.example:443/q{i}</loc><loc>open") for i in range(40)]
    store = spark.createDataFrame(rows, "url string, body string")
    asked = spark.createDataFrame([("https://o.example", "https://o.example/i.xml"), ("https://o.example", "https://o.example/none.xml")], "origin string, sitemap string")
    got = [r["url"] for r in sitemap.load(asked, store).orderBy("position").collect()]
    assert got == [u for i in range(32) for u in (f"https://o.example/p{i}", f"https://o.example:443/q{i}")]
    found = sitemap.discover(spark.createDataFrame([("https://o.example", "Sitemap: https://a/x.xml # c\nSITEMAP:https://b/y.xml"), ("https://n.example", None)], "origin string, body string"))
    assert [r["sitemap"] for r in found.where("origin LIKE '%o.example'").orderBy("position").collect()] == ["https://a/x.xml", "https://b/y.xml", "https://o.example/sitemap.xml"]
    assert [r["sitemap"] for r in found.where("origin LIKE '%n.example'").collect()] == ["https://n.example/sitemap.xml"]
