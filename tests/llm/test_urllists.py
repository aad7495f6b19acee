from __future__ import annotations

import datetime as dt

from tidepool.llm.urllists import intervals, judge

ENTRIES = "list string, kind string, pattern string, action string, at date"
D = lambda n: dt.date(2024, 1, n)
HISTORY = [
    ("a", "domain", "Bad.Example", "add", D(5)), ("a", "domain", "bad.example", "remove", D(10)), ("a", "domain", "bad.example", "add", D(15)), ("b", "domain", "bad.example", "add", D(12)), ("b", "domain", "bad.example", "add", D(13)),
    ("c", "prefix", "ok.example/x/", "add", D(3)), ("c", "domain", "same.day", "add", D(4)), ("c", "domain", "same.day", "remove", D(4)), (None, "domain", "n.example", "add", D(1)), ("c", "domain", None, "add", D(1)), ("c", "other", "z.example", "add", D(1)),
]


def brute(url, t):
    if url is None or t is None:
        return set()
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = rest.split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2].split(":")[0].lower()
    path = host + "/" + "/".join(s for s in rest.split("?")[0].split("#")[0].split("/")[1:] if s)
    state = {}
    for lst, kind, pattern, action, at in sorted((h for h in HISTORY if h[0] and h[2] and h[1] in ("domain", "prefix")), key=lambda h: (h[4], h[3])):
        pattern = pattern.lower().rstrip("/")
        if at <= t and host:
            hit = host == pattern or host.endswith("." + pattern) if kind == "domain" else path.lower().rstrip("/") == pattern or path.lower().startswith(pattern + "/")
            if hit:
                state[(lst, kind, pattern)] = action
    return {k for k, v in state.items() if v == "add"}


def test_captures_against_brute_force(spark):
    hosts = ["https://bad.example/", "http://www.BAD.example:80/a?b", "https://notbad.example/", "https://user@bad.example/x", "https://ok.example/x", "https://ok.example/x/y#z", "https://ok.example/xy", "https://same.day/", "no url", "", None, "https://n.example/"]
    captures = [(i, h, d) for i, h in enumerate(hosts) for d in [D(k) for k in range(1, 20)] + [None]]
    df = spark.createDataFrame(captures + captures[:3], "page_id bigint, url string, fetched date").selectExpr("*", "'x' AS list", "'y' AS kind", "1 AS key", "2 AS since")
    rows = judge(df, spark.createDataFrame(HISTORY, ENTRIES), id_col="page_id").collect()
    assert len(rows) == len(captures)
    for r in rows:
        want = brute(r["url"], r["fetched"])
        assert (r["n_active"], r["blocked"], list(r["lists"])) == (len(want), bool(want), sorted({w[0] for w in want})), r
        assert r["valid"] == bool(r["url"] and "://" in r["url"])


def test_intervals_and_empty_tables(spark):
    got = {(r["list"], r["key"], r["since"], r["until"]) for r in intervals(spark.createDataFrame(HISTORY, ENTRIES)).collect()}
    assert ("a", "bad.example", D(5), D(10)) in got and ("a", "bad.example", D(15), None) in got and not any(k == "same.day" for _, k, _, _ in got)
    none = spark.createDataFrame([], ENTRIES)
    captures = spark.createDataFrame([(1, "https://bad.example/", D(6))], "page_id bigint, url string, fetched date")
    assert [r["blocked"] for r in judge(captures, none, id_col="page_id").collect()] == [False]
    assert judge(captures.where("false"), spark.createDataFrame(HISTORY, ENTRIES), id_col="page_id").count() == 0
