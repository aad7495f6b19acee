from __future__ import annotations

import datetime as dt
import http.server
import json
import threading

import pytest

from tidepool.config import Config, ConfigError, parse_args, parse_bytes, parse_duration
from tidepool.operators.crawl import crawl
from tidepool.runtime import materialise
from tidepool.sources.http import HttpSource, live
from tidepool.sources.stores import STORE
from tidepool.streaming import recrawl

W = "https://web.example"


def web(spark, pages: dict, robots: tuple = (404, "")):
    rows = [(f"{W}{p}", *(v if isinstance(v, tuple) else (200, "text/html", v, None)), None) for p, v in pages.items()]
    rows.append((f"{W}/robots.txt", robots[0], "text/plain", robots[1], None, None))
    return materialise(spark.createDataFrame(rows, STORE), "web")


def links(*to: str) -> str:
    return "<main><p>text</p>" + "".join(f'<a href="{t}">x</a>' for t in to) + "</main>"


def test_dead_and_external_links(spark):
    done = crawl(spark, web(spark, {"/": links("/a", "/missing", "https://else.example/"), "/a": links("/")}), f"{W}/", Config(sitemap="off"))
    assert (done.written, done.failed, done.pending, done.exit_code) == (2, 1, 0, 0) and {r["canonical_url"] for r in done.frontier.collect()} == {f"{W}/", f"{W}/a", f"{W}/missing"}
    assert [(r["error_kind"], r["canonical_url"]) for r in done.errors.collect()] == [("fetch_failed", f"{W}/missing")]
    assert done.manifest.count() == 2


def test_robots(spark):
    store = web(spark, {"/": links("/private/secret"), "/private/secret": links()}, (200, "User-agent: *\nDisallow: /private/"))
    done = crawl(spark, store, f"{W}/", Config(sitemap="off"))
    assert (done.written, done.skipped) == (1, 1)
    assert crawl(spark, store, f"{W}/", Config(sitemap="off", ignore_robots=True)).written == 2
    closed = crawl(spark, web(spark, {"/": links()}, (503, "")), f"{W}/", Config(sitemap="off"))
    assert closed.written == 0 and closed.errors.head()["error_kind"] == "robots_fetch_failed" and closed.exit_code == 1


def test_body_limit_redirect_and_retry(spark):
    big = crawl(spark, web(spark, {"/": "x" * 100_000}), f"{W}/", Config(sitemap="off", max_body_size=1024))
    assert (big.written, big.failed) == (0, 1)
    moved = crawl(spark, web(spark, {"/start": (302, None, "", "/final"), "/final": links()}), f"{W}/start", Config(sitemap="off"))
    assert moved.written == 1 and moved.corpus.head()["final_url"] == f"{W}/final"
    busy = crawl(spark, web(spark, {"/": (429, None, "", None)}), f"{W}/", Config(sitemap="off", retries=2))
    assert (busy.written, busy.failed) == (0, 3) and busy.frontier.head()["attempts"] == 3


def test_depth_globs_relevance_sitemap_budget(spark):
    pages = {"/": links("/a/1", "/b/1"), "/a/1": links("/a/2"), "/a/2": links("/a/3"), "/a/3": links(), "/b/1": links(), "/s": "<main>special word</main>", "/sitemap.xml": (200, "text/xml", f"<loc>{W}/s</loc>", None)}
    store = web(spark, pages)
    urls = lambda c: {r["canonical_url"].removeprefix(W) for r in c.corpus.collect()}
    assert urls(crawl(spark, store, f"{W}/", Config(sitemap="off", max_depth=1))) == {"/", "/a/1", "/b/1"}
    assert urls(crawl(spark, store, f"{W}/", Config(include=["/a/*"], exclude=["*/3"]))) == {"/", "/a/1", "/a/2", "/s"}
    gated = crawl(spark, store, f"{W}/", Config(for_queries=["special"]))
    assert urls(gated) == {"/s"} and gated.skipped == 5
    pruned = crawl(spark, store, f"{W}/", Config(for_queries=["special"], for_prune=True))
    assert urls(pruned) == {"/s"} and pruned.pending == 1 and pruned.exit_code == 1
    budget = crawl(spark, store, f"{W}/", Config(max_pages=3, batch_mode="exact", concurrency=1, per_host_concurrency=1))
    assert budget.truncated and budget.exit_code == 1


def test_config():
    c = parse_args(["crawl", "https://example.com", "--timeout", "2m", "--max-body-size=5MiB", "--include", "/a/*", "--include=/b", "--for", "x y", "--merge", "-o", "dir"])
    assert c.urls == ["https://example.com"] and (c.config.timeout_ms, c.config.max_body_size, c.config.include, c.config.for_queries, c.config.merge, c.config.output) == (120_000, 5_242_880, ["/a/*", "/b"], ["x y"], True, "dir")
    s = parse_args(["search", "dir", "two", "words", "--json", "--mode", "all"])
    assert (s.kind, s.directory, s.query, s.json, s.mode) == ("search", "dir", "two words", True, "all")
    assert parse_args(["--help"]).kind == "help" and parse_args(["--", "https://example.com"]).urls == ["https://example.com"]
    for bad in ([], ["https://example.com", "--max-pages", "0"], ["https://example.com", "--concurrency=0"], ["https://example.com", "--nope"], ["ftp://example.com"], ["https://localhost"], ["https://u@example.com"], ["https://example.com", "--merge=yes"], ["https://example.com", "--max-total-bytes", "1MiB"], ["search", "d"], ["https://example.com", "--per-host-concurrency=9"]):
        with pytest.raises(ConfigError):
            parse_args(bad)
    assert (parse_duration("250ms"), parse_duration("30s"), parse_bytes("1GiB"), parse_bytes("7")) == (250, 30_000, 1 << 30, 7)
    a, b = Config(), Config(include=["/x"])
    assert a.fingerprint("u") == b.fingerprint("u") != Config(max_depth=4).fingerprint("u") and a.lease_ms == 180_000


def test_live_source_on_loopback(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(302 if self.path == "/r" else 200)
            self.send_header("Content-Type", "text/html")
            self.send_header("Location", "/x") if self.path == "/r" else None
            self.end_headers()
            self.wfile.write(b"<main>\xe9</main>" if self.path == "/latin" else b"<main>hi</main>" * (1000 if self.path == "/big" else 1))

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(HttpSource)
    read = lambda **o: {r["url"].removeprefix(base): r for r in spark.read.format("tidepool_http").options(urls=json.dumps([f"{base}/a", f"{base}/r", f"{base}/big", f"{base}/latin"]), max_body_size="1000", **o).load().collect()}
    got = read(allow_private="true")
    assert (got["/a"]["status"], got["/a"]["body"], got["/a"]["utf8"], got["/r"]["location"]) == (200, "<main>hi</main>", True, "/x")
    assert (got["/big"]["status"], len(got["/big"]["body"])) == (200, 1001)  # one byte more than may be
    assert (got["/latin"]["body"], got["/latin"]["utf8"]) == ("<main>\ufffd</main>", False)
    assert {r["status"] for r in read().values()} == {None}  # loopback is no public address
    done = crawl(spark, live(allow_private=True), f"{base}/latin", Config(sitemap="off", allow_private_network=True, ignore_robots=True))
    assert (done.written, done.failed, done.errors.head()["error_kind"]) == (0, 1, "not_html")
    server.shutdown()


def test_streamed_changes(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "url string, fetched_at timestamp, body string"
    for i, rows in enumerate([[("u", at(1), "a"), ("v", at(1), "x")], [("u", at(2), "a"), ("u", at(3), "b")], [("v", at(9), "x"), ("u", at(9), "b")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = recrawl.changes(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["url"], r["fetched_at"].minute, r["change"]) for r in spark.table("seen").collect())
    assert got == [("u", 1, "new"), ("u", 2, "unchanged"), ("u", 3, "changed"), ("u", 9, "unchanged"), ("v", 1, "new"), ("v", 9, "unchanged")]
