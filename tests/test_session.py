from __future__ import annotations

import http.server
import threading
import time

import pytest

from tidepool.config import Config
from tidepool.plans import session
from tidepool.runtime import materialise
from tidepool.sources.stores import STORE

PAGES = {
    "/": '<title>Home page</title><main><p>welcome to the pool</p><a href="/a">a</a> <a href="/missing">m</a></main>',
    "/a": '<title>Second</title><main><h1>Tide tables</h1><p>tide and time</p><a href="/">home</a></main>',
    "/robots.txt": "User-agent: *\nDisallow: /private/\nSitemap: {base}/map.xml",
    "/map.xml": "<urlset><loc>{base}/mapped</loc></urlset>", "/mapped": "<main><p>found by the map</p></main>",
}


@pytest.fixture()
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = PAGES.get(self.path)
            self.send_response(200 if body is not None else 404)
            self.send_header("Content-Type", "text/html" if "." not in self.path else "text/plain")
            self.end_headers()
            self.wfile.write((body or "").format(base=base).encode())

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    base = f"http://127.0.0.1:{s.server_port}"
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield base
    s.shutdown()


def test_command_line_crawls_and_searches(spark, server, tmp_path, capsys):
    out = f"{tmp_path}/corpus"
    args = [server + "/", "-o", out, "--allow-private-network", "--delay", "0ms", "--retries", "0", "--report", "json"]
    assert session.main(args, spark) == 0
    assert '"written": 3' in capsys.readouterr().out
    assert session.main(["search", out, "tide"], spark) == 0
    text = capsys.readouterr().out
    assert "Second" in text and "# Tide tables" in text and "Home" not in text
    assert session.main(["search", out, "tide, pool", "--mode=separate"], spark) == 0 and session.main(["search", f"{tmp_path}/none", "x"], spark) == 2
    assert session.main(args, spark) == 0  # nothing is left to do
    assert '"written": 3, "failed": 0' in capsys.readouterr().out.splitlines()[-1]
    assert session.main([*args, "--max-depth", "1"], spark) == 3 and "other options" in capsys.readouterr().err
    assert session.main(["--version"]) == 0 and session.main(["--what"]) == 2
    index = [r["value"] for r in spark.read.text(f"{out}/index").collect()]
    assert index[0] == "# Crawl index" and len(index) == 4 + 3
    assert spark.read.text(f"{out}/graph").count() == 3
    full = [r["value"] for r in spark.read.text(f"{out}/full").collect()]
    assert full[0] == f"# {server}/" and full[1] == f"url: {server}/" and full.count("---") >= 3


def test_a_run_that_ended_early_is_done_again_without_doubles(spark, tmp_path):
    import shutil

    rows = [(f"https://x.example{p}", 200, "text/html", f"<main>{p}<a href='/2'>2</a></main>", None, None) for p in ("/", "/2")]
    store = materialise(spark.createDataFrame(rows, STORE), "web")
    out = f"{tmp_path}/out"
    for _ in range(3):
        assert session.run_one(spark, store, "https://x.example/", Config(sitemap="off"), out).written == 2
        assert session.open_corpus(spark, out).count() == 2
        shutil.rmtree(f"{out}/frontier")


def test_live_retries_wait(spark):
    """With a clock, a page that failed is asked again only when its delay is over."""
    from pyspark.sql import functions as F

    from tidepool.operators.crawl import crawl

    asked = []

    def store(urls):
        wanted = [r["url"] for r in urls.collect()]
        page = "https://x.example/" in wanted
        if page:
            asked.append(time.time())
        status = None if page and len(asked) == 1 else 200 if page else 404
        return spark.createDataFrame([(u, "text/html", "<main>x</main>") for u in wanted], "url string, content_type string, body string").select(
            "url", F.lit(status).cast("int").alias("status"), "content_type", "body", F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("etag"))

    done = crawl(spark, store, "https://x.example/", Config(sitemap="off", batch_mode="exact"), clock=lambda: int(time.time() * 1000))
    assert len(asked) == 2 and asked[1] - asked[0] >= 0.4
    assert (done.written, done.failed) == (1, 1)


def test_folders_by_host_and_fresh_runs(spark, tmp_path):
    rows = [(f"https://{h}.example{p}", 200, "text/html", f"<main>{h}{p}</main>", None, None) for h in ("x", "y") for p in ("/", "/2")]
    store = materialise(spark.createDataFrame(rows, STORE), "web")
    urls = ["https://x.example/", "https://y.example/"]
    report = session.run(spark, store, urls, Config(output=f"{tmp_path}/out", sitemap="off"))
    assert report.where("url IS NULL").head()["written"] == 2
    assert session.open_corpus(spark, f"{tmp_path}/out/x.example").count() == 1
    again = session.run_one(spark, store, urls[0], Config(output="o", sitemap="off", fresh=True), f"{tmp_path}/out/x.example")
    assert again.written == 1


def test_versions_of_the_frontier(spark, tmp_path):
    rows = [(f"https://x.example{p}", 200, "text/html", f"<main>{p}<a href='/2'>2</a></main>", None, f"tag{p}") for p in ("/", "/2")]
    store = materialise(spark.createDataFrame(rows, STORE), "web")
    out, config = f"{tmp_path}/out", Config(sitemap="off")
    first = session.run_one(spark, store, "https://x.example/", config, out)
    kept = {r["canonical_url"]: (r["final_url"], r["status_code"], r["etag"]) for r in first.frontier.collect()}
    assert kept == {u: (u, 200, f"tag{u.removeprefix('https://x.example')}") for u in ("https://x.example/", "https://x.example/2")}
    old = materialise(spark.read.parquet(f"{out}/frontier/1").drop("etag", "last_modified"), "old")
    old.write.mode("overwrite").parquet(f"{out}/frontier/1")
    spark.createDataFrame([("0",)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/version")
    assert session.run_one(spark, store, "https://x.example/", config, out).written == 2
    assert "etag" in spark.read.parquet(f"{out}/frontier/2").columns and spark.read.text(f"{out}/version").head()[0] == str(session.STATE_VERSION)
    spark.createDataFrame([("99",)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/version")
    with pytest.raises(session.StateVersionError):
        session.run_one(spark, store, "https://x.example/", config, out)


def test_a_stopped_run_leaves_the_rest_pending_and_goes_on(spark, tmp_path):
    rows = [(f"https://x.example/{k or ''}", 200, "text/html", f"<main>{k}<a href='/{k + 1}'>next</a></main>", None, None) for k in range(4)]
    store = materialise(spark.createDataFrame(rows, STORE), "web")
    out, config, asked = f"{tmp_path}/out", Config(sitemap="off", max_depth=3), []
    early = session.run_one(spark, store, "https://x.example/", config, out, stop=lambda: asked.append(1) or len(asked) > 2)
    assert (early.written, early.pending, early.exit_code) == (2, 1, 1)
    late = session.run_one(spark, store, "https://x.example/", config, out)
    assert (late.written, late.pending, late.exit_code) == (4, 0, 0) and session.open_corpus(spark, out).count() == 4
