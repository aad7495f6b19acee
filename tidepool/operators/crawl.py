"""A crawl over a page store: breadth-first supersteps of set operations.

Each step leases a level (or a batch), joins it with the store, extracts, gates, and admits links. The driver holds the loop and counters only;
every step's tables are written to the shared folder, so plans don't grow and lost executors cost one step's work.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.config import Config
from tidepool.functions import html as page
from tidepool.functions import urls
from tidepool.operators import corpus as docs
from tidepool.operators import frontier as fr
from tidepool.operators import robots as rb
from tidepool.operators import sitemap as sm
from tidepool.operators.extract import extract_pages
from tidepool.operators.search import relevance
from tidepool.runtime import materialise
from tidepool.sources.stores import fetch_error, follow_redirects, lookup

CORPUS = "canonical_url string, depth int, final_url string, status_code int, title string, description string, markdown string, document string"


#: What the frontier keeps of a response.
RESPONSE = (("final_url", "string"), ("status_code", "int"), ("etag", "string"))


@dataclass
class Crawl:
    """frontier, corpus (pages written), manifest and errors as tables; the report's counters, and whether the page budget ended it."""

    start_url: str
    frontier: DataFrame
    corpus: DataFrame
    manifest: DataFrame
    errors: DataFrame
    written: int
    failed: int
    skipped: int
    pending: int
    changed: int
    unchanged: int
    truncated: bool

    @property
    def exit_code(self) -> int:
        return int(self.truncated or self.pending > 0 or (self.written == 0 and self.failed > 0))

    def row(self) -> tuple:
        return (self.start_url, self.written, self.failed, self.skipped, self.pending, self.changed, self.unchanged, self.truncated)


def crawl(spark: SparkSession, store, start_url: str, config: Config, *, now: int = 0, known: DataFrame | None = None, clock: Callable[[], int] | None = None, stop: Callable[[], bool] | None = None) -> Crawl:
    """Crawls a store (tidepool.sources.stores.STORE, or a function from URLs to it) from one URL.

    known: the frontier of a run to go on with. stop: asked before each step; once it says so, what is left stays pending.
    """
    config.validate()
    root = urls.canonicalize(start_url, keep_query=True, allow_private=config.allow_private_network)
    origin = f"{root.scheme}://{root.host}" + ("" if root.port == {"http": 80, "https": 443}[root.scheme] else f":{root.port}")
    found = spark.createDataFrame([(start_url, 0, None, None, "0")], "canonical_url string, depth int, parent_url string, discovery_source string, arrival string")
    robots_url = spark.createDataFrame([(f"{origin}/robots.txt",)], "url string")
    robots_row = lookup(store, robots_url).select(F.lit(origin).alias("origin"), F.lit(True).alias("there"), "status", "body")
    robots = spark.createDataFrame([(origin,)], "origin string").join(robots_row, "origin", "left")
    robots = robots.withColumn("status", F.when(F.col("there"), F.col("status")).otherwise(404)).drop("there")
    rules = materialise(robots.select("origin", "status").join(rb.parse(robots.select("origin", F.coalesce("body", F.lit("")).alias("body"))), "origin"), "robots")
    if config.sitemap != "off":
        listed = sm.load(sm.discover(robots.select("origin", F.when(F.col("status") == 200, F.col("body")).alias("body"))), lambda wanted: lookup(store, wanted).where("status BETWEEN 200 AND 299"))
        first = listed.groupBy("sitemap").agg(F.count("*").alias("n")).orderBy("sitemap").limit(1).select("sitemap")
        seeds = listed.join(first, "sitemap").select(F.col("url").alias("canonical_url"), F.lit(1).alias("depth"), F.lit(None).cast("string").alias("parent_url"), F.lit("sitemap").alias("discovery_source"), F.format_string("1:%010d", "position").alias("arrival"))
        found = found.unionByName(seeds)
    frontier = materialise(fr.admit(known if known is not None else fr.empty(spark), found, now)[0], "frontier")
    wanted = [q.lower().split() for q in config.for_queries]
    written: DataFrame | None = None
    errors: DataFrame | None = None
    n_failed = n_changed = 0
    limits = page.Limits(config.max_body_size, 2 << 20, 10_000)
    while not (stop and stop()):
        now = clock() if clock else now
        frontier = fr.recover_expired(frontier, now)
        if config.batch_mode == "exact":
            after, leases = fr.lease_batch(frontier, now, config.concurrency, config.lease_ms)
        else:
            if fr.ready(frontier, now).isEmpty():
                leases = None
            else:
                after, leases = fr.lease_level(frontier, now, config.lease_ms)
        if leases is None or (leases := materialise(leases, "leases")).isEmpty():
            later = fr.earliest_eligible(frontier).head()[0]
            if later <= now:
                break
            if clock:
                time.sleep(max(0, later - clock()) / 1000)
            now = later
            continue
        frontier = materialise(after, "frontier")
        done, n_bad, n_good = _step(spark, frontier, leases, store, rules, root, origin, config, wanted, limits, now)
        settled, _ = fr.settle(frontier, done["attempts"], now)
        settled, _ = fr.settle(settled, done["results"], now)
        frontier = materialise(fr.admit(materialise(settled, "frontier"), done["links"], now)[0], "frontier")
        written = done["written"] if written is None else written.unionByName(done["written"])
        errors = done["errors"] if errors is None else errors.unionByName(done["errors"])
        n_failed, n_changed = n_failed + n_bad, n_changed + n_good
        if frontier.count() >= config.max_pages:
            break
    c = fr.counts(frontier).head()
    corpus = written if written is not None else spark.createDataFrame([], CORPUS)
    pending = c["queued"] + c["delayed"] + c["leased"] + c["awaiting_output"]
    errors = errors if errors is not None else spark.createDataFrame([], docs.ERRORS)
    return Crawl(start_url, frontier, corpus, docs.manifest(corpus), errors, c["written"], n_failed, c["skipped"], pending, n_changed, 0, c["total"] >= config.max_pages)


def _step(spark, frontier, leases, store, rules, root, origin, config, wanted, limits, now) -> tuple[dict, int, int]:
    """What one step's leases come to: tables attempts, results, links, written, errors; failures and successful fetches."""
    keep = config.query_mode == "preserve"
    canonical = urls.canonical(F.col("canonical_url"), keep_query=keep, allow_private=config.allow_private_network)
    base = leases.withColumn("c", canonical).withColumn("path", urls.path_of(F.col("canonical_url"))).withColumn("origin", F.lit(origin))
    judged = rb.evaluate(base, rules, ignore=config.ignore_robots, mode=config.robots_mode)
    gate = F.when(F.col("c.error").isNotNull(), "invalid_url").when(F.col("robots") == "denied", "robots_denied").when(F.col("robots") == "fail_closed", "robots_fetch_failed")
    judged = materialise(judged.withColumn("gate", gate).select("canonical_url", "depth", "attempts", "lease_token", "gate"), "judged")
    asked = judged.where("gate IS NULL")
    got = follow_redirects(asked.select(F.col("canonical_url").alias("url")), store).withColumnRenamed("url", "canonical_url")
    why = F.coalesce("redirect_error", fetch_error(F.col("status"), F.col("content_type"), F.col("body"), config.max_body_size), F.when(~F.col("utf8"), "not_html"))
    got = asked.join(got, "canonical_url").withColumn("why", why)
    fetched = materialise(got, "fetched")
    pages = extract_pages(fetched.where("why IS NULL").select("canonical_url", "final_url", "body"), key="canonical_url", base="final_url", html="body", limits=limits)
    fit = relevance(F.coalesce("title", F.lit("")), F.coalesce("markdown", F.lit("")), wanted) if wanted else F.lit(1).cast("bigint")
    pages = pages.withColumn("fit", F.when(F.col("extract_error").isNull(), fit))
    pages = materialise(fetched.where("why IS NULL").select("canonical_url", "depth", "final_url", F.col("status").alias("status_code"), "attempts", "lease_token", "etag").join(pages, "canonical_url"), "pages")
    ok = pages.where("extract_error IS NULL AND fit > 0")
    written = ok.select("canonical_url", "depth", "final_url", "status_code", "title", "description", "markdown", docs.build_document(F.col("canonical_url"), F.col("final_url"), F.col("title"), F.col("markdown")).alias("document"))

    again = fr.retryable(F.col("status")) | (F.col("why") == "network")
    again = F.coalesce(again, F.lit(False)) & (F.col("attempts") < config.retries)
    text = lambda c: F.lit(c).cast("string")
    one = lambda d, kind, error, until=F.lit(None).cast("bigint"): d.select("canonical_url", "lease_token", F.lit(kind).alias("outcome"), error.alias("error"), until.alias("next_eligible_at"), *[F.col(c) if "etag" in d.columns else F.lit(None).cast(t).alias(c) for c, t in RESPONSE])
    bad = fetched.where("why IS NOT NULL").withColumn("again", again).drop("final_url", "etag")
    results = one(judged.where("gate = 'robots_denied'"), "skipped", text("robots_denied"))
    for part in (
        one(judged.where("gate IN ('invalid_url', 'robots_fetch_failed')"), "terminal_error", F.col("gate")),
        one(bad.where("again"), "retry", F.col("why"), F.lit(now).cast("bigint") + fr.backoff_ms(F.col("attempts"))),
        one(bad.where("NOT again"), "terminal_error", F.when(F.col("why") == "not_html", "not_html").otherwise("fetch_failed")),
        one(pages.where("extract_error IS NOT NULL"), "terminal_error", text("extract_failed")),
        one(ok, "written", text(None)),
        # a page pruned for its relevance stays leased
        *([] if config.for_prune else [one(pages.where("extract_error IS NULL AND fit = 0"), "skipped", text("irrelevant"))]),
    ):
        results = results.unionByName(part)
    results = materialise(results, "results")
    failed = results.where("outcome = 'terminal_error'").select("canonical_url", "error").join(leases.select("canonical_url", "depth", "attempts"), "canonical_url")
    errors = failed.select(F.sha2(F.col("canonical_url").cast("binary"), 256).alias("page_id"), "canonical_url", "depth", (F.col("attempts") + 1).cast("int").alias("attempts"), F.col("error").alias("error_kind"), "error")

    source = pages.where("extract_error IS NULL" + (" AND fit > 0" if config.for_prune else "")).where(F.col("depth") + 1 <= config.max_depth)
    edges = source.select(F.col("canonical_url").alias("parent_url"), (F.col("depth") + 1).cast("int").alias("depth"), F.posexplode("links").alias("i", "href"))
    edges = edges.withColumn("c", urls.canonical(F.col("href"), keep_query=keep, allow_private=config.allow_private_network)).where("c.error IS NULL")
    edges = edges.where(urls.in_scope(F.col("c"), root.scheme, root.host, root.port, config.include_subdomains) & urls.path_allowed(urls.path_of(F.col("c.url")), config.include, config.exclude))
    links = edges.select(F.col("c.url").alias("canonical_url"), "depth", "parent_url", F.lit("link").alias("discovery_source"), F.concat_ws(" ", "parent_url", F.format_string("%010d", "i")).alias("arrival"))
    counts = results.agg(F.count_if(F.col("outcome").isin("terminal_error", "retry")).alias("bad")).head()
    attempts = one(asked, "attempt", text(None))
    return {"attempts": attempts, "results": results, "links": links, "written": written, "errors": errors}, counts["bad"], fetched.where("why IS NULL").count()
