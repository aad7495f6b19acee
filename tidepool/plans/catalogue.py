"""Every registered query of the engine, with its DuckDB counterpart where SQL can express it.

Where the tables hold no input of a kind (robots files, frontiers, sitemaps), a query derives it from whole tables by plain expressions, and the
SQL derives it again by its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import addresses, text, urls
from tidepool.operators import bfs, corpus, derive, extract, frontier, robots, search, sitemap
from tidepool.runtime import ensure_workers, materialise, table
from tidepool.sources import stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_workers(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- URLs

_ORIGIN_SQL = r"""SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
  CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END AS port,
  regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*([?][^#]*)?', 1) AS query FROM pages"""
_CANON_SQL = f"SELECT *, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END AS canonical FROM ({_ORIGIN_SQL})"


def _canonical(spark: SparkSession, sf_dir: str, keep_query: bool = False) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.canonical(F.col("url"), keep_query=keep_query).alias("c"))


@query(f"SELECT page_id, canonical, scheme, host, port, CAST(NULL AS VARCHAR) AS error FROM ({_CANON_SQL})")
def url_canonicalize(spark, sf_dir):
    return _canonical(spark, sf_dir).select("page_id", F.col("c.url").alias("canonical"), "c.scheme", "c.host", "c.port", "c.error")


@query(f"SELECT page_id, canonical || query AS canonical FROM ({_CANON_SQL})")
def url_canonicalize_preserve(spark, sf_dir):
    return _canonical(spark, sf_dir, True).select("page_id", F.col("c.url").alias("canonical"))


@query(f"SELECT page_id, sha256(canonical) AS sha, 'pages/' || sha256(canonical) || '.md' AS output_path FROM ({_CANON_SQL})")
def url_page_id(spark, sf_dir):
    return _canonical(spark, sf_dir).select("page_id", urls.page_id(F.col("c.url")).alias("sha"), urls.output_path(F.col("c.url")).alias("output_path"))


@query(f"SELECT scheme, host, port, CAST(count(*) AS BIGINT) AS pages FROM ({_ORIGIN_SQL}) GROUP BY ALL")
def url_origin(spark, sf_dir):
    return _canonical(spark, sf_dir).groupBy("c.scheme", "c.host", "c.port").agg(F.count("*").alias("pages"))


@query(f"SELECT page_id, scheme = 'https' AND host = 'ththan.example.net' AS in_scope FROM ({_ORIGIN_SQL})")
def url_scope_exact(spark, sf_dir):
    return _canonical(spark, sf_dir).select("page_id", urls.in_scope(F.col("c"), "https", "ththan.example.net", 443).alias("in_scope"))


@query(f"SELECT page_id, scheme = 'https' AND (host = 'example.com' OR host LIKE '%.example.com') AS in_scope FROM ({_ORIGIN_SQL})")
def url_scope_subdomain(spark, sf_dir):
    return _canonical(spark, sf_dir).select("page_id", urls.in_scope(F.col("c"), "https", "example.com", 443, subdomains=True).alias("in_scope"))


#: A prefix, what stands between it and the host, what follows, and the kind of error.
BAD = [
    ("https://", "", "/ok", None), ("ftp://", "", "/x", "unsupported_scheme"), ("https://", "user@", "/x", "userinfo"), ("https://", "@", "/x", "userinfo"),
    ("https:///", "", "/x", "missing_host"), ("https://", "", "/a b", "whitespace"), ("https://", "", "/a%2fb", "encoded_separator"), ("https://", "", "/a%5Cb", "encoded_separator"),
    ("https://", "", "/%2e%2e/secret", "encoded_traversal"), ("https://", "", "/a/%2e./b", "encoded_traversal"), ("https://", "", "/a\\b", "backslash"), ("https://", "", "/%zz", "invalid_url"),
    ("https://", "", "/a%2", "invalid_url"), ("https://", "", "/a%00b", "encoded_traversal"), ("https://127.1/", "", "", "unsafe_address"), ("https://0x7f000001/", "", "", "unsafe_address"),
    ("https://localhost/", "", "", "unsafe_address"), ("https://printer.local/", "", "", "unsafe_address"), ("https://", "", "/café", None), ("HTTPS://", "", "/A/../b/./c", None),
]


_MADE_SQL = f"""SELECT page_id, ([{', '.join(repr(b[0] + b[1]) for b in BAD)}])[k] || regexp_extract(url, '^https?://([^/?#]+)', 1) || ([{', '.join("'" + b[2] + "'" for b in BAD)}])[k] AS made
FROM (SELECT page_id, url, CAST(page_id % {len(BAD)} AS INTEGER) + 1 AS k FROM pages)"""


@query(
    rf"""WITH parts AS (SELECT page_id, made, lower(regexp_extract(made, '^([A-Za-z]+):', 1)) AS scheme, regexp_extract(made, '://([^/?#]*)', 1) AS authority, regexp_extract(made, '://[^/]*(/[^?#]*)', 1) AS path
FROM ({_MADE_SQL})), hosts AS (SELECT *, lower(regexp_replace(authority, ':[0-9]*$', '')) AS host FROM parts)
SELECT page_id, CASE
  WHEN regexp_matches(made, '\s') THEN 'whitespace' WHEN contains(made, chr(92)) THEN 'backslash' WHEN regexp_matches(made, '^[^:]*:///') THEN 'missing_host'
  WHEN regexp_matches(regexp_replace(path, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%') THEN 'invalid_url' WHEN regexp_matches(path, '%(2[fF]|5[cC])') THEN 'encoded_separator'
  WHEN regexp_matches(path, '%([01][0-9A-Fa-f]|7[fF])') OR regexp_matches(path, '/([.]%2[eE]|%2[eE][.]?|%2[eE]%2[eE])(/|$)') THEN 'encoded_traversal'
  WHEN scheme NOT IN ('http', 'https') THEN 'unsupported_scheme' WHEN contains(authority, '@') THEN 'userinfo'
  WHEN host = 'localhost' OR ends_with(host, '.localhost') OR host = 'local' OR ends_with(host, '.local') OR regexp_matches(host, '^(127[.][0-9.]+|0x7f[0-9a-f]{{6}})$') THEN 'unsafe_address' END AS error
FROM hosts"""
)
def url_reject_reason(spark, sf_dir):
    k = F.pmod("page_id", F.lit(len(BAD))).cast("int")
    part = lambda i: F.get(F.array(*[F.lit(b[i]) for b in BAD]), k)
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    made = table(spark, sf_dir, "pages").select("page_id", F.concat(part(0), part(1), host, part(2)).alias("made"))
    return made.select("page_id", urls.canonical(F.col("made"))["error"].alias("error"))


@query(f"SELECT page_id, replace(host, ':', '_') AS slug FROM ({_ORIGIN_SQL})")
def host_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.host_slug(F.col("url")).alias("slug"))


@query(rf"SELECT page_id, regexp_full_match(path, '/(en|fr)/.*') AND NOT (path LIKE '%.html' OR regexp_full_match(path, '/en/9..')) AS allowed FROM ({_ORIGIN_SQL})")
def glob_include_exclude(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.path_allowed(urls.path_of(F.col("url")), ["/{en,fr}/*"], ["*.html", "/en/9??"]).alias("allowed"))


_V4_SQL = "SELECT c_custkey, CAST((c_custkey * 2654435761) % 4294967296 AS BIGINT) AS n FROM customer"


def _v4_case() -> str:
    parts = [f"WHEN n BETWEEN {lo} AND {hi} THEN '{r}'" for (lo, hi), r in ((addresses._bounds(net), r) for net, r in addresses.V4)]
    return "CASE " + " ".join(parts) + " ELSE 'public' END"


@query(f"SELECT c_custkey, concat_ws('.', n // 16777216, n // 65536 % 256, n // 256 % 256, n % 256) AS address, {_v4_case()} AS reason FROM ({_V4_SQL})")
def ip_classify_v4(spark, sf_dir):
    n = (F.col("c_custkey") * F.lit(2654435761)) % F.lit(4294967296)
    address = F.concat_ws(".", *[(F.floor(n / F.lit(256**k)) % 256).cast("bigint").cast("string") for k in (3, 2, 1, 0)])
    return table(spark, sf_dir, "customer").select("c_custkey", address.alias("address")).withColumn("reason", addresses.classify_v4(F.col("address")))


_V6_HEADS = ["00000000000000000000", "0000000000000000000000000000000000", "01000000000000000000", "2001000000", "20010001", "200100020000", "20010db8", "2002", "3ffe", "3fff0", "0064ff9b0000000000000000", "fc", "fec", "fe8", "ff", "2606", "00000000000000000000ffff", "2001001", "2001002", "2001000401120000"]


def _v6_case() -> str:
    low = "CAST('0x' || substr(d, 25, 8) AS BIGINT)"
    v4 = [f"WHEN left(d, 24) IN ('{'0' * 24}', '{'0' * 20}ffff') AND {low} BETWEEN {lo} AND {hi} THEN '{r}'" for (lo, hi), r in ((addresses._bounds(net), r) for net, r in addresses.V4)]
    v6 = [f"WHEN d BETWEEN '{lo:032x}' AND '{hi:032x}' THEN '{r}'" for (lo, hi), r in ((addresses._bounds(net), r) for net, r in addresses.V6)]
    return "CASE " + " ".join(v4) + f" WHEN left(d, 24) IN ('{'0' * 24}', '{'0' * 20}ffff') THEN 'public' " + " ".join(v6) + " ELSE 'public' END"


@query(
    f"SELECT c_custkey, d AS digits, {_v6_case()} AS reason FROM (SELECT c_custkey, left(([{', '.join(repr(h) for h in _V6_HEADS)}])[CAST(c_custkey % {len(_V6_HEADS)} AS INTEGER) + 1] || sha256(CAST(c_custkey AS VARCHAR)), 32) AS d FROM customer)"
)
def ip_classify_v6(spark, sf_dir):
    head = F.get(F.array(*[F.lit(h) for h in _V6_HEADS]), F.pmod("c_custkey", F.lit(len(_V6_HEADS))).cast("int"))
    digits = F.substring(F.concat(head, F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256)), 1, 32)
    return table(spark, sf_dir, "customer").select("c_custkey", digits.alias("digits")).withColumn("reason", addresses.classify_v6_hex(F.col("digits")))


# -- the frontier


@query("""
SELECT canonical_url, CAST(depth AS INTEGER) AS depth, parent_url, 'queued' AS state FROM (
  SELECT 'https://h.example/' || o_custkey AS canonical_url, o_orderkey % 7 AS depth, 'https://h.example/from/' || o_orderkey AS parent_url,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7, o_orderkey) AS k FROM orders) WHERE k = 1
""")
def frontier_admit_min_depth(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("https://h.example/"), "o_custkey").alias("canonical_url"), (F.col("o_orderkey") % 7).cast("int").alias("depth"), F.concat(F.lit("https://h.example/from/"), "o_orderkey").alias("parent_url"),
        F.lit("link").alias("discovery_source"), F.col("o_orderkey").alias("arrival"),
    )
    return frontier.admit(frontier.empty(spark), found, 1)[0].select("canonical_url", "depth", "parent_url", "state")


def _frontier(spark, sf_dir) -> DataFrame:
    """A frontier in many states, made of the customers."""
    k = F.col("c_custkey")
    leased = k % 4 == 2
    made = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("https://h.example/"), k).alias("canonical_url"), F.col("c_nationkey").cast("int").alias("depth"), F.lit(None).cast("string").alias("parent_url"), F.lit("link").alias("discovery_source"),
        F.get(F.array(*[F.lit(s) for s in ("queued", "delayed", "leased", "written")]), (k % 4).cast("int")).alias("state"), (k % 10).cast("int").alias("attempts"), (k * 37 % 1000).alias("next_eligible_at"),
        F.when(leased, F.concat(F.lit("t"), k)).alias("lease_token"), F.when(leased, k * 53 % 1000).alias("lease_expires_at"),
    )
    return frontier.empty(spark).unionByName(made, allowMissingColumns=True)


_FRONTIER_SQL = """SELECT 'https://h.example/' || c_custkey AS canonical_url, c_nationkey AS depth, (['queued', 'delayed', 'leased', 'written'])[CAST(c_custkey % 4 AS INTEGER) + 1] AS state,
  CAST(c_custkey % 10 AS INTEGER) AS attempts, c_custkey * 37 % 1000 AS next_eligible_at, CASE WHEN c_custkey % 4 = 2 THEN 't' || c_custkey END AS lease_token,
  CASE WHEN c_custkey % 4 = 2 THEN c_custkey * 53 % 1000 END AS lease_expires_at, c_custkey FROM customer"""


@query(f"""
SELECT canonical_url, depth, attempts, sha256(concat_ws('|', canonical_url, 500, attempts)) AS lease_token, CAST(750 AS BIGINT) AS lease_expires_at
FROM ({_FRONTIER_SQL}) WHERE state IN ('queued', 'delayed') AND next_eligible_at <= 500 ORDER BY depth, canonical_url LIMIT 25
""")
def frontier_lease_topk(spark, sf_dir):
    return frontier.lease_batch(_frontier(spark, sf_dir), 500, 25, 250)[1]


@query(f"SELECT canonical_url, attempts, CAST(500 * power(2, least(attempts, 6)) AS BIGINT) AS backoff_ms FROM ({_FRONTIER_SQL})")
def frontier_retry_backoff(spark, sf_dir):
    return _frontier(spark, sf_dir).select("canonical_url", "attempts", frontier.backoff_ms(F.col("attempts")).alias("backoff_ms"))


@query(f"""
SELECT canonical_url, CASE WHEN x THEN 'queued' ELSE state END AS state, CASE WHEN x THEN least(next_eligible_at, 400) ELSE next_eligible_at END AS next_eligible_at,
  CASE WHEN NOT x THEN lease_token END AS lease_token FROM (SELECT *, coalesce(state = 'leased' AND lease_expires_at <= 400, false) AS x FROM ({_FRONTIER_SQL}))
""")
def frontier_recover_expired(spark, sf_dir):
    return frontier.recover_expired(_frontier(spark, sf_dir), 400).select("canonical_url", "state", "next_eligible_at", "lease_token")


_OUTCOMES = ["attempt", "retry", "awaiting_output", "written", "skipped", "terminal_error"]


@query(f"""
SELECT canonical_url, CASE WHEN NOT ok OR kind = 'attempt' THEN state WHEN kind = 'retry' THEN 'delayed' ELSE kind END AS state,
  CAST(CASE WHEN ok AND kind = 'attempt' THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts,
  CASE WHEN ok AND kind = 'retry' THEN 9000 ELSE next_eligible_at END AS next_eligible_at,
  CASE WHEN ok AND kind IN ('retry', 'skipped', 'terminal_error') THEN 'why' END AS error,
  CASE WHEN ok AND kind <> 'attempt' THEN NULL ELSE lease_token END AS lease_token
FROM (SELECT *, CASE WHEN kind = 'skipped' THEN state <> 'written' ELSE state = 'leased' AND lease_expires_at > 300 AND c_custkey % 5 > 0 END AS ok
      FROM (SELECT *, ([{", ".join(repr(o) for o in _OUTCOMES)}])[CAST(c_custkey // 4 % 6 AS INTEGER) + 1] AS kind FROM ({_FRONTIER_SQL})))
""")
def frontier_settle(spark, sf_dir):
    """One result for every row; those of every fifth customer bear a stale token."""
    k = F.col("c_custkey")
    results = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("https://h.example/"), k).alias("canonical_url"), F.when(k % 5 > 0, F.concat(F.lit("t"), k)).otherwise("stale").alias("lease_token"),
        F.get(F.array(*[F.lit(o) for o in _OUTCOMES]), (F.floor(k / 4) % 6).cast("int")).alias("outcome"), F.lit("why").alias("error"), F.lit(9000).cast("bigint").alias("next_eligible_at"),
    )
    return frontier.settle(_frontier(spark, sf_dir), results, 300)[0].select("canonical_url", "state", "attempts", "next_eligible_at", "error", "lease_token")


@query(
    "SELECT CAST(count(*) AS BIGINT) AS total, " + ", ".join(f"CAST(count(*) FILTER (state = '{s}') AS BIGINT) AS {s}" for s in frontier.STATES) + f" FROM ({_FRONTIER_SQL})"
)
def frontier_counts_pivot(spark, sf_dir):
    return frontier.counts(_frontier(spark, sf_dir))


@query(f"SELECT CAST(coalesce(min(next_eligible_at), 0) AS BIGINT) AS earliest FROM ({_FRONTIER_SQL}) WHERE state = 'delayed'")
def frontier_earliest_eligible(spark, sf_dir):
    return frontier.earliest_eligible(_frontier(spark, sf_dir))


@query("SELECT o_orderkey, s AS status, s IN (408, 425, 429) OR s BETWEEN 500 AND 599 AS retryable FROM (SELECT o_orderkey, CAST(200 + o_orderkey % 420 AS INTEGER) AS s FROM orders)")
def status_retryable(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.lit(200) + F.col("o_orderkey") % 420).cast("int").alias("status")).withColumn("retryable", frontier.retryable(F.col("status")))


@query("""
WITH RECURSIVE e AS (SELECT doc_id AS src, (doc_id * 2 + 1) % (SELECT count(*) FROM documents) AS dst FROM documents
                     UNION SELECT doc_id, (doc_id * 3 + 2) % (SELECT count(*) FROM documents) FROM documents),
r(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 6)
SELECT node, min(depth) AS depth FROM r GROUP BY node
""")
def bfs_depth(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = F.lit(docs.count())
    edges = docs.select(F.col("doc_id").alias("src"), ((F.col("doc_id") * 2 + 1) % n).alias("dst")).unionByName(docs.select(F.col("doc_id").alias("src"), ((F.col("doc_id") * 3 + 2) % n).alias("dst")))
    return bfs.depths(edges, spark.createDataFrame([(0,)], "node bigint"), 6)


# -- robots and sitemaps

#: The rules that hold for us in the file below, in its order.
RULES = [(True, "/en/1"), (False, "/en/"), (True, "/en/25"), (False, "/fr/8"), (True, "/fr/"), (True, "/fr/85"), (False, "/es/5"), (False, "/es/"), (True, "/es/53"), (False, "/de/7")]
ROBOTS_TEXT = (
    "# a file\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /en/1 # first\nDisallow: /en/*\nALLOW : /en/25\nCrawl-delay: 2\nDisallow:\n"
    "User-agent: another\nDisallow: /never\nUser-Agent: TidePool\nDisallow: /fr/8\nAllow: /fr/\r\nAllow: /fr/85\nDisallow: /es/5\nDisallow: /es/\nAllow: /es/53\nDisallow: /de/7\nCrawl-delay: 7.5\nSitemap: https://x.example/s.xml\nno colon here\n"
)
_RULES_SQL = "(VALUES " + ", ".join(f"({i}, {str(a).lower()}, '{p}')" for i, (a, p) in enumerate(RULES)) + ") AS r(pos, allow, pattern)"


def _robots(spark, sf_dir) -> DataFrame:
    """The file at every nation's origin."""
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("https://n"), "n_nationkey", F.lit(".example")).alias("origin"), F.lit(ROBOTS_TEXT).alias("body"))


@query(f"SELECT 'https://n' || n_nationkey || '.example' AS origin, CAST(pos AS INTEGER) AS pos, allow, pattern, CAST(7.5 AS DOUBLE) AS crawl_delay FROM nation, {_RULES_SQL}")
def robots_parse(spark, sf_dir):
    parsed = robots.parse(_robots(spark, sf_dir)).select("origin", "crawl_delay", F.posexplode("rules").alias("pos", "r"))
    return parsed.select("origin", "pos", "r.allow", "r.pattern", "crawl_delay")


_MATCH_SQL = f"SELECT page_id, pos, allow, strlen(pattern) AS n FROM ({_ORIGIN_SQL}) JOIN {_RULES_SQL} ON starts_with(path, rtrim(pattern, '*'))"


def _allows(spark, sf_dir, mode: str) -> DataFrame:
    own = F.array(*[F.struct(F.lit(a).alias("allow"), F.lit(p).alias("pattern")) for a, p in RULES])
    return table(spark, sf_dir, "pages").select("page_id", robots.allowed(own, urls.path_of(F.col("url")), mode).alias("allowed"))


@query(f"""
WITH m AS ({_MATCH_SQL}), f AS (SELECT page_id, arg_min(allow, pos) AS first_allow, arg_min(n, pos) AS first_n FROM m GROUP BY page_id)
SELECT p.page_id, coalesce(first_allow OR EXISTS (SELECT 1 FROM m WHERE m.page_id = p.page_id AND m.allow AND m.n >= f.first_n), true) AS allowed FROM pages p LEFT JOIN f USING (page_id)
""")
def robots_allows_reference(spark, sf_dir):
    return _allows(spark, sf_dir, "ordered")


@query(f"SELECT p.page_id, coalesce(m.allow, true) AS allowed FROM pages p LEFT JOIN (SELECT page_id, arg_max(allow, n * 2 + CASE WHEN allow THEN 1 ELSE 0 END) AS allow FROM ({_MATCH_SQL}) GROUP BY page_id) m USING (page_id)")
def robots_allows_rfc9309(spark, sf_dir):
    return _allows(spark, sf_dir, "rfc9309")


@query(f"""
SELECT p.page_id, CASE WHEN s BETWEEN 400 AND 499 AND s NOT IN (401, 403) THEN 'no_rules' WHEN s NOT BETWEEN 200 AND 299 THEN 'fail_closed'
  WHEN coalesce(m.allow, true) THEN 'allowed' ELSE 'denied' END AS outcome
FROM (SELECT page_id, ([200, 404, 401, 503, 429])[CAST(page_id % 5 AS INTEGER) + 1] AS s FROM pages) p
LEFT JOIN (SELECT page_id, arg_max(allow, n * 2 + CASE WHEN allow THEN 1 ELSE 0 END) AS allow FROM ({_MATCH_SQL}) GROUP BY page_id) m USING (page_id)
""")
def robots_outcome(spark, sf_dir):
    status = F.get(F.array(*[F.lit(s) for s in (200, 404, 401, 503, 429)]), F.pmod("page_id", F.lit(5)).cast("int"))
    own = F.array(*[F.struct(F.lit(a).alias("allow"), F.lit(p).alias("pattern")) for a, p in RULES])
    return table(spark, sf_dir, "pages").select("page_id", robots.outcome(status, own, urls.path_of(F.col("url")), mode="rfc9309").alias("outcome"))


def _sitemaps(spark, sf_dir) -> DataFrame:
    """A sitemap of each origin's pages."""
    origin = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    own = table(spark, sf_dir, "pages").groupBy(origin.alias("origin")).agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("ps"))
    body = F.concat(F.lit("<urlset>"), F.array_join(F.transform("ps", lambda p: F.concat(F.lit("<url><loc>\n "), p["url"], F.lit(" </loc></url>"))), ""), F.lit("<url><loc> </loc></url></urlset>"))
    return own.select("origin", F.concat("origin", F.lit("/sitemap.xml")).alias("sitemap"), body.alias("body"))


_SITEMAP_SQL = "SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, CAST(row_number() OVER (PARTITION BY regexp_extract(url, '^(https?://[^/?#]+)', 1) ORDER BY page_id) - 1 AS INTEGER) AS position, url FROM pages"


@query(_SITEMAP_SQL)
def sitemap_loc(spark, sf_dir):
    return _sitemaps(spark, sf_dir).select("origin", F.posexplode(sitemap.locations(F.col("body"))).alias("position", "url"))


@query(f"SELECT origin, origin || '/index.xml' AS sitemap, position, url FROM ({_SITEMAP_SQL})")
def sitemap_index_expand(spark, sf_dir):
    """An index at each origin that names its sitemap, one that isn't there, and one of another origin."""
    maps = _sitemaps(spark, sf_dir)
    index = maps.select("origin", F.concat("origin", F.lit("/index.xml")).alias("url"), F.concat(F.lit("<sitemapindex><loc>"), "sitemap", F.lit("</loc><loc>"), "origin", F.lit("/none.xml</loc><loc>https://else.example/s.xml</loc></sitemapindex>")).alias("body"))
    store = index.select("url", "body").unionByName(maps.select(F.col("sitemap").alias("url"), "body"))
    return sitemap.load(index.select("origin", F.col("url").alias("sitemap")), store).select("origin", "sitemap", F.col("position").cast("int").alias("position"), "url")


@query("SELECT 'https://n' || n_nationkey || '.example' AS origin, CAST(i AS INTEGER) AS position, CASE i WHEN 0 THEN 'https://x.example/s.xml' ELSE 'https://n' || n_nationkey || '.example/sitemap.xml' END AS sitemap FROM nation, (VALUES (0), (1)) v(i)")
def sitemap_discover(spark, sf_dir):
    return sitemap.discover(_robots(spark, sf_dir))


# -- pages and text


@query("""SELECT page_id, CAST(i - 1 AS INTEGER) AS position, l[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)""")
def raw_anchor_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("position", "href"))


def _decoded_sql(text: str) -> str:
    for entity, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", chr(39) * 2), ("#39", chr(39) * 2), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"replace({text}, '&{entity};', '{sign}')"
    return text


_TITLE_SQL = _decoded_sql("regexp_extract(html, '<title>([^<]*)</title>', 1)")


@query(rf"SELECT page_id, trim(regexp_replace({_TITLE_SQL}, '\s+', ' ', 'g')) AS title FROM pages")
def page_title(spark, sf_dir):
    return extract.extract_pages(table(spark, sf_dir, "pages"), key="page_id", base="url").select("page_id", "title")


_ARTICLE_SQL = _decoded_sql(r"regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?b>|<!--.*?-->', '', 'gs'), '<[^>]*>', ' ', 'g')")


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace({_ARTICLE_SQL}, '[*#_`\[\]\\]', '', 'g'), '\s+', ' ', 'g')) AS words FROM pages")
def page_text(spark, sf_dir):
    """What the extractor's Markdown says, without its marks."""
    done = extract.extract_pages(table(spark, sf_dir, "pages"), key="page_id", base="url")
    return done.select("page_id", F.trim(F.regexp_replace(F.regexp_replace("markdown", r"[*#_`\[\]\\]", ""), r"\s+", " ")).alias("words"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed FROM documents")
def collapse_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse_whitespace(F.col("text")).alias("collapsed"))


@query(r"SELECT doc_id, trim('Alert ' || regexp_replace(text, '\s+', ' ', 'g')) || ' end' AS clean FROM documents")
def sanitize_metadata(spark, sf_dir):
    raw = F.concat(F.lit("\x1b[31mAlert\x1b[0m\n\x07 \x1b]0;title\x07"), "text", F.lit("\x1bM� \r\x00end�\t"))
    return table(spark, sf_dir, "documents").select("doc_id", text.sanitize_metadata(raw).alias("clean"))


def _cut_sql(source: str) -> str:
    cut = f"left({source}, CAST(list_max(list_filter(range(0, 151), lambda n: strlen(left({source}, CAST(n AS INTEGER))) <= 150)) AS INTEGER))"
    return f"""CASE WHEN strlen({source}) <= 150 THEN {source} ELSE (SELECT CASE WHEN contains(c, ' ') AND strlen(regexp_extract(c, '^(?s:(.*)) ', 1)) > strlen(c) // 2 THEN regexp_extract(c, '^(?s:(.*)) ', 1) ELSE c END FROM (SELECT {cut} AS c)) || '…' END"""


_FLAT_SQL = r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents"


@query(f"SELECT doc_id, {_cut_sql('flat')} AS summary FROM ({_FLAT_SQL})")
def truncate_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_summary(text.collapse_whitespace(F.col("text")), 150).alias("summary"))


_PARAGRAPH_SQL = r"coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\r')), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|!\[|\[|\||```|---)'))[1], '')"


@query(f"SELECT doc_id, {_PARAGRAPH_SQL} AS paragraph FROM documents")
def first_paragraph(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_paragraph(F.col("text")).alias("paragraph"))


# -- a corpus made of the documents

_TITLE_SQL = """left(replace(text, chr(10), ' '), 40)"""
_DOCUMENT_SQL = f"""'---' || chr(10) || 'url: ' || url || chr(10) || 'final_url: ' || url || chr(10) || 'title: "' || replace(replace({_TITLE_SQL}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' || chr(10) || '---' || chr(10) || chr(10) || text || CASE WHEN ends_with(text, chr(10)) THEN '' ELSE chr(10) END"""
_CORPUS_SQL = f"SELECT doc_id, url AS canonical_url, CAST(doc_id % 4 AS INTEGER) AS depth, 'pages/' || sha256(url) || '.md' AS output_path, {_DOCUMENT_SQL} AS document, {_TITLE_SQL} AS title, text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_cut_sql('para')} END AS description FROM (SELECT *, 'https://docs.example/' || doc_id AS url, {_PARAGRAPH_SQL} AS para FROM documents)"


def _corpus(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://docs.example/"), "doc_id")
    title = F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 40)
    described = F.when(F.col("doc_id") % 3 == 0, "").otherwise(text.truncate_summary(text.first_paragraph(F.col("text")), 150))
    return docs.select(
        "doc_id", url.alias("canonical_url"), (F.col("doc_id") % 4).cast("int").alias("depth"), url.alias("final_url"), F.lit(200).alias("status_code"), urls.output_path(url).alias("output_path"),
        corpus.build_document(url, url, title, F.col("text")).alias("document"), title.alias("title"), "text", described.alias("description"),
    )


@query(f"SELECT doc_id, document FROM ({_CORPUS_SQL})")
def build_document(spark, sf_dir):
    return _corpus(spark, sf_dir).select("doc_id", "document")


@query(f"SELECT sha256(canonical_url) AS page_id, canonical_url, depth, output_path, CAST(strlen(document) AS BIGINT) AS bytes, sha256(document) AS digest, description FROM ({_CORPUS_SQL})")
def manifest_digest(spark, sf_dir):
    return corpus.manifest(_corpus(spark, sf_dir)).drop("final_url", "status_code")


@query(f"SELECT doc_id, ([ 'new', 'duplicate', 'conflict'])[CAST(doc_id % 3 AS INTEGER) + 1] AS commit, doc_id % 5 > 0 AS verified FROM ({_CORPUS_SQL})")
def commit_classify(spark, sf_dir):
    """Every third page is new, every third as it was, every third has changed; every fifth has a wrong digest."""
    pages = _corpus(spark, sf_dir).select("canonical_url", "depth", "final_url", "status_code", "output_path", "document", "description", "doc_id")
    made = corpus.manifest(pages)
    old = made.join(pages.select("canonical_url", "doc_id"), "canonical_url").where("doc_id % 3 > 0").withColumn("bytes", F.when(F.col("doc_id") % 3 == 2, F.col("bytes") + 1).otherwise(F.col("bytes")))
    kinds = corpus.classify_commit(made, old.select(*made.columns)).select("canonical_url", "commit")
    wrong = made.join(pages.select("canonical_url", "doc_id"), "canonical_url").withColumn("digest", F.when(F.col("doc_id") % 5 == 0, "0").otherwise(F.col("digest")))
    return corpus.verified(wrong, pages.select("canonical_url", "document")).select("doc_id", "canonical_url", "verified").join(kinds, "canonical_url").select("doc_id", "commit", "verified")


@query("SELECT sha256(text) AS digest, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    same = table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return same.where("copies > 1")


_LINKED_SQL = """SELECT 'https://docs.example/' || doc_id AS url, '[a](https://docs.example/' || (doc_id * 7 % 500) || '#part) ' || text || ' [b](https://docs.example/' || (doc_id * 3 % 900) || ') ![i](img.png) [c](https://else.example/) [d](https://docs.example/1 "t") [e](broken' AS document FROM documents"""


@query(f"""
WITH d AS ({_LINKED_SQL}), c AS (SELECT url, unnest(string_split(document, '](')[2:]) AS chunk FROM d),
t AS (SELECT url, string_split(chunk, ')')[1] AS target FROM c WHERE contains(chunk, ')') AND starts_with(chunk, 'http')),
o AS (SELECT url, count(*) AS n FROM t GROUP BY url), i AS (SELECT string_split(target, '#')[1] AS url, count(*) AS n FROM t GROUP BY 1)
SELECT d.url, CAST(coalesce(i.n, 0) AS BIGINT) AS inbound, CAST(coalesce(o.n, 0) AS BIGINT) AS outbound FROM d LEFT JOIN i USING (url) LEFT JOIN o USING (url)
""")
def link_graph_degrees(spark, sf_dir):
    k = F.col("doc_id")
    made = F.concat(
        F.lit("[a](https://docs.example/"), k * 7 % 500, F.lit("#part) "), "text", F.lit(" [b](https://docs.example/"), k * 3 % 900, F.lit(') ![i](img.png) [c](https://else.example/) [d](https://docs.example/1 "t") [e](broken')
    )
    return derive.link_graph(table(spark, sf_dir, "documents").select(F.concat(F.lit("https://docs.example/"), k).alias("canonical_url"), made.alias("document")))


# -- search

SEARCH = "The tion, and, of the"
_QUERIES = search.parse_queries(SEARCH)


def _score_sql(source: str = _CORPUS_SQL, queries: list[list[str]] = _QUERIES) -> str:
    """One row per page and query that matches: query, canonical_url, output_path, score, matches."""
    parts = []
    for i, q in enumerate(queries):
        m = " + ".join(f"CAST(contains(lower(t), '{x}') AS INTEGER)" for x in q)
        in_title = " + ".join(f"CAST(contains(lower(title), '{x}') AS INTEGER)" for x in q)
        every = " AND ".join(f"contains(lower(document), '{x}')" for x in q)
        parts.append(f"""SELECT {i} AS query, canonical_url, output_path, max(title) AS title, CAST(sum(m * CASE WHEN starts_with(t, '#') THEN 4 ELSE 1 END) + max(10 * ({in_title})) AS BIGINT) AS score,
  string_agg(output_path || ':' || n || ': ' || left(t, 120), chr(10) ORDER BY n) FILTER (k <= 5) AS matches
FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY n) AS k FROM (
  SELECT canonical_url, output_path, title, n, t, {m} AS m FROM (
    SELECT canonical_url, output_path, title, n, trim(l[n], E' \\t\\r') AS t FROM (
      SELECT *, string_split(document, chr(10)) AS l FROM docs WHERE {every}), LATERAL (SELECT unnest(range(5, len(l))) AS n))
  WHERE NOT starts_with(t, 'title:') AND {m} > 0)) GROUP BY canonical_url, output_path""")
    return f"WITH docs AS MATERIALIZED ({source}), hits AS ({' UNION ALL '.join(parts)})"


_COMBINED_SQL = f"""{_score_sql()}, top AS (SELECT canonical_url AS url, output_path AS path, max(title) AS title, CAST(sum(score) AS BIGINT) AS score, string_agg(matches, chr(10) ORDER BY query) AS matches,
  string_agg(CAST(query AS VARCHAR), ',' ORDER BY query) AS queries FROM hits GROUP BY 1, 2 ORDER BY score DESC, path LIMIT 20) SELECT * FROM top"""


def _flat(hits: DataFrame) -> DataFrame:
    return hits.select(*[c for c in hits.columns if c not in ("matches", "queries")], F.array_join("matches", "\n").alias("matches"), F.array_join(F.col("queries").cast("array<string>"), ",").alias("queries"))


def _raw_title(spark, sf_dir) -> DataFrame:
    return _corpus(spark, sf_dir).select("canonical_url", "output_path", "document")


def _shown(column: str) -> str:
    """A title as a search shows it: quoted marks are not undone."""
    return f"rtrim(ltrim(trim(replace(replace({column}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')), '\"'), '\"')"


@query(_COMBINED_SQL)
def search_combined(spark, sf_dir):
    return _flat(search.search(_raw_title(spark, sf_dir), SEARCH))


@query(_COMBINED_SQL + " WHERE queries = '0,1,2'")
def search_all(spark, sf_dir):
    return _flat(search.search_mode(_raw_title(spark, sf_dir), SEARCH, "all"))


@query(
    f"{_score_sql()} SELECT CAST(query AS INTEGER) AS query, canonical_url AS url, output_path AS path, title, score, matches, '0' AS queries FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, output_path) AS k FROM hits) WHERE k <= 20"
)
def search_separate(spark, sf_dir):
    return _flat(search.search_mode(_raw_title(spark, sf_dir), SEARCH, "separate"))


@query(f"{_score_sql(queries=[['the', 'tion']])} SELECT canonical_url AS url, score, matches FROM hits")
def search_snippets_top5(spark, sf_dir):
    """Score and first five lines of every page that matches, not only of the best."""
    hits = search.score(_raw_title(spark, sf_dir), [["the", "tion"]])
    return hits.select("url", F.get("q", F.lit(0))["score"].alias("score"), F.array_join(F.get("q", F.lit(0))["matches"], "\n").alias("matches"))


def _relevance_sql(queries: list[list[str]]) -> str:
    scores = []
    for q in queries:
        m = " + ".join(f"CAST(contains(lower(x), '{t}') AS INTEGER)" for t in q)
        every = " AND ".join(f"(contains(lower(text), '{t}') OR contains(lower(title), '{t}'))" for t in q)
        in_title = " + ".join(f"CAST(contains(lower(title), '{t}') AS INTEGER)" for t in q)
        scores.append(f"CASE WHEN {every} THEN 10 * ({in_title}) + coalesce(list_sum(list_transform(string_split(text, chr(10)), lambda x: ({m}) * CASE WHEN starts_with(trim(x), '#') THEN 4 ELSE 1 END)), 0) ELSE 0 END")
    return f"SELECT doc_id, CAST(greatest(0, {', '.join(scores)}) AS BIGINT) AS relevance FROM ({_CORPUS_SQL})"


@query(_relevance_sql([["the", "token"], ["der", "ung"], ["qu"]]))
def relevance_gate(spark, sf_dir):
    return _corpus(spark, sf_dir).select("doc_id", search.relevance(F.col("title"), F.col("text"), [["the", "token"], ["der", "ung"], ["qu"]]).alias("relevance"))


# -- derived files


@query(f"SELECT CAST(row_number() OVER (ORDER BY canonical_url, output_path, depth, description) - 1 AS BIGINT) AS position, '- [' || canonical_url || '](' || output_path || ') (' || depth || ')' || CASE WHEN description = '' THEN '' ELSE ' — ' || description END AS line FROM ({_CORPUS_SQL})")
def page_index_lines(spark, sf_dir):
    return derive.page_index(corpus.manifest(_corpus(spark, sf_dir)))


@query(f"SELECT CAST(row_number() OVER (ORDER BY depth, canonical_url) - 1 AS BIGINT) AS position, '- [' || canonical_url || '](' || output_path || ')' || CASE WHEN description = '' THEN '' ELSE ': ' || {_cut_sql('description')} END AS line FROM ({_CORPUS_SQL})")
def summary_index_lines(spark, sf_dir):
    return derive.summary_index(corpus.manifest(_corpus(spark, sf_dir)))


_RUNS_SQL = "SELECT 'https://' || c_mktsegment || '.example/' AS url, " + ", ".join(f"CAST(count(*) FILTER (c_custkey % 7 = {i}) AS BIGINT) AS {c}" for i, c in enumerate(derive.REPORT)) + ", count(*) > 300 AS truncated FROM customer GROUP BY 1"


@query(
    f"SELECT *, CAST(CASE WHEN truncated OR pending > 0 OR (written = 0 AND failed > 0) THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM (SELECT url, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in derive.REPORT)}, bool_or(truncated) AS truncated FROM ({_RUNS_SQL}) GROUP BY ROLLUP (url))"
)
def crawl_report_rollup(spark, sf_dir):
    k = F.col("c_custkey") % 7
    runs = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("https://"), "c_mktsegment", F.lit(".example/")).alias("url")).agg(*[F.count_if(k == i).alias(c) for i, c in enumerate(derive.REPORT)], (F.count("*") > 300).alias("truncated"))
    return derive.report(runs)


@query(
    """WITH fetched AS (SELECT page_id, url || '|' || page_id AS canonical_url, CASE WHEN page_id % 3 < 2 THEN 'a' END AS etag FROM pages),
known AS (SELECT canonical_url, CASE WHEN page_id % 3 = 0 THEN 'a' ELSE 'b' END AS etag FROM fetched)
SELECT page_id, f.etag IS NULL OR k.etag IS NULL OR f.etag <> k.etag AS modified FROM fetched f LEFT JOIN known k USING (canonical_url)"""
)
def conditional_fetch(spark, sf_dir):
    """A third of the pages have the etag that was stored, a third another, a third none."""
    k = F.col("page_id") % 3
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("|"), "page_id").alias("canonical_url"), F.when(k < 2, F.lit("a")).alias("etag"))
    known = pages.select("canonical_url", F.when(k == 0, "a").otherwise("b").alias("etag"))
    return stores.conditional(pages, known).select("page_id", "modified")


@query(
    """WITH RECURSIVE store AS (
  SELECT 'https://n' || n_nationkey || '.example' AS origin, 'https://n' || n_nationkey || '.example/' || h AS url, CAST(CASE WHEN h = n_nationkey THEN 200 ELSE 302 END AS INTEGER) AS status,
         CASE WHEN n_nationkey % 5 = 4 THEN 'https://else.example/' || h ELSE '/' || (h + 1) END AS location
  FROM (SELECT n_nationkey, unnest(range(0, n_nationkey + 1)) AS h FROM nation)),
walk AS (
  SELECT n_nationkey, 0 AS hops, s.origin, s.status, CASE WHEN s.location[1] = '/' THEN s.origin || s.location ELSE s.location END AS target
  FROM nation n JOIN store s ON s.url = 'https://n' || n_nationkey || '.example/0'
  UNION ALL
  SELECT w.n_nationkey, w.hops + 1, s.origin, s.status, CASE WHEN s.location[1] = '/' THEN s.origin || s.location ELSE s.location END
  FROM walk w JOIN store s ON s.url = w.target WHERE w.status = 302 AND w.hops < 10 AND starts_with(w.target, w.origin || '/'))
SELECT n_nationkey, CASE WHEN status = 302 AND NOT starts_with(target, origin || '/') THEN 'cross_origin' WHEN status = 302 THEN 'too_many' END AS redirect_error, status
FROM (SELECT *, max(hops) OVER (PARTITION BY n_nationkey) AS last FROM walk) WHERE hops = last"""
)
def redirect_follow(spark, sf_dir):
    """Nation k redirects k times before it answers; those with k % 5 = 4 leave their origin at once."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    hop = nations.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.col("n_nationkey"))).alias("h"))
    origin = F.concat(F.lit("https://n"), "n_nationkey", F.lit(".example"))
    last = F.col("h") == F.col("n_nationkey")
    store = hop.select(
        F.concat(origin, F.lit("/"), "h").alias("url"), F.when(last, 200).otherwise(302).alias("status"), F.lit("text/html").alias("content_type"), F.lit("x").alias("body"),
        F.when(F.col("n_nationkey") % 5 == 4, F.concat(F.lit("https://else.example/"), "h")).otherwise(F.concat(F.lit("/"), F.col("h") + 1)).alias("location"), F.lit(None).cast("string").alias("etag"),
    )
    asked = nations.select("n_nationkey", F.concat(origin, F.lit("/0")).alias("url"))
    return asked.join(stores.follow_redirects(asked.select("url"), store), "url").select("n_nationkey", "redirect_error", "status")


# -- extraction: not expressible in SQL


@query()
def html_to_markdown(spark, sf_dir):
    return extract.extract_pages(table(spark, sf_dir, "pages"), key="page_id").select("page_id", "markdown")


@query()
def extract_page(spark, sf_dir):
    found = extract.extract_pages(table(spark, sf_dir, "pages"), key="page_id")
    return found.select("page_id", "title", "description", F.size("links").alias("n_links"), F.sha2(F.col("markdown").cast("binary"), 256).alias("digest"), "extract_error")


#: Links of an entry page of the web that crawl_pages walks, about; the crawl takes 10,000 of a page at most.
ENTRY_LINKS = 500


def entry_tree(pages, n: int, fanout: int):
    """Entry pages (url, html) over n pages (url) as a tree whose root is https://web.example/, and how many links lead from there to a page."""
    groups, level, levels = max(1, math.ceil(n / fanout)), 1, []
    nodes = pages.select("url", F.pmod(F.xxhash64("url"), F.lit(groups)).alias("group"))
    while True:
        links = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<a href="'), "url", F.lit('">p</a>')))), " ")
        html = F.concat(F.lit("<main>"), links, F.lit("</main>")).alias("html")
        if groups == 1:
            levels.append(nodes.agg(html).select(F.lit("https://web.example/").alias("url"), "html"))
            return reduce(DataFrame.unionByName, levels), level
        entries = nodes.groupBy("group").agg(html).withColumn("url", F.concat(F.lit(f"https://web.example/e/{level}/"), F.col("group").cast("string")))
        entries = materialise(entries, "entries")
        levels.append(entries.select("url", "html"))
        nodes = entries.select("url", F.floor(F.col("group") / fanout).alias("group"))
        groups, level = math.ceil(groups / fanout), level + 1


@query()
def crawl_pages(spark, sf_dir):
    """A crawl of a web over all pages: a tree of entry pages leads to each of them."""
    from tidepool.config import Config
    from tidepool.operators.crawl import crawl

    own = table(spark, sf_dir, "pages").select(F.concat(F.lit("https://web.example/p/"), "page_id").alias("url"), "html")
    n = own.count()
    entries, depth = entry_tree(own, n, ENTRY_LINKS)
    store = stores.from_pages(own.unionByName(entries))
    robots_file = spark.createDataFrame([("https://web.example/robots.txt", 404, None, "", None, None)], stores.STORE)
    config = Config(max_pages=max(10_000_000, 4 * n), max_depth=depth + 2)
    done = crawl(spark, store.unionByName(robots_file), "https://web.example/", config, now=1)
    return done.frontier.select("canonical_url", "depth", "state", "parent_url", "discovery_source")
