"""Where pages come from: stored responses, and what a response means before its page is read.

A store is a table of responses: url, status int, content_type, body string, location, etag. Live fetching is a data source of that shape with
one column more (tidepool.sources.http).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.sitemap import same_origin
from tidepool.runtime import materialise

#: A store is a table of responses, or a function from a table of URLs (url) to their responses, as live fetching is.
STORE = "url string, status int, content_type string, body string, location string, etag string"
#: What a live store answers: utf8 is false if bytes of the body that aren't UTF-8 were replaced.
LIVE = f"{STORE}, utf8 boolean"
MOST_HOPS = 10


def lookup(store: DataFrame | Callable[[DataFrame], DataFrame], wanted: DataFrame) -> DataFrame:
    """Responses to the URLs of wanted (url); those of a live store are fetched once and written."""
    if callable(store):
        return materialise(store(wanted.distinct()), "fetched")
    return store.join(wanted.distinct(), "url", "left_semi")


def from_pages(pages: DataFrame) -> DataFrame:
    """The store of a table of pages (url, html)."""
    return pages.select("url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.col("html").alias("body"), F.lit(None).cast("string").alias("location"), F.sha2(F.col("html").cast("binary"), 256).alias("etag"))


def is_html_type(content_type: Column) -> Column:
    low = F.lower(content_type)
    return content_type.isNull() | low.contains("text/html") | low.contains("application/xhtml+xml")


def looks_like_html(body: Column) -> Column:
    """Whether the first 1024 bytes begin as an HTML document does, or hold its root."""
    start = F.lower(F.decode(F.substring(body.cast("binary"), 1, 1024), "UTF-8"))
    return F.ltrim(start).startswith("<!doctype html") | start.contains("<html")


def fetch_error(status: Column, content_type: Column, body: Column, most_bytes: int, *, raw: bool = False) -> Column:
    """Why a response has no page: network, status, content_type, body_too_large or not_html (it isn't UTF-8); null if it has."""
    kind = F.when(status.isNull(), "network").when(~status.between(200, 299), "status")
    if not raw:
        kind = kind.when(~is_html_type(content_type), "content_type")
    kind = kind.when(F.octet_length(body) > most_bytes, "body_too_large")
    return kind if raw else kind.when(~F.is_valid_utf8(body), "not_html")


def follow_redirects(requests: DataFrame, store: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """requests (url) with final_url, status, content_type, body, etag, utf8 and redirect_error (cross_origin, too_many, no_location).

    A URL that the store doesn't hold answers 404. Each round follows one hop of the requests that are still redirected, so a round joins only those.
    """
    now = requests.select("url", F.col("url").alias("at"))
    done: DataFrame | None = None
    for k in range(MOST_HOPS + 1):
        held = lookup(store, now.select(F.col("at").alias("url"))) if callable(store) else store
        utf8 = F.col("utf8") if "utf8" in held.columns else F.lit(True)
        hop = held.select(F.col("url").alias("at"), F.lit(True).alias("there"), "status", "content_type", "body", "location", "etag", utf8.alias("utf8"))
        got = now.join(hop, "at", "left").withColumn("status", F.when(F.col("there"), F.col("status")).otherwise(404)).drop("there")
        moved = F.coalesce(F.col("status").between(300, 399), F.lit(False))
        scheme = F.regexp_extract("at", r"^([a-z]+)://", 1)
        target = F.when(F.col("location").rlike(r"^(?i)https?://"), F.col("location")).when(F.col("location").startswith("//"), F.concat(scheme, F.lit(":"), "location")).when(
            F.col("location").startswith("/"), F.concat(F.regexp_extract("at", r"^([a-z]+://[^/?#]*)", 1), "location")).otherwise(F.concat(F.regexp_extract("at", r"^([a-z]+://[^/?#]*(?:/[^?#]*/|/))", 1), "location"))
        error = F.when(~moved, F.lit(None).cast("string")).when(F.col("location").isNull(), "no_location").when(~same_origin(target, F.col("url")), "cross_origin")
        if k == MOST_HOPS:
            error = F.coalesce(error, F.when(moved, "too_many"))
        got = materialise(got.withColumns({"moved": moved, "redirect_error": error, "target": target}), "hops")
        ended = got.where("NOT moved OR redirect_error IS NOT NULL").select("url", F.col("at").alias("final_url"), "status", "content_type", "body", "etag", "utf8", "redirect_error")
        done = ended if done is None else done.unionByName(ended)
        now = got.where("moved AND redirect_error IS NULL").select("url", F.col("target").alias("at"))
        if now.isEmpty():
            break
    return done


def conditional(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """fetched (canonical_url, etag) with modified: whether there is no etag, or another than the one known (canonical_url, etag)."""
    both = fetched.join(known.select("canonical_url", F.col("etag").alias("known_etag")), "canonical_url", "left")
    return both.withColumn("modified", ~F.coalesce(F.col("etag") == F.col("known_etag"), F.lit(False))).drop("known_etag")


def read_lines(spark: SparkSession, path: str, schema: str, *, strict: bool = True) -> DataFrame:
    """JSON lines; a bad line is an error, or left out if not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, directory: str) -> DataFrame:
    """(output_path, document) of a folder's pages/*.md."""
    files = spark.read.text(f"{directory.rstrip('/')}/pages/*.md", wholetext=True)
    return files.select(F.concat(F.lit("pages/"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("output_path"), F.col("value").alias("document"))


def write_documents(corpus: DataFrame, path: str) -> None:
    """The corpus as Parquet, in files of a bounded size instead of one file a page, sorted by URL within each."""
    corpus.sortWithinPartitions("canonical_url").write.mode("overwrite").option("maxRecordsPerFile", 50_000).parquet(path)
