"""Sitemaps: discovery, <loc> extraction, one level of index expansion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.text import lines, trim

MOST_CHILDREN, MOST_URLS = 32, 50_000


def discover(robots: DataFrame, *, origin: str = "origin", text: str = "body") -> DataFrame:
    """(origin, position, sitemap) in order of preference: the Sitemap lines of robots.txt, then the usual place."""
    clean = F.transform(lines(F.coalesce(F.col(text), F.lit(""))), lambda x: trim(F.split(x, "#")[0]))
    named = F.transform(F.filter(clean, lambda x: F.lower(trim(F.substring_index(x, ":", 1))) == "sitemap"), lambda x: trim(F.regexp_replace(x, "(?s)^[^:]*:", "")))
    return robots.select(origin, F.posexplode(F.concat(named, F.array(F.concat(F.col(origin), F.lit("/sitemap.xml"))))).alias("position", "sitemap"))


def locations(text: Column) -> Column:
    """What stands between <loc> and </loc>, in order, without surrounding space or empty ones."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("(?s)<loc>(.*?)</loc>"), 1), trim), lambda x: x != "")


def same_origin(url: Column, origin: Column) -> Column:
    part = lambda c, i: F.lower(F.regexp_extract(c, r"^(?i)(https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?", i))
    port = lambda c: F.when(part(c, 3) != "", part(c, 3)).when(part(c, 1) == "https", "443").otherwise("80")
    return (part(url, 1) != "") & (part(url, 1) == part(origin, 1)) & (part(url, 2) == part(origin, 2)) & (port(url) == port(origin))


def load(sitemaps: DataFrame, store: DataFrame | Callable[[DataFrame], DataFrame], *, origin: str = "origin", sitemap: str = "sitemap") -> DataFrame:
    """(origin, sitemap, position, url): the pages that each sitemap lists, those of an index from its first children.

    store: (url, body) of fetched documents, or a function from URLs (url) to them. A sitemap that isn't there, and an index without children, lists nothing.
    """
    get = store if callable(store) else lambda wanted: store
    asked = sitemaps.select(F.col(origin).alias("origin"), F.col(sitemap).alias("sitemap"))
    found = asked.join(get(asked.select(F.col("sitemap").alias("url"))).select(F.col("url").alias("sitemap"), "body"), "sitemap")
    found = found.withColumn("locs", locations(F.col("body"))).withColumn("index", F.col("body").contains("<sitemapindex")).drop("body")
    direct = found.where("NOT index").select("origin", "sitemap", F.posexplode("locs").alias("i", "url")).select("origin", "sitemap", F.array(F.lit(0), F.col("i")).alias("at"), "url")
    child = found.where("index").select("origin", "sitemap", F.posexplode(F.slice("locs", 1, MOST_CHILDREN)).alias("c", "child")).where(same_origin(F.col("child"), F.col("origin")))
    child = child.join(get(child.select(F.col("child").alias("url"))).select(F.col("url").alias("child"), "body"), "child").select("origin", "sitemap", "c", F.posexplode(locations(F.col("body"))).alias("i", "url"))
    every = direct.unionByName(child.select("origin", "sitemap", F.array("c", "i").alias("at"), "url")).where(same_origin(F.col("url"), F.col("origin")))
    position = F.row_number().over(Window.partitionBy("origin", "sitemap").orderBy("at")) - 1
    return every.withColumn("position", position).where(F.col("position") < MOST_URLS).select("origin", "sitemap", "position", "url")
