"""Operator 5: URL filters by a temporal join with dated lists.

A list is a history of entries: on a day a pattern is added, on another it is removed. Each addition becomes an interval of validity up to the
pattern's next change, and each capture is judged by the entries whose interval holds its fetch time. A pattern is a domain (which stands
for its subdomains too) or a host with the beginning of a path, in whole segments; so the keys that a URL can match are the few suffixes of
its host and prefixes of its path, and the join is one on equal keys with a range on time, not a search of every pattern.

Cases: a null URL, or one without a host, matches nothing and is not `valid`; a null fetch time matches nothing; of changes on one day, a
removal comes last; a repeated addition changes nothing; repeated rows are one capture; an empty list blocks nothing; an empty table gives
an empty one; other columns of the input are ignored unless kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import ref


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, key, since, until) from entries (list, kind 'domain' or 'prefix', pattern, action 'add' or 'remove', at); until is null
    while an entry is still active."""
    changes = entries.where("list IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL AND kind IN ('domain', 'prefix') AND action IN ('add', 'remove')")
    changes = changes.select("list", "kind", F.regexp_replace(F.lower("pattern"), "/+$", "").alias("key"), "action", "at").distinct()
    order = Window.partitionBy("list", "kind", "key").orderBy("at", "action")
    return changes.withColumn("until", F.lead("at").over(order)).where("action = 'add' AND (until IS NULL OR until > at)").select("list", "kind", "key", F.col("at").alias("since"), "until")


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", F.rtrim(found, F.lit(".")))


def keys(url: Column) -> Column:
    """Every (kind, key) that an entry for this URL can have."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(F.regexp_extract(url, r"^(?i:https?)://[^/?#]*/?([^?#]*)", 1), "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(segments)), lambda i: F.array_join(F.concat(F.array(host(url)), F.when(i > 0, F.slice(segments, 1, F.greatest(i, F.lit(1)))).otherwise(F.array().cast("array<string>"))), "/"))
    kind = lambda name, many: F.transform(many, lambda k: F.struct(F.lit(name).alias("kind"), F.lower(k).alias("key")))
    return F.when(host(url).isNotNull(), F.concat(kind("domain", domains), kind("prefix", prefixes)))


def judge(captures: DataFrame, entries: DataFrame, *, id_col: str, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """One row per capture (id, url, time): host, valid, n_active long (entries active then), blocked boolean, lists array<string> (theirs, in
    order), active_since (the earliest start of an active interval)."""
    capture = captures.select(ref(id_col).alias("id"), ref(url_col).alias("url"), ref(time_col).alias("t"))
    each = capture.select("id", "url", "t", F.explode_outer(keys(F.col("url"))).alias("k")).select("id", "url", "t", "k.kind", "k.key")
    match = intervals(entries).withColumnsRenamed({"kind": "ekind", "key": "ekey"})
    on = (F.col("kind") == F.col("ekind")) & (F.col("key") == F.col("ekey")) & (F.col("t") >= F.col("since")) & (F.col("until").isNull() | (F.col("t") < F.col("until")))
    found = each.join(match, on, "left").groupBy("id", "url", "t").agg(F.collect_set(F.when(F.col("list").isNotNull(), F.struct("list", "kind", "key"))).alias("active"), F.min("since").alias("since"))
    return found.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("t").alias(time_col), host(F.col("url")).alias("host"), host(F.col("url")).isNotNull().alias("valid"),
        F.size("active").cast("long").alias("n_active"), (F.size("active") > 0).alias("blocked"), F.array_sort(F.array_distinct(F.transform("active", lambda a: a["list"]))).alias("lists"), F.col("since").alias("active_since"),
    )
