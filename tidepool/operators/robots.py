"""robots.txt: parsing into ordered rules per origin, and evaluation of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.text import lines, trim

PRODUCT = "tidepool"
RULES = "array<struct<allow:boolean,pattern:string>>"


def parse(texts: DataFrame, *, key: str = "origin", text: str = "body", product: str = PRODUCT) -> DataFrame:
    """One row per key: rules array<struct<allow, pattern>> in file order (trailing stars say nothing and go), crawl_delay double (the largest stated for us).

    Every User-agent line sets whether what follows applies to us, so of stacked ones the last decides, and groups for everyone and for us
    count together.
    """
    line = texts.select(F.col(key), F.posexplode_outer(lines(F.col(text))).alias("pos", "raw"))
    clean = trim(F.split("raw", "#")[0])
    part = line.select(key, "pos", F.lower(trim(F.substring_index(clean, ":", 1))).alias("name"), F.when(clean.contains(":"), trim(F.regexp_replace(clean, r"(?s)^[^:]*:", ""))).alias("value"))
    agent = F.when((F.col("name") == "user-agent") & F.col("value").isNotNull(), (F.col("value") == "*") | (F.lower("value") == product.lower()))
    # one group is one robots document, whose size the source bounds
    applies = F.coalesce(F.last(agent, ignorenulls=True).over(Window.partitionBy(key).orderBy("pos")), F.lit(False))
    own = part.withColumn("applies", applies)
    rule = F.when(F.col("applies") & F.col("name").isin("allow", "disallow") & (F.col("value") != ""), F.struct("pos", (F.col("name") == "allow").alias("allow"), F.regexp_replace("value", r"\*+$", "").alias("pattern")))
    delay = F.when(F.col("applies") & (F.col("name") == "crawl-delay") & F.col("value").rlike(r"^[0-9]*\.?[0-9]+$|^[0-9]+\.$"), F.col("value").cast("double"))
    grouped = own.groupBy(key).agg(F.collect_list(rule).alias("r"), F.max(delay).alias("crawl_delay"))
    return grouped.select(key, F.transform(F.array_sort("r"), lambda x: F.struct(x["allow"].alias("allow"), x["pattern"].alias("pattern"))).alias("rules"), "crawl_delay")


def _matching(rules: Column, path: Column) -> Column:
    """Rules whose pattern begins the path; trailing stars of a pattern say nothing."""
    bare = F.transform(rules, lambda r: F.struct(r["allow"].alias("allow"), F.regexp_replace(r["pattern"], r"\*+$", "").alias("pattern")))
    return F.filter(bare, lambda r: path.startswith(r["pattern"]))


def allowed(rules: Column, path: Column, mode: str = "ordered") -> Column:
    """Whether the rules allow a path.

    `ordered`: no rule matches, or the first match allows, or a later match allows and its pattern is at least as long as the first one's.
    `rfc9309`: the longest match decides, and allowing wins among equals.
    """
    hits = _matching(rules, path)
    if mode == "rfc9309":
        best = F.array_max(F.transform(hits, lambda r: F.struct(F.octet_length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
        return F.coalesce(best["allow"], F.lit(True))
    if mode != "ordered":
        raise ValueError("mode is ordered or rfc9309")
    first = F.get(hits, F.lit(0))
    return F.coalesce(first["allow"] | F.exists(hits, lambda r: r["allow"] & (F.octet_length(r["pattern"]) >= F.octet_length(first["pattern"]))), F.lit(True))


def outcome(status: Column, rules: Column, path: Column, *, ignore: bool = False, mode: str = "ordered") -> Column:
    """allowed, denied, no_rules or fail_closed. status: of the robots request (null: it failed)."""
    if ignore:
        return F.lit("allowed")
    missing = status.between(400, 499) & ~status.isin(401, 403)
    return F.when(missing, "no_rules").when(status.isNull() | ~status.between(200, 299), "fail_closed").when(allowed(F.coalesce(rules, F.array().cast(RULES)), path, mode), "allowed").otherwise("denied")


def evaluate(requests: DataFrame, robots: DataFrame, *, key: str = "origin", path: str = "path", ignore: bool = False, mode: str = "ordered") -> DataFrame:
    """requests with a column robots: outcome of each row's path under its origin's rules. robots: key, status, rules."""
    return requests.join(robots.select(key, "status", "rules"), key, "left").withColumn("robots", outcome(F.col("status"), F.col("rules"), F.col(path), ignore=ignore, mode=mode)).drop("status", "rules")
