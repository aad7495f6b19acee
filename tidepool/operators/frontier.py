"""The crawl frontier as a table: admission, leases, attempts, retries, expiry, counts.

A row's key is its canonical URL. Every operator takes a frontier and returns the next one; `now` is a parameter in epoch milliseconds, so a step
repeated after a failure gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("queued", "delayed", "leased", "awaiting_output", "written", "skipped", "terminal_error")
SCHEMA = (
    "canonical_url string, depth int, parent_url string, discovery_source string, state string, attempts int, next_eligible_at bigint, lease_token string, "
    "lease_expires_at bigint, final_url string, status_code int, output_path string, digest string, bytes bigint, error string, etag string, last_modified string, "
    "created_at bigint, updated_at bigint"
)
BACKOFF_MS, MOST_DOUBLINGS = 500, 6


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def admit(frontier: DataFrame, found: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(frontier with the found URLs, admissions (canonical_url, depth, inserted)).

    found: canonical_url, depth, parent_url, discovery_source, and arrival, which breaks ties. A known URL keeps its state and takes a depth, parent
    and source only from a strictly shallower find. Empty URLs are an error.
    """
    found = found.withColumn("canonical_url", F.when(F.col("canonical_url") == "", F.raise_error(F.lit("canonical URL must not be empty"))).otherwise(F.col("canonical_url")))
    best = found.groupBy("canonical_url").agg(
        F.min("depth").alias("found_depth"), F.min_by(F.struct("parent_url", "discovery_source"), F.struct("depth", "arrival")).alias("via")
    )
    both = frontier.join(best, "canonical_url", "full_outer")
    new, shallower = F.col("state").isNull(), F.col("found_depth") < F.col("depth")
    take = new | F.coalesce(shallower, F.lit(False))
    changed = {
        "depth": F.when(take, F.col("found_depth")).otherwise(F.col("depth")).cast("int"),
        "parent_url": F.when(take, F.col("via.parent_url")).otherwise(F.col("parent_url")),
        "discovery_source": F.when(take, F.col("via.discovery_source")).otherwise(F.col("discovery_source")),
        "state": F.coalesce("state", F.lit("queued")),
        "attempts": F.coalesce("attempts", F.lit(0)),
        "next_eligible_at": F.coalesce("next_eligible_at", F.lit(0).cast("bigint")),
        "created_at": F.coalesce("created_at", F.lit(now).cast("bigint")),
        "updated_at": F.when(take, F.lit(now).cast("bigint")).otherwise(F.col("updated_at")),
    }
    after = both.withColumns(changed | {"inserted": new}).where("canonical_url IS NOT NULL")
    return after.select(*frontier.columns), after.where("found_depth IS NOT NULL").select("canonical_url", "depth", "inserted")


def ready(frontier: DataFrame, now: int) -> DataFrame:
    return frontier.where(F.col("state").isin("queued", "delayed") & (F.col("next_eligible_at") <= now))


def _token(now: int) -> Column:
    return F.sha2(F.concat_ws("|", "canonical_url", F.lit(now), "attempts").cast("binary"), 256)


def lease_batch(frontier: DataFrame, now: int, limit: int, duration_ms: int) -> tuple[DataFrame, DataFrame]:
    """(frontier, leases): the first `limit` ready rows by depth, then URL, are leased until now + duration."""
    if duration_ms <= 0:
        raise ValueError("lease duration must be positive")
    chosen = ready(frontier, now).orderBy("depth", "canonical_url").limit(limit)
    leases = chosen.select("canonical_url", "depth", "attempts", _token(now).alias("lease_token"), F.lit(now + duration_ms).cast("bigint").alias("lease_expires_at"))
    return _leased(frontier, leases, now), leases


def lease_level(frontier: DataFrame, now: int, duration_ms: int) -> tuple[DataFrame, DataFrame]:
    """The same for all ready rows of the least depth: a whole level, without a sort."""
    if duration_ms <= 0:
        raise ValueError("lease duration must be positive")
    level = ready(frontier, now).agg(F.min("depth")).head()[0]
    leases = ready(frontier, now).where(F.col("depth") == level).select("canonical_url", "depth", "attempts", _token(now).alias("lease_token"), F.lit(now + duration_ms).cast("bigint").alias("lease_expires_at"))
    return _leased(frontier, leases, now), leases


def _leased(frontier: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    own = leases.select("canonical_url", F.col("lease_token").alias("t"), F.col("lease_expires_at").alias("e"))
    both = frontier.join(own, "canonical_url", "left")
    got = F.col("t").isNotNull()
    return both.withColumns({
        "state": F.when(got, "leased").otherwise(F.col("state")), "lease_token": F.coalesce("t", "lease_token"), "lease_expires_at": F.coalesce("e", "lease_expires_at"),
        "updated_at": F.when(got, F.lit(now).cast("bigint")).otherwise(F.col("updated_at")),
    }).select(*frontier.columns)


def backoff_ms(attempts: Column) -> Column:
    return F.lit(BACKOFF_MS) * F.pow(F.lit(2), F.least(attempts, F.lit(MOST_DOUBLINGS))).cast("bigint")


def retryable(status: Column) -> Column:
    return status.isin(408, 425, 429) | status.between(500, 599)


def settle(frontier: DataFrame, results: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(frontier, conflicts): each leased row's result applied at once.

    results: canonical_url, lease_token, outcome (attempt, response, retry, awaiting_output, written, skipped, terminal_error), and the outcome's
    columns next_eligible_at, error, final_url, status_code, output_path, digest, bytes, etag, last_modified. A result needs its row's live lease, but for
    skipped (any row that isn't written or failed) and written (a row that awaits output too); others are returned as conflicts.
    """
    r = results.select("canonical_url", F.struct(*[c for c in results.columns if c != "canonical_url"]).alias("r"))
    both = frontier.join(r, "canonical_url", "left")
    kind = F.col("r.outcome")
    live = (F.col("state") == "leased") & (F.col("lease_token") == F.col("r.lease_token")) & (F.col("lease_expires_at") > now)
    ok = F.coalesce(F.when(kind == "skipped", ~F.col("state").isin("written", "terminal_error")).when(kind == "written", live | (F.col("state") == "awaiting_output")).otherwise(live), F.lit(False)) & kind.isNotNull()
    keeps_lease = kind.isin("attempt", "response")
    state = F.when(kind == "retry", "delayed").when(keeps_lease, "leased").otherwise(kind)
    changed = {
        "state": F.when(ok, state).otherwise(F.col("state")),
        "attempts": F.when(ok & (kind == "attempt"), F.col("attempts") + 1).otherwise(F.col("attempts")).cast("int"),
        "next_eligible_at": F.when(ok & (kind == "retry"), F.col("r.next_eligible_at")).otherwise(F.col("next_eligible_at")),
        "error": F.when(ok & kind.isin("attempt", "written"), F.lit(None).cast("string")).when(ok & kind.isin("retry", "skipped", "terminal_error"), F.col("r.error")).otherwise(F.col("error")),
        "lease_token": F.when(ok & ~keeps_lease, F.lit(None).cast("string")).otherwise(F.col("lease_token")),
        "lease_expires_at": F.when(ok & ~keeps_lease, F.lit(None).cast("bigint")).otherwise(F.col("lease_expires_at")),
        "updated_at": F.when(ok, F.lit(now).cast("bigint")).otherwise(F.col("updated_at")),
    }
    for c in ("final_url", "status_code", "output_path", "digest", "bytes", "etag", "last_modified"):
        if c in results.columns:
            changed[c] = F.when(ok, F.coalesce(F.col(f"r.{c}"), F.col(c))).otherwise(F.col(c))
    return both.withColumns(changed).select(*frontier.columns), both.where(kind.isNotNull() & ~ok).select("canonical_url", kind.alias("outcome"))


def recover_expired(frontier: DataFrame, now: int) -> DataFrame:
    over = (F.col("state") == "leased") & (F.col("lease_expires_at") <= now)
    return frontier.withColumns({
        "state": F.when(over, "queued").otherwise(F.col("state")), "next_eligible_at": F.when(over, F.least("next_eligible_at", F.lit(now).cast("bigint"))).otherwise(F.col("next_eligible_at")),
        "lease_token": F.when(over, F.lit(None).cast("string")).otherwise(F.col("lease_token")), "lease_expires_at": F.when(over, F.lit(None).cast("bigint")).otherwise(F.col("lease_expires_at")),
        "updated_at": F.when(over, F.lit(now).cast("bigint")).otherwise(F.col("updated_at")),
    })


def counts(frontier: DataFrame) -> DataFrame:
    """One row: total, and the rows in each state."""
    return frontier.agg(F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def earliest_eligible(frontier: DataFrame) -> DataFrame:
    """One row: when the first delayed row is eligible, 0 without any."""
    return frontier.where("state = 'delayed'").agg(F.coalesce(F.min("next_eligible_at"), F.lit(0)).cast("bigint").alias("earliest"))


def page(frontier: DataFrame, url: str) -> DataFrame:
    return frontier.where(F.col("canonical_url") == url)


def validators(frontier: DataFrame) -> DataFrame:
    return frontier.select("canonical_url", "etag", "last_modified")
