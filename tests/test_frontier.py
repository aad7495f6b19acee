from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidepool.operators import bfs, frontier

FOUND = "canonical_url string, depth int, parent_url string, discovery_source string, arrival string"


def admitted(spark, rows, now=1, into=None):
    return frontier.admit(into if into is not None else frontier.empty(spark), spark.createDataFrame(rows, FOUND), now)


def test_shallower_finds_take_over(spark):
    f, _ = admitted(spark, [("u", 4, "p4", "link", "0")])
    f, seen = admitted(spark, [("u", 2, "p2", "sitemap", "0"), ("u", 7, "p7", "link", "1")], 2, f)
    row = f.head()
    assert (row["depth"], row["parent_url"], row["discovery_source"], row["state"], f.count()) == (2, "p2", "sitemap", "queued", 1)
    assert [tuple(r) for r in seen.collect()] == [("u", 2, False)]
    with pytest.raises(Exception, match="empty"):
        admitted(spark, [("", 0, None, None, "0")])[0].collect()


def test_leases_order_expire_and_guard(spark):
    f, _ = admitted(spark, [("z", 1, None, None, "0"), ("a", 1, None, None, "1"), ("root", 0, None, None, "2")])
    f, leases = frontier.lease_batch(f, 100, 2, 50)
    assert sorted(r["canonical_url"] for r in leases.collect()) == ["a", "root"]
    f = frontier.recover_expired(f, 150)
    assert frontier.counts(f).head()["queued"] == 3
    assert [r["canonical_url"] for r in frontier.lease_batch(f, 151, 1, 50)[1].collect()] == ["root"]
    assert frontier.lease_batch(f, 151, 0, 50)[1].count() == 0
    with pytest.raises(ValueError):
        frontier.lease_batch(f, 151, 1, 0)


def test_attempts_retries_and_stale_leases(spark):
    f, _ = admitted(spark, [("u", 0, None, None, "0")])
    f, leases = frontier.lease_batch(f, 10, 1, 100)
    token = leases.head()["lease_token"]
    result = lambda kind, until=None, error=None: spark.createDataFrame([("u", token, kind, error, until)], "canonical_url string, lease_token string, outcome string, error string, next_eligible_at bigint")
    f, _ = frontier.settle(f, result("attempt"), 11)
    f, _ = frontier.settle(f, result("retry", 1000, "why"), 12)
    row = f.head()
    assert (row["state"], row["attempts"], row["next_eligible_at"], row["error"], row["lease_token"]) == ("delayed", 1, 1000, "why", None)
    assert frontier.earliest_eligible(f).head()[0] == 1000 and frontier.ready(f, 999).isEmpty() and not frontier.ready(f, 1000).isEmpty()
    _, conflicts = frontier.settle(f, result("terminal_error"), 13)
    assert [tuple(r) for r in conflicts.collect()] == [("u", "terminal_error")]
    done, none = frontier.settle(f, result("skipped", None, "robots_denied"), 14)
    assert done.head()["state"] == "skipped" and none.isEmpty()


def test_responses_keep_the_lease_and_pages_are_written_from_awaiting(spark):
    f, leases = frontier.lease_batch(admitted(spark, [("u", 0, None, None, "0")])[0], 10, 1, 100)
    token = leases.head()["lease_token"]
    got = spark.createDataFrame([("u", token, "response", "https://f/", 200, "e1")], "canonical_url string, lease_token string, outcome string, final_url string, status_code int, etag string").selectExpr("*", "CAST(NULL AS STRING) AS error", "CAST(NULL AS BIGINT) AS next_eligible_at")
    f, none = frontier.settle(f, got, 11)
    row = f.head()
    assert none.isEmpty() and (row["state"], row["lease_token"], row["final_url"], row["status_code"], row["attempts"]) == ("leased", token, "https://f/", 200, 0)
    assert frontier.validators(f).head()["etag"] == "e1"
    one = lambda kind, t: spark.createDataFrame([("u", t, kind, None, None)], "canonical_url string, lease_token string, outcome string, error string, next_eligible_at bigint")
    f, _ = frontier.settle(f, one("awaiting_output", token), 12)
    assert f.head()["state"] == "awaiting_output" and f.head()["lease_token"] is None
    f, none = frontier.settle(f, one("written", "any"), 13)
    assert f.head()["state"] == "written" and none.isEmpty()
    assert frontier.settle(f, one("skipped", "any"), 14)[1].count() == 1
    assert frontier.page(f, "u").count() == 1 and frontier.counts(f).head()["written"] == 1


def test_backoff_and_retryable(spark):
    got = spark.range(9).select(frontier.backoff_ms(F.col("id").cast("int")).alias("b")).collect()
    assert [r["b"] for r in got] == [500, 1000, 2000, 4000, 8000, 16000, 32000, 32000, 32000]
    codes = [408, 425, 429, 500, 599, 404, 200, 600]
    rows = spark.createDataFrame([(c,) for c in codes], "s int").select(frontier.retryable(F.col("s")).alias("r")).collect()
    assert [r["r"] for r in rows] == [True] * 5 + [False] * 3


def test_bfs_depth_is_the_shortest_path(spark):
    rng = __import__("random").Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)]
    want, level, d = {0: 0}, {0}, 0
    while level and d < 5:
        d += 1
        level = {b for a, b in edges if a in level} - want.keys()
        want |= dict.fromkeys(level, d)
    got = bfs.depths(spark.createDataFrame(edges, "src bigint, dst bigint"), spark.createDataFrame([(0,)], "node bigint"), 5)
    assert {r["node"]: r["depth"] for r in got.collect()} == want
