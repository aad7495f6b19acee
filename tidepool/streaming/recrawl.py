"""Changes among pages fetched again and again, as a stream.

The state of a URL is the digest of its last page; it survives restarts with the query's checkpoint. Late and repeated fetches are dropped by event
time, and a URL that isn't fetched for `forget` falls out of the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidepool.runtime import ensure_workers


def changes(fetched: DataFrame, *, late: str = "1 hour", forget_ms: int = 90 * 86_400_000) -> DataFrame:
    """(url, fetched_at, digest, change new|changed|unchanged) of a stream (url, fetched_at timestamp, body)."""
    ensure_workers(fetched.sparkSession)
    small = fetched.withWatermark("fetched_at", late).select("url", "fetched_at", F.sha2(F.col("body").cast("binary"), 256).alias("digest"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = (state.get if state.exists else (None, None))
        rows = pd.concat(list(batches)).sort_values(["fetched_at", "digest"])
        out = []
        for at, digest in zip(rows["fetched_at"], rows["digest"]):
            ms = int(at.timestamp() * 1000)
            if seen is not None and ms < seen:
                continue
            out.append((key[0], at, digest, "new" if last is None else "unchanged" if digest == last else "changed"))
            last, seen = digest, ms
        state.update((last, seen))
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + forget_ms)
        yield pd.DataFrame(out, columns=["url", "fetched_at", "digest", "change"])

    return small.groupBy("url").applyInPandasWithState(step, "url string, fetched_at timestamp, digest string, change string", "digest string, seen bigint", "append", GroupStateTimeout.EventTimeTimeout)


def per_window(fetched: DataFrame, *, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, host, fetches) by tumbling windows of event time."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1)
    return fetched.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", window), host.alias("host")).agg(F.count("*").alias("fetches")).select(F.col("window.start").alias("start"), "host", "fetches")
