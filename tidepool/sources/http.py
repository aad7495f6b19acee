"""Live pages as a Spark data source: `spark.read.format("tidepool_http").schema(LIVE)` with option urls (JSON list).

URLs of one host stay in one partition, so that a host is asked by one task at a time. Addresses are checked where the request is made: every
address that a name resolves to must be public unless allow_private is set.
"""

from __future__ import annotations

import http.client
import json
import socket
import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidepool.functions.addresses import classify
from tidepool.runtime import ensure_workers
from tidepool.sources.stores import LIVE


class _Host(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        super().__init__(0)
        self.urls = urls


def checked_address(host: str, port: int, allow_private: bool) -> str:
    found = {a[4][0] for a in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)}
    if not found:
        raise OSError(f"{host} has no address")
    for address in sorted(found):
        reason = classify(address.partition("%")[0])
        if reason and not allow_private:
            raise OSError(f"{host} resolves to {address}: {reason}")
    return sorted(found)[0]


def fetch(url: str, *, timeout: float, most_bytes: int, allow_private: bool, etag: str | None = None) -> tuple:
    """One response as a row of a live store; status is null if there was none. Of a body that is too large, one byte more than may be is kept, which tells."""
    parts = urlsplit(url)
    port = parts.port or (443 if parts.scheme == "https" else 80)
    try:
        address = checked_address(parts.hostname, port, allow_private)
        if parts.scheme == "https":
            import ssl

            connection = http.client.HTTPSConnection(parts.hostname, port, timeout=timeout, context=ssl.create_default_context())
        else:
            connection = http.client.HTTPConnection(parts.hostname, port, timeout=timeout)
        connection._create_connection = lambda _to, *a, **k: socket.create_connection((address, port), *a, **k)
        try:
            headers = {"User-Agent": "tidepool"} | ({"If-None-Match": etag} if etag else {})
            connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers=headers)
            answer = connection.getresponse()
            body = answer.read(most_bytes + 1)
            text = body.decode("utf-8", "replace")
            return (url, answer.status, answer.getheader("Content-Type"), text, answer.getheader("Location"), answer.getheader("ETag"), text.encode() == body)
        finally:
            connection.close()
    except (OSError, http.client.HTTPException):
        return (url, None, None, None, None, None, None)


def live(*, timeout_ms: int = 30_000, most_bytes: int = 10 << 20, allow_private: bool = False, delay_ms: int = 0) -> Callable[[DataFrame], DataFrame]:
    """A live store: fetches a table of URLs (url) on the executors. URLs of a host are in one partition, asked one after another, delay_ms apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                rows.append(fetch(url, timeout=timeout_ms / 1000, most_bytes=most_bytes, allow_private=allow_private))
                time.sleep(delay_ms / 1000)
            out = pd.DataFrame(rows, columns=["url", "status", "content_type", "body", "location", "etag", "utf8"])
            yield out.astype({"status": "Int32", "utf8": "boolean"})

    def store(urls: DataFrame) -> DataFrame:
        ensure_workers(urls.sparkSession)
        return urls.select("url").repartition(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1)).mapInPandas(run, LIVE)

    return store


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options["urls"])
        self.timeout = float(options.get("timeout", "30"))
        self.most_bytes = int(options.get("max_body_size", str(10 << 20)))
        self.allow_private = options.get("allow_private", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        by: dict[str, list[str]] = defaultdict(list)
        for u in self.urls:
            by[urlsplit(u).netloc].append(u)
        return [_Host(v) for v in by.values()] or [_Host([])]

    def read(self, partition: _Host) -> Iterator[tuple]:
        for url in partition.urls:
            yield fetch(url, timeout=self.timeout, most_bytes=self.most_bytes, allow_private=self.allow_private)


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidepool_http"

    def schema(self) -> str:
        return LIVE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
