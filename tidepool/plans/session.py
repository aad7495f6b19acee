"""Runs that leave a corpus in a folder, go on where the last one ended, and can be searched.

A corpus folder holds, for each run N, manifest/run=N and errors/run=N (JSON lines), pages/run=N (Parquet), frontier/N (the state after it), and the
derived files index, summary, graph and full, beside the fingerprint of its options and the version of its frontiers. A run writes its own files first and its frontier last, so one that fails is done again from the
frontier before it, under the same number, and overwrites what it left.
"""

from __future__ import annotations

import json
import signal
import sys
import threading
import time
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepool.config import Command, Config, help_text, parse_args
from tidepool.functions.urls import host_slug
from tidepool.operators import corpus, derive, search
from tidepool.operators import frontier as fr
from tidepool.operators.crawl import Crawl, crawl
from tidepool.runtime import discard, materialise
from tidepool.sources import http
from tidepool.sources.stores import read_lines, write_documents, write_lines

VERSION = "0.1.0"
RUNS = "url string, written bigint, failed bigint, skipped bigint, pending bigint, changed bigint, unchanged bigint, truncated boolean"


#: Of a folder's frontiers; it grows with their columns.
STATE_VERSION = 1


class FingerprintMismatch(ValueError):
    pass


class StateVersionError(ValueError):
    pass


class _Folder:
    """Paths of a corpus folder through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def has(self, name: str) -> bool:
        return self.fs.exists(self._path(self.at(name)))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(self.at(name)))] if self.has(name) else []

    def remove(self) -> None:
        self.fs.delete(self._path(self.root), True)


def _migrated(frontier: DataFrame) -> DataFrame:
    """A frontier of this or an earlier version, with the columns of this one."""
    have = set(frontier.columns)
    return frontier.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(fr.SCHEMA)])


def run_one(spark: SparkSession, store, url: str, config: Config, root: str, *, now: int = 0, clock: Callable[[], int] | None = None, stop: Callable[[], bool] | None = None) -> Crawl:
    """Crawls one URL into a corpus folder; goes on with the folder's frontier unless config.fresh."""
    folder = _Folder(spark, root)
    if config.fresh:
        folder.remove()
    print_of = config.fingerprint(url)
    version = int(spark.read.text(folder.at("version")).head()[0]) if folder.has("version") else 0
    if version > STATE_VERSION:
        raise StateVersionError(f"{root} has frontiers of version {version}, newer than {STATE_VERSION}")
    runs = sorted((int(n) for n in folder.names("frontier") if n.isdigit() and folder.has(f"frontier/{n}/_SUCCESS")), reverse=True)
    known = None
    if folder.has("fingerprint"):
        stored = spark.read.text(folder.at("fingerprint")).head()[0]
        if stored != print_of:
            raise FingerprintMismatch(f"{root} belongs to a run with other options ({stored} instead of {print_of})")
        if runs:
            known = _migrated(spark.read.parquet(folder.at(f"frontier/{runs[0]}")))
    else:
        spark.createDataFrame([(print_of,)], "value string").coalesce(1).write.text(folder.at("fingerprint"))
    done = crawl(spark, store, url, config, now=now, known=known, clock=clock, stop=stop)
    run = (runs or [0])[0] + 1
    commit(spark, folder, done.corpus, run)
    if not done.errors.isEmpty():
        write_lines(done.errors, folder.at(f"errors/run={run}"))
    if version < STATE_VERSION:
        spark.createDataFrame([(str(STATE_VERSION),)], "value string").coalesce(1).write.mode("overwrite").text(folder.at("version"))
    done.frontier.write.mode("overwrite").parquet(folder.at(f"frontier/{run}"))
    publish(spark, root)
    return done


def _manifest(spark: SparkSession, folder: _Folder, *, before: int | None = None, strict: bool = True) -> DataFrame:
    """The manifest of all runs, or of those before one."""
    runs = [n for n in folder.names("manifest") if before is None or int(n.removeprefix("run=")) < before]
    if not runs:
        return spark.createDataFrame([], corpus.MANIFEST)
    parts = [read_lines(spark, folder.at(f"manifest/{n}"), corpus.MANIFEST, strict=strict) for n in runs]
    return reduce(DataFrame.unionByName, parts)


def commit(spark: SparkSession, folder: _Folder, pages: DataFrame, run: int) -> None:
    """Writes a run's pages that are new to the manifest; equal ones are left as they are, and others are a conflict."""
    made = corpus.manifest(pages)
    kinds = materialise(corpus.classify_commit(made, _manifest(spark, folder, before=run)), "commits")
    bad = kinds.where("commit IN ('conflict', 'unsafe_path')").select("canonical_url", "commit").head()
    if bad:
        raise ValueError(f"{bad['canonical_url']}: {bad['commit']}")
    new = kinds.where("commit = 'new'").drop("commit")
    if not new.isEmpty():
        own = pages.join(new.select("canonical_url", "output_path"), "canonical_url")
        write_documents(own.select("canonical_url", "output_path", "document"), folder.at(f"pages/run={run}"))
        write_lines(new, folder.at(f"manifest/run={run}"))
    discard(kinds)


def open_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(canonical_url, output_path, depth, description, document) of a corpus folder."""
    folder = _Folder(spark, root)
    if not folder.has("manifest"):
        raise FileNotFoundError(f"no corpus in {root}")
    return _manifest(spark, folder, strict=False).join(spark.read.parquet(folder.at("pages")).select("canonical_url", "document"), "canonical_url")


def publish(spark: SparkSession, root: str) -> None:
    """The derived files of a corpus folder; none of an empty corpus."""
    folder = _Folder(spark, root)
    if not folder.has("manifest"):
        return
    manifest, pages = _manifest(spark, folder), open_corpus(spark, root)
    derive.write_lines(derive.page_index(manifest), derive.INDEX_HEAD, folder.at("index"))
    derive.write_lines(derive.summary_index(manifest), derive.SUMMARY_HEAD, folder.at("summary"))
    derive.graph_lines(derive.link_graph(pages)).withColumnRenamed("line", "value").write.mode("overwrite").text(folder.at("graph"))
    full = derive.concatenated(manifest, pages)
    if full is not None:
        full.write.mode("overwrite").text(folder.at("full"))


def run(spark: SparkSession, store, urls: list[str], config: Config, *, now: int = 0, clock: Callable[[], int] | None = None, stop: Callable[[], bool] | None = None) -> DataFrame:
    """Crawls each URL, into a folder of its own by host or into one for all; the report of all runs and their totals."""
    rows = []
    for k, url in enumerate(urls):
        slug = spark.range(1).select(host_slug(F.lit(url))).head()[0]
        root = config.output if config.merge or len(urls) == 1 else f"{config.output.rstrip('/')}/{slug}"
        own = replace(config, fresh=config.fresh and (k == 0 or not config.merge))
        rows.append(run_one(spark, store, url, own, root, now=now, clock=clock, stop=stop).row())
    return derive.report(spark.createDataFrame(rows, RUNS))


def main(args: list[str], spark: SparkSession | None = None) -> int:
    """The command line: 0 all done, 1 in part, 2 wrong usage or no corpus, 3 anything that ends a run."""
    try:
        command: Command = parse_args(args)
    except ValueError as e:
        print(f"error: {e}")
        return 2
    if command.kind in ("help", "version"):
        print(help_text() if command.kind == "help" else f"tidepool {VERSION}")
        return 0
    spark = spark or SparkSession.builder.appName("tidepool").getOrCreate()
    if command.kind == "search":
        try:
            pages = open_corpus(spark, command.directory)
        except FileNotFoundError as e:
            print(f"error: {e}")
            return 2
        if command.mode == "separate" and not command.json:
            print(search.format_separate(pages, command.query, command.directory), end="")
        else:
            hits = search.search_mode(pages, command.query, command.mode)
            print(json.dumps([r.asDict() for r in hits.collect()]) if command.json else search.format_text(hits, command.directory), end="\n" if command.json else "")
        return 0
    c = command.config
    store = http.live(timeout_ms=c.timeout_ms, most_bytes=c.max_body_size, allow_private=c.allow_private_network, delay_ms=c.delay_ms)
    clock = lambda: int(time.time() * 1000)
    interrupted = threading.Event()
    try:
        before = signal.signal(signal.SIGINT, lambda *_: interrupted.set())
    except ValueError:  # only the main thread hears signals
        before = None
    try:
        # a live crawl takes a batch at a time, so that its budget is checked after each
        report = run(spark, store, command.urls, replace(c, batch_mode="exact"), now=clock(), clock=clock, stop=interrupted.is_set).orderBy(F.col("url").asc_nulls_last()).collect()
    except Exception as e:  # noqa: BLE001 - said and told by the exit code
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 3
    finally:
        if before is not None:
            signal.signal(signal.SIGINT, before)
    for r in report:
        print(json.dumps(r.asDict()) if c.report == "json" else f"{r['url'] or 'total'}: {r['written']} written, {r['failed']} failed, {r['skipped']} skipped, {r['pending']} pending" + (" (truncated)" if r["truncated"] else ""))
    return max(r["exit_code"] for r in report)
