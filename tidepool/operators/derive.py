"""What is derived from a corpus: page index, summary index, concatenation, link graph, run report."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import truncate_summary
from tidepool.runtime import discard, materialise

MOST_CONCATENATED = 10_000
INDEX_HEAD = ["# Crawl index", "", "One line per page: `[url](file)` (depth) — summary.", ""]
SUMMARY_HEAD = ["# Crawl corpus", ""]


def index_line() -> Column:
    line = F.concat(F.lit("- ["), "canonical_url", F.lit("]("), "output_path", F.lit(") ("), F.col("depth").cast("string"), F.lit(")"))
    return F.when(F.col("description") == "", line).otherwise(F.concat(line, F.lit(" — "), "description"))


def page_index(manifest: DataFrame) -> DataFrame:
    """(position, line) of the page index, by URL, path, depth, description."""
    return _numbered(manifest, ["canonical_url", "output_path", "depth", "description"], index_line())


def summary_index(manifest: DataFrame) -> DataFrame:
    """(position, line) of the summary index, by depth, then URL; descriptions are cut once more."""
    cut = truncate_summary(F.col("description"), 150)
    line = F.concat(F.lit("- ["), "canonical_url", F.lit("]("), "output_path", F.lit(")"))
    return _numbered(manifest, ["depth", "canonical_url"], F.when(cut == "", line).otherwise(F.concat(line, F.lit(": "), cut)))


def _numbered(manifest: DataFrame, order: list[str], line: Column) -> DataFrame:
    """Lines with their places in the whole order: ranges are sorted apart, and each takes the count of those before it as its start.

    Lines are written before they are sorted, and sorted ranges before they are counted, so each is worked out once.
    """
    spark = manifest.sparkSession
    plain = materialise(manifest.select(*order, line.alias("line")), "lines")
    ranged = materialise(plain.orderBy(*order).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), "line"), "ranges")
    discard(plain)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy("p").agg(F.count("*").alias("n")).collect()}  # one row per range
    total, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    offsets = spark.createDataFrame(starts, "p int, start bigint")
    return ranged.join(F.broadcast(offsets), "p").select((F.col("start") + F.col("i") % (1 << 33)).cast("bigint").alias("position"), "line")


def write_lines(lines: DataFrame, head: list[str], path: str) -> None:
    """A folder of text files whose parts, one after another, are head and lines in their order; an empty table writes nothing."""
    if lines.isEmpty():
        return
    first = lines.sparkSession.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "position bigint, line string")
    first.unionByName(lines).orderBy("position").select("line").write.mode("overwrite").text(path)


def concatenation(manifest: DataFrame, documents: DataFrame) -> Iterator[str]:
    """All documents one after another, by depth, then URL, as parts of a text that is never held whole; nothing beyond MOST_CONCATENATED pages."""
    if manifest.limit(MOST_CONCATENATED + 1).count() > MOST_CONCATENATED:
        return
    both = manifest.select("canonical_url", "depth").join(documents.select("canonical_url", "document"), "canonical_url").orderBy("depth", "canonical_url")
    for r in both.toLocalIterator():
        yield f"# {r['canonical_url']}\nurl: {r['canonical_url']}\n\n{r['document']}\n\n---\n\n"


def concatenated(manifest: DataFrame, documents: DataFrame) -> DataFrame | None:
    """The same, as one row (line) per page in order; None beyond MOST_CONCATENATED pages."""
    if manifest.limit(MOST_CONCATENATED + 1).count() > MOST_CONCATENATED:
        return None
    both = manifest.select("canonical_url", "depth").join(documents.select("canonical_url", "document"), "canonical_url").orderBy("depth", "canonical_url")
    return both.select(F.concat(F.lit("# "), "canonical_url", F.lit("\nurl: "), "canonical_url", F.lit("\n\n"), "document", F.lit("\n\n---\n")).alias("line"))


def link_targets(document: Column) -> Column:
    """Targets of a document's Markdown links that are absolute http URLs, one for each time one stands there."""
    chunks = F.split(document, r"\]\(")
    closed = F.filter(F.slice(chunks, 2, F.size(chunks)), lambda c: c.contains(")"))
    return F.filter(F.transform(closed, lambda c: F.substring_index(c, ")", 1)), lambda t: t.startswith("http"))


def link_graph(corpus: DataFrame) -> DataFrame:
    """(url, inbound, outbound) of every page of a corpus (canonical_url, document); inbound counts links whose target, without its
    fragment, is the page."""
    targets = corpus.select("canonical_url", link_targets(F.col("document")).alias("targets"))
    to = targets.select(F.explode("targets").alias("t")).select(F.substring_index("t", "#", 1).alias("canonical_url")).groupBy("canonical_url").agg(F.count("*").alias("inbound"))
    return targets.select("canonical_url", F.size("targets").cast("bigint").alias("outbound")).join(to, "canonical_url", "left").select(F.col("canonical_url").alias("url"), F.coalesce("inbound", F.lit(0)).cast("bigint").alias("inbound"), "outbound")


def graph_lines(graph: DataFrame) -> DataFrame:
    """The graph as JSON lines with keys in alphabetical order, sorted as text."""
    return graph.select(F.to_json(F.struct("inbound", "outbound", "url")).alias("line")).orderBy("line")


REPORT = ("written", "failed", "skipped", "pending", "changed", "unchanged")


def report(runs: DataFrame) -> DataFrame:
    """runs (url, the counters of REPORT, truncated) and a row of totals, whose url is null; exit_code of each by itself."""
    sums = runs.rollup("url").agg(*[F.sum(c).cast("bigint").alias(c) for c in REPORT], F.bool_or("truncated").alias("truncated"))
    partial = F.col("truncated") | (F.col("pending") > 0) | ((F.col("written") == 0) & (F.col("failed") > 0))
    return sums.withColumn("exit_code", F.when(partial, 1).otherwise(0))
