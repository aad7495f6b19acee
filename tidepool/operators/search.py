"""Weighted search over corpus documents, and the relevance of pages to what a crawl is for.

A page's score needs its own lines only, so it is worked out in place by array expressions: no explode, no shuffle before the top rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import let, lines, trim

MOST_RESULTS, MOST_SNIPPETS, SNIPPET_CHARS = 20, 5, 120
HEADING, BODY, TITLE = 4, 1, 10
HITS = "url string, path string, title string, score bigint, matches array<string>, queries array<int>"


def parse_queries(text: str) -> list[list[str]]:
    """Queries are separated by commas, their terms by space; empty ones are none."""
    return [q for q in (part.lower().split() for part in text.split(",")) if q]


def document_title(document: Column) -> Column:
    """The title in a document's front matter; null without one."""
    pattern = r"^---\r?\n(?:(?!---\r?(?:\n|\z)|title:)[^\n]*\n)*title:([^\n]*)"
    return F.when(document.rlike(pattern), F.regexp_replace(trim(F.regexp_extract(document, pattern, 1)), '^"+|"+$', ""))


def _matched(text: Column, terms: list[str]) -> Column:
    return reduce(add, [F.when(text.contains(t), 1).otherwise(0) for t in terms])


def _hit(low: Column, body: Column, path: Column, low_title: Column, terms: list[str]) -> Column:
    """struct<score, matches> of one query; null if the page doesn't match it."""
    found = F.filter(F.transform(body, lambda x: F.struct(x["n"].alias("n"), x["t"].alias("t"), _matched(x["l"], terms).alias("m"))), lambda x: x["m"] > 0)

    def use(found: Column) -> Column:
        score = F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + x["m"] * F.when(x["t"].startswith("#"), HEADING).otherwise(BODY)) + TITLE * _matched(low_title, terms)
        snippets = F.transform(F.slice(found, 1, MOST_SNIPPETS), lambda x: F.concat(path, F.lit(":"), (x["n"] + 1).cast("string"), F.lit(": "), F.substring(x["t"], 1, SNIPPET_CHARS)))
        return F.when(F.size(found) > 0, F.struct(score.alias("score"), snippets.alias("matches")))

    return F.when(reduce(and_, [low.contains(t) for t in terms]), let(found, use))


def score(corpus: DataFrame, queries: list[list[str]]) -> DataFrame:
    """(url, path, title, q array<struct<score, matches>>) of the pages that match a query. corpus: canonical_url, output_path, document."""
    doc = F.col("document")
    # cheap whole-text test first: most pages match nothing
    some = F.exists(F.array(F.lower(doc)), lambda low: reduce(or_, [reduce(and_, [low.contains(t) for t in q]) for q in queries]))
    title = F.coalesce(document_title(doc), F.col("canonical_url"))
    ready = corpus.where(some).select(F.col("canonical_url").alias("url"), F.col("output_path").alias("path"), title.alias("title"), "document")
    numbered = F.transform(lines(doc), lambda x, i: F.struct(i.alias("n"), trim(x).alias("t")))
    numbered = F.filter(numbered, lambda x: (x["n"] >= 4) & ~x["t"].startswith("title:"))
    body = F.transform(numbered, lambda x: F.struct(x["n"].alias("n"), x["t"].alias("t"), F.lower(x["t"]).alias("l")))
    hits = let(F.struct(F.lower(doc).alias("low"), F.lower("title").alias("title"), body.alias("body")), lambda v: F.array(*[_hit(v["low"], v["body"], F.col("path"), v["title"], q) for q in queries]))
    # as a generator, the scores are worked out once and no filter on them is pushed below
    return ready.select("url", "path", "title", F.explode(F.filter(F.array(hits), lambda q: F.exists(q, lambda x: x.isNotNull()))).alias("q"))


def _combined(scored: DataFrame) -> DataFrame:
    kept = F.filter(F.transform("q", lambda x, i: F.struct(i.alias("i"), x.alias("h"))), lambda x: x["h"].isNotNull())
    return scored.select(
        "url", "path", "title", F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x["h"]["score"]).alias("score"),
        F.flatten(F.transform(kept, lambda x: x["h"]["matches"])).alias("matches"), F.transform(kept, lambda x: x["i"]).alias("queries"),
    )


def search(corpus: DataFrame, text: str) -> DataFrame:
    """The best pages for any of the queries, best first, then by path."""
    queries = parse_queries(text)
    if not queries:
        return corpus.sparkSession.createDataFrame([], HITS)
    return _combined(score(corpus, queries)).orderBy(F.desc("score"), "path").limit(MOST_RESULTS)


def search_mode(corpus: DataFrame, text: str, mode: str = "combined") -> DataFrame:
    """`combined`: as search. `all`: those of its results that match every comma-separated part (blank parts match nothing). `separate`: the best
    pages of each query by itself, with its number in `query`; one scan for all queries."""
    if mode == "combined":
        return search(corpus, text)
    if mode == "all":
        return search(corpus, text).where(F.size("queries") == len(text.split(",")))
    if mode != "separate":
        raise ValueError("mode is combined, separate or all")
    queries = parse_queries(text)
    if not queries:
        return corpus.sparkSession.createDataFrame([], f"query int, {HITS}")
    from pyspark.sql import Window

    each = score(corpus, queries).select("url", "path", "title", F.posexplode("q").alias("query", "h")).where("h IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("h.score"), "path"))
    top = each.withColumn("rank", rank).where(F.col("rank") <= MOST_RESULTS)
    return top.orderBy("query", "rank").select("query", "url", "path", "title", "h.score", "h.matches", F.array(F.lit(0)).alias("queries"))


def format_text(hits: DataFrame, directory: str) -> str:
    """Search results as text for a terminal."""
    out = []
    for h in hits.collect():  # at most MOST_RESULTS rows a query
        tag = "" if list(h["queries"]) == [0] else f" [q{','.join(str(i + 1) for i in h['queries'])}]"
        out.append(f"{h['score']}{tag}  {directory.rstrip('/')}/{h['path']}  {h['title']}\n" + "".join(f"    {m}\n" for m in h["matches"]))
    return "".join(out) or "no matches\n"


def format_separate(corpus: DataFrame, text: str, directory: str) -> str:
    parts = [p.strip() for p in text.split(",")]
    return "".join(f"== {p} ==\n{format_text(search(corpus, p), directory)}" for p in parts if p)


def relevance(title: Column, markdown: Column, queries: list[list[str]]) -> Column:
    """How well a page fits the best of the queries, all of whose terms it must have; 1 for every page if there are none."""
    if not queries:
        return F.lit(1).cast("bigint")
    low, low_title = F.lower(markdown), F.lower(title)
    scores = []
    for q in filter(None, queries):
        every = reduce(and_, [low.contains(t) | low_title.contains(t) for t in q])
        body = F.aggregate(lines(markdown), F.lit(0).cast("bigint"), lambda a, x: a + _matched(F.lower(trim(x)), q) * F.when(trim(x).startswith("#"), HEADING).otherwise(BODY))
        scores.append(F.when(every, TITLE * _matched(low_title, q) + body).otherwise(0))
    return F.greatest(F.lit(0), *scores).cast("bigint") if scores else F.lit(0).cast("bigint")
