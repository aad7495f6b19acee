from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidepool.operators import corpus, derive, search
from tidepool.sources import stores


def pages(spark):
    body = "# Alpha heading\n\nalpha beta line\nbeta only\ntitle: alpha hidden\n"
    rows = [("https://e.example/a", 0, 'The "Alpha" page', body), ("https://e.example/b", 1, "Other", "alpha here\n"), ("https://e.example/c", 1, "Alpha beta", "nothing of note\n")]
    df = spark.createDataFrame(rows, "canonical_url string, depth int, title string, markdown string")
    return df.select("*", F.col("canonical_url").alias("final_url"), F.lit(200).alias("status_code"), F.lit("d").alias("description"), corpus.build_document(F.col("canonical_url"), F.col("canonical_url"), F.col("title"), F.col("markdown")).alias("document"))


def indexed(spark):
    p = pages(spark)
    return p.join(corpus.manifest(p).select("canonical_url", "output_path"), "canonical_url")


def test_document_form(spark):
    doc = pages(spark).where("depth = 0").head()["document"]
    assert doc.startswith('---\nurl: https://e.example/a\nfinal_url: https://e.example/a\ntitle: "The \\"Alpha\\" page"\n---\n\n# Alpha') and doc.endswith("hidden\n")


def test_scores(spark):
    hits = {r["url"]: r for r in search.search(indexed(spark), "alpha").collect()}
    # heading 4 + line 1 + title 10; the line of another title isn't counted
    assert hits["https://e.example/a"]["score"] == 15 and hits["https://e.example/b"]["score"] == 1 and "https://e.example/c" not in hits
    both = search.search(indexed(spark), "alpha beta").collect()
    assert [r["url"] for r in both] == ["https://e.example/a"] and both[0]["score"] == 4 + 2 + 1 + 10
    assert both[0]["matches"][0].endswith(":7: # Alpha heading")


def test_modes(spark):
    c = indexed(spark)
    two = search.search(c, "alpha, beta").collect()
    assert two[0]["queries"] == [0, 1] and [r["url"] for r in search.search_mode(c, "alpha, beta", "all").collect()] == ["https://e.example/a"]
    assert search.search_mode(c, "alpha,, beta", "all").count() == 0 and search.search(c, " , ").count() == 0
    separate = search.search_mode(c, "alpha, beta", "separate").collect()
    assert [(r["query"], r["url"][-1]) for r in separate] == [(0, "a"), (0, "b"), (1, "a")]
    text = search.format_text(search.search(c, "alpha, beta"), "/out/")
    assert text.splitlines()[0].split("  ")[0] == f"{two[0]['score']} [q1,2]" and search.format_text(search.search(c, "zzz"), "o") == "no matches\n"
    assert search.format_separate(c, "alpha, zzz", "o").count("== ") == 2
    with pytest.raises(ValueError):
        search.search_mode(c, "x", "other")


def test_relevance(spark):
    row = lambda q: spark.range(1).select(search.relevance(F.lit("Alpha page"), F.lit("# alpha\nbeta alpha\n"), q).alias("x")).head()["x"]
    assert row([]) == 1 and row([["alpha", "beta"]]) == 10 + 4 + 2 and row([["gamma"]]) == 0 and row([[]]) == 0 and row([["gamma"], ["beta"]]) == 1


def test_commits(spark):
    made = corpus.manifest(pages(spark))
    assert {r["commit"] for r in corpus.classify_commit(made, made.where("false")).collect()} == {"new"}
    assert {r["commit"] for r in corpus.classify_commit(made, made).collect()} == {"duplicate"}
    assert {r["commit"] for r in corpus.classify_commit(made, made.withColumn("bytes", F.col("bytes") + 1)).collect()} == {"conflict"}
    assert {r["commit"] for r in corpus.classify_commit(made.withColumn("output_path", F.lit("../outside.md")), made).collect()} == {"unsafe_path"}
    assert all(r["verified"] for r in corpus.verified(made, pages(spark)).collect())
    assert not any(r["verified"] for r in corpus.verified(made.withColumn("digest", F.lit("0")), pages(spark)).collect())
    one = lambda t: spark.range(1).select(corpus.unterminated_removed(F.lit(t)).alias("x")).head()["x"]
    assert one('{"a":1}\n{"b"') == '{"a":1}\n' and one("x\n") == "x\n" and one("cut") == ""


def test_derived_files(spark, tmp_path):
    made = corpus.manifest(pages(spark)).withColumn("description", F.when(F.col("depth") == 0, "").otherwise("words"))
    index = [r["line"] for r in derive.page_index(made).orderBy("position").collect()]
    assert index[0].endswith(".md) (0)") and index[1].endswith(".md) (1) — words") and [r["position"] for r in derive.page_index(made).orderBy("position").collect()] == [0, 1, 2]
    derive.write_lines(derive.page_index(made), derive.INDEX_HEAD, f"{tmp_path}/index")
    text = [r["value"] for r in spark.read.text(f"{tmp_path}/index").collect()]
    assert text == derive.INDEX_HEAD + index
    assert [r["line"].endswith(": words") for r in derive.summary_index(made).orderBy("position").collect()] == [False, True, True]
    whole = list(derive.concatenation(made, pages(spark)))
    assert len(whole) == 3 and whole[0].startswith("# https://e.example/a\nurl: https://e.example/a\n\n---\n")


def test_link_graph(spark):
    rows = [("https://e.example/a", "[x](https://e.example/b#f) ![i](https://e.example/b) [y](rel) [z](https://e.example/a"), ("https://e.example/b", '[t](https://e.example/a "title") [q](https://e.example/a?x) [s](https://e.example/b)')]
    graph = derive.link_graph(spark.createDataFrame(rows, "canonical_url string, document string"))
    assert {r["url"][-1]: (r["inbound"], r["outbound"]) for r in graph.collect()} == {"a": (0, 2), "b": (3, 3)}
    assert [json.loads(r["line"])["url"][-1] for r in derive.graph_lines(graph).collect()] == ["a", "b"]


def test_report(spark):
    rows = [("u", 2, 0, 1, 0, 2, 0, False), ("v", 0, 3, 0, 0, 0, 0, False)]
    got = {r["url"]: (r["written"], r["failed"], r["exit_code"]) for r in derive.report(spark.createDataFrame(rows, "url string, written bigint, failed bigint, skipped bigint, pending bigint, changed bigint, unchanged bigint, truncated boolean")).collect()}
    assert got == {"u": (2, 0, 0), "v": (0, 3, 1), None: (2, 3, 0)}


def test_stores_round_trip(spark, tmp_path):
    made = corpus.manifest(pages(spark))
    stores.write_lines(made.unionByName(made), f"{tmp_path}/m")
    assert stores.read_lines(spark, f"{tmp_path}/m", corpus.MANIFEST).distinct().count() == 3
    stores.write_documents(pages(spark).select("canonical_url", "document"), f"{tmp_path}/c")
    stores.write_documents(pages(spark).select("canonical_url", "document"), f"{tmp_path}/c")  # over the first ones
    assert spark.read.parquet(f"{tmp_path}/c").count() == 3


def test_fetch_errors(spark):
    rows = [(None, None, "x", "network"), (404, "text/html", "x", "status"), (200, "image/png", "x", "content_type"), (200, None, "x", None), (200, "Text/HTML; charset=x", "x" * 11, "body_too_large"), (200, "application/xhtml+xml", "ok", None)]
    df = spark.createDataFrame(rows, "s int, t string, b string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", stores.fetch_error(F.col("s"), F.col("t"), F.col("b"), 10)).collect())
    sniff = spark.createDataFrame([(" <!DOCTYPE html>", True), ("<p><HTML>", True), ("plain", False), ("x" * 1024 + "<html", False)], "b string, want boolean")
    assert all(r["got"] == r["want"] for r in sniff.withColumn("got", stores.looks_like_html(F.col("b"))).collect())
