from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidepool.functions import text
from tidepool.functions.html import ExtractError, Limits, extract
from tidepool.operators.extract import extract_pages

BASE = "https://example.com/root/page"


#: What a piece of a page is in Markdown.
PIECES = [
    ("<h2>Neap <i>tides</i></h2>", "## Neap *tides*"),
    ("<p>Low water at <b>six</b>,\n  high at   noon.</p>", "Low water at **six**, high at noon."),
    ("<p>Use <code>a`b</code> and 2*3_4</p>", "Use ``a`b`` and 2\\*3\\_4"),
    ("<blockquote><p>Time and tide</p><p>wait</p></blockquote>", "> Time and tide\n>\n> wait"),
    ("<ul><li>ebb<ol start=7><li>first<li>second</ol><li>flow</ul>", "*   ebb\n    7.  first\n    8.  second\n*   flow"),
    ("<pre><code class='x language-sql'>SELECT 1;\n  -- tide\n</code></pre>", "```sql\nSELECT 1;\n  -- tide\n```"),
    ("<table><tr><th>Port<th>m<tr><td>Brest<td>7<tr><td>St | Malo</table>", "| Port       | m   |\n| ---------- | --- |\n| Brest      | 7   |\n| St \\| Malo |     |"),
    ("<hr>", "* * *"),
    ("<div>loose <span>text</span><div>nested</div>after</div>", "loose text\n\nnested\n\nafter"),
    ("<p>a &lt;tag&gt; &copy; &eacute; 1 &lt 2</p>", "a <tag> © é 1 < 2"),
    ("<p>kept<script>if (a </p> b) x()</script><style>p{}</style><!-- <p>no --></p>", "kept"),
]


def test_pieces_and_their_sequences():
    rng = random.Random(4)
    for source, want in PIECES:
        assert extract(source, BASE).markdown == want + "\n"
    for _ in range(200):
        chosen = rng.choices(PIECES, k=4)
        assert extract("<main>" + "\n".join(c[0] for c in chosen) + "</main><p>outside", BASE).markdown == "\n\n".join(c[1] for c in chosen) + "\n"


@pytest.mark.parametrize("tag", ["aside", "dialog", "footer", "form", "header", "iframe", "nav", "noscript", "template"])
def test_parts_left_out(tag):
    page = extract(f"<p>in</p><{tag}><a href='/gone'>out</a></{tag}><p>too</p>", BASE)
    assert page.markdown == "in\n\ntoo\n" and page.links == []


def test_content_root():
    parts = {n: f"<p>{n}</p>" for n in ("before", "inner", "after")}
    page = lambda inner: extract(parts["before"] + inner + parts["after"], BASE).markdown
    everything = "before\n\ninner\n\nafter\n"
    assert page(f"<main>{parts['inner']}</main>") == page(f"<article>{parts['inner']}</article>") == "inner\n"
    assert page(f"<section>{parts['inner']}</section>") == page(f"<article>{parts['inner']}</article><article></article>") == everything
    assert page(f"<article>no</article><main>{parts['inner']}</main>") == "inner\n"


def test_left_open_and_crossed():
    assert extract("<p>x<b>y<p>z</b>w", BASE).markdown == "x**y**\n\n**z**w\n"
    assert extract("<h1>a<h2>b<p>c", BASE).markdown == "# a\n\n## b c\n"
    assert extract("<table><tr><td><b>a<td>b</table>", BASE).markdown == "| **a** | b   |\n| ----- | --- |\n"
    assert extract("<p>" + "<i>" * 9 + "a<p>b", BASE).markdown.endswith("\n\n***b***\n"), "three alike stay in force"
    assert extract("<p>end<a href='/x", BASE).markdown == "end\n" and extract("a <3 b", BASE).markdown == "a <3 b\n"


def test_deep_and_broken_pages_take_time_in_proportion():
    import time

    whole = [f"<{t}>" * 50_000 + "x" for t in ("div", "b", "span", "blockquote", "ul><li", "table><tr><td", "p><b", "a href=/")]
    broken = ["<a " * 50_000, "<!--" * 50_000, "<a href='" * 50_000, "</" * 50_000, "<b><div>" * 25_000 + "</b>" * 25_000, "<pre>" + " " * 200_000 + "x"]
    for source in whole + broken:
        begin = time.process_time()
        try:
            extract(source, BASE)
        except ExtractError as e:
            assert e.kind == "output_too_large"
        assert time.process_time() - begin < 5, source[:20]
    assert extract("<div>" * 3000 + "deep" + "</div>" * 3000, BASE).markdown == "deep\n"


def test_links_are_resolved_in_order_and_once():
    targets = ["tide", "/tide", "../tide", "?m=1", "#low", "//port.example/a", "https://port.example/b#c", "/tide", "mailto:x@port.example", "javascript:0", "data:,x", "http://[", ""]
    page = extract("<base href='/sea/level/'>" + "".join(f"<a href='{t}'>{k}</a> " for k, t in enumerate(targets)) + "<img src='moon.png' alt='Moon' title='new'>", BASE)
    from urllib.parse import urljoin

    want = list(dict.fromkeys(urljoin("https://example.com/sea/level/", t) for t in targets if not t.startswith(("mailto", "java", "data", "http://["))))
    assert page.links == want
    for k, t in enumerate(targets):
        assert (f"[{k}](" in page.markdown) == (not t.startswith(("mailto", "java", "data", "http://[")))
    assert '![Moon](https://example.com/sea/level/moon.png "new")' in page.markdown


def test_one_bad_page_does_not_end_the_job(spark, monkeypatch):
    rows = [(BASE, "<div>" * 5000 + "x"), (BASE, "<p>fine"), ("no url", "<p>x"), (None, None)]
    got = extract_pages(spark.createDataFrame(rows, "url string, html string")).collect()
    assert [r["markdown"] for r in got] == ["x\n", "fine\n", None, None] and [r["extract_error"] for r in got][2:] == ["invalid_base_url"] * 2


@pytest.mark.parametrize("html, limits, kind", [("ß" * 8, Limits(15), "input_too_large"), ("<p>" + "tide " * 9, Limits(100, 20), "output_too_large"), ("".join(f"<a href={i}>" for i in range(4)), Limits(max_links=3), "too_many_links"), ("x", Limits(max_output_bytes=0), "invalid_limit")])
def test_limits(spark, html, limits, kind):
    with pytest.raises(ExtractError) as e:
        extract(html, BASE, limits)
    assert e.value.kind == kind
    row = extract_pages(spark.createDataFrame([(BASE, html)], "url string, html string"), limits=limits).head()
    assert row["extract_error"] == kind and row["markdown"] is None


def test_titles_and_descriptions():
    title = lambda t: extract(f"<title>{t}</title>", BASE).title
    assert title("Tides &amp; <b>moons") == "Tides & <b>moons" and title(" a\x00\x1b[2J\n b\t") == "a b"
    described = lambda head: extract(head + "<h1>Title that is long enough</h1><p>Paragraph that is long enough.", BASE).description
    meta = lambda kind, n: f'<meta {kind} content="{"d" * n}">'
    assert described("") == "Paragraph that is long enough." and described(meta("name=description", 19)) == "Paragraph that is long enough."
    assert described(meta("name=description", 20)) == described(meta("property=og:description", 20)) == "d" * 20
    assert len(described(meta("name=description", 400)).encode()) <= 153


def test_truncation_expression_equals_the_function(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab é🌍 c", k=rng.randrange(30))) for _ in range(400)] + ["a" * 40, " " + "b" * 40, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.truncate_summary(F.col("t"), 12).alias("x")).collect()
    assert all(r["x"] == text.truncated(r["t"], 12) for r in rows)


def test_text_expressions(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).head()["x"]
    assert one(text.lines(F.lit("a\r\nb\n"))) == ["a", "b"] and one(text.lines(F.lit("a\n\n"))) == ["a", ""] and one(text.lines(F.lit(""))) == []
    assert one(text.collapse_whitespace(F.lit(" a 　b\u0085 c\n"))) == "a b c"
    assert one(text.sanitize_terminal(F.lit("\x1b[1;31mx\x1b[0m\r\ty\x1b]0;t\x07z\x1bMw\x07"))) == "x\n\tyzw"
    assert one(text.first_paragraph(F.lit("# h\n\n![i](x)\n[l](y)\n| t\n```\n---\n  para \n"))) == "para"
    assert one(text.escape_attribute(F.lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"
