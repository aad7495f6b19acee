"""Every query with an SQL counterpart gives its rows, on the smallest tables that are there."""

from __future__ import annotations

import glob
import os
import re

import pytest

import __spark_entry__
from tidepool.plans import catalogue
from tidepool.runtime import table

SF = next((d for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01") if os.path.isdir(d)), None)
pytestmark = pytest.mark.skipif(SF is None, reason="no test tables")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_against_duckdb(spark, name):
    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), db.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("fanout", [7, 500])
def test_crawl_walks_all_pages(spark, monkeypatch, fanout):
    monkeypatch.setattr(catalogue, "ENTRY_LINKS", fanout)
    pages = table(spark, SF, "pages").selectExpr("concat('https://web.example/p/', page_id) AS url")
    entries, depth = catalogue.entry_tree(pages, pages.count(), fanout)
    links = {r["url"]: re.findall(r'href="([^"]+)"', r["html"]) for r in entries.collect()}
    assert max(map(len, links.values())) < 10_000
    root = "https://web.example/"
    want, todo = {root: (0, None)}, [root]
    for url in todo:
        for to in links.get(url, []):
            if to not in want:
                want[to] = (want[url][0] + 1, url)
                todo.append(to)
    got = {r["canonical_url"]: (r["depth"], r["parent_url"]) for r in catalogue.QUERIES["crawl_pages"](spark, SF).where("state = 'written'").collect()}
    assert got == want and {r["url"] for r in pages.collect()} <= set(got) and {d for u, (d, _) in got.items() if "/p/" in u} == {depth}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
