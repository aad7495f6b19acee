from __future__ import annotations

import os

import pytest

from tests.llm import edge
from tests.llm.test_dartminhash import brute as classes
from tests.llm.test_repetition import brute as figures
from tests.llm.test_secrets import base

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402


def rows():
    texts = [edge.prose(i, 90 + i) for i in range(40)]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(100 + i, t) for i, t in enumerate(texts[:5])]
    docs += [(200, texts[7] + " token: abcdefgh12345"), (201, "short text"), (202, "the same five words again " * 40), (203, "123 456"), (204, None), (205, "")]
    return docs


def test_stages_against_brute_force(spark):
    docs = edge.documents(spark, rows())
    texts = dict(rows())
    one = corpus_pipeline.language(spark, docs, "")
    assert one.columns == docs.columns
    kept = {r["doc_id"] for r in one.collect()}
    assert kept == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    two = corpus_pipeline.rules(spark, one, "")
    good = {i for i in kept if figures(texts[i])["kept"]}
    assert {r["doc_id"] for r in two.collect()} == good and two.columns == docs.columns
    three = corpus_pipeline.duplicates(spark, two, "")
    first = set(classes([(i, texts[i]) for i in sorted(good)]).values())
    assert {r["doc_id"] for r in three.collect()} == first and three.columns == docs.columns
    four = corpus_pipeline.secrets(spark, docs, "")
    for r in four.collect():
        t = texts[r["doc_id"]]
        assert base(r["text"]) == [] and (r["text"] == t or base(t)) and r["n_chars"] == (None if t is None else len(r["text"]))
    assert four.columns == docs.columns
    five = corpus_pipeline.packing(spark, three, "")
    assert {r["doc_id"] for r in five.collect()} == first


def test_whole_run(spark, tmp_path):
    sf = os.path.join(tmp_path, "sf")
    edge.documents(spark, rows(), extra=False).write.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 30 and len({r["sequence_id"] for r in out.collect()}) <= out.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "rules", "duplicates", "secrets", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_edge_and_empty_tables_pass_through(spark):
    for df in (edge.documents(spark), edge.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, "")
            df.collect()


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
