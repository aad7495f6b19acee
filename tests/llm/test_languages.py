from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tests.llm import edge
from tidepool.llm.languages import UND, Settings, codewords, fit, grams, held_out, identify, sample

VOICES = {"aa": "abcdeé", "bb": "fghijkl", "cc": "mnopqr", "dd": "stuvwx", "ee": "zyaxbñ", "ff": "aeioubcd", "gg": "xyzklmn", "hh": "qwertü"}


def made(n: int, languages: list[str]) -> list[tuple[int, str, str]]:
    rng = random.Random(5)
    rows = []
    for i in range(n):
        lang = rng.choice(languages)
        rows.append((i, " ".join("".join(rng.choices(VOICES[lang], k=rng.randint(2, 8))) for _ in range(rng.randint(8, 40))), lang))
    return rows


@pytest.mark.parametrize("n", [2, 3, 4, 6, 12])
def test_codewords_differ(n):
    code = codewords(n)
    distance = (code[:, None] != code[None, :]).sum(2) + np.eye(n, dtype=int) * 99
    assert distance.min() >= (1 if n == 2 else code.shape[1] // 4) and (np.abs(code.sum(0)) < n).all()


def test_grams_do_not_cross_texts():
    whole, edges = grams(["ab cd", None, "", "!!!", "xyz"])
    assert (whole[edges[4] :] == grams(["xyz"])[0]).all() and (whole[: edges[1]] == grams(["ab cd"])[0]).all()
    assert (grams(["AB  --  cd"])[0] == grams(["ab cd"])[0]).all()


@pytest.mark.parametrize("languages", [["aa", "bb"], ["aa", "bb", "cc", "dd"], list(VOICES)])
def test_held_out_accuracy(spark, languages):
    df = spark.createDataFrame(made(800, languages), "doc_id bigint, text string, lang string")
    model = fit(df.where(~held_out()))
    rows = identify(df, model, keep=["doc_id", "lang"]).withColumn("h", held_out()).where("h").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_rows_are_those_of_the_checksum(spark):
    rows = spark.range(500).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_labels_of_held_out_rows_are_never_read(spark):
    rows = made(400, ["aa", "bb"])
    lying = [(i, t, ("zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang)) for i, t, lang in rows]
    one, two = (fit(spark.createDataFrame(r, "doc_id bigint, text string, lang string").where(~held_out())) for r in (rows, lying))
    assert one.languages == two.languages and (one.weights == two.weights).all()


def test_the_sample_is_bounded_whatever_repeats(spark):
    rows = [(i, f"text {i}", "aa") for i in range(3000)] + [(None, "one text", "bb")] * 900 + [(7, f"text {i}", "cc") for i in range(900)] + [(i, "x", "dd") for i in range(20)]
    df = spark.createDataFrame(rows, "id string, text string, lang string")
    got = {r["lang"]: r["count"] for r in sample(df, {"aa": 3000, "bb": 900, "cc": 900, "dd": 20}, 50).groupBy("lang").count().collect()}
    assert got["aa"] == got["cc"] == 50 and got.get("bb", 0) in (0, 50) and got["dd"] == 20


def test_ambiguous_texts_are_flagged(spark):
    df = spark.createDataFrame(made(400, ["aa", "bb"]), "doc_id bigint, text string, lang string")
    model = fit(df)
    names, score, unclear = model.predict(["abc de cab", "fgh ijk lig", "wwww", "", None, "123"])
    assert fit(df, settings=Settings(ambiguous=2.0)).predict(["abc de cab"])[2].all()
    assert names[:2] == ["aa", "bb"] and names[3:] == [UND] * 3 and unclear[3:].all() and not unclear[:2].any() and (score[3:] == 0).all()


def test_edge_rows(spark):
    df = edge.documents(spark)
    rows = identify(df, fit(df), keep=df.columns, prefix="p_").collect()
    assert len(rows) == len(edge.TEXTS)
    for r in rows:
        assert r["p_lang_pred"] == ("en" if r["text"] and any(c.isalpha() for c in r["text"]) else UND)
    none = fit(edge.empty(spark))
    assert identify(edge.empty(spark), none).count() == 0
    assert {r["lang_pred"] for r in identify(df, none).collect()} == {UND}
