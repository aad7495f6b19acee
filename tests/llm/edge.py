"""Rows that every operator on documents has to take: nulls, empty and very long texts, repeated rows, extra columns of any name."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = "ids string, begins int, decoded string, keys string, spans string, kept string, lang_pred string, score string, hits string, license string, piece string, start string, length string, node string, label string, text2 string"

rng = random.Random(11)
WORDS = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(2, 9))) for _ in range(3000)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n))


LONG = prose(1, 60_000)
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, prose(5, 80)), (6, prose(5, 80)), (5, prose(5, 80)), (7, LONG), (8, LONG + " end"),
    (9, "💥 ▁ ▁▁ \x00 \x85 日本語 テスト"), (10, "12345 !!! ---"), (11, "a b c d e"), (12, "a b c d e"), (13, "\n".join(["same line here"] * 40)), (None, prose(6, 60)), (None, None),
]


def documents(spark, rows=TEXTS, extra: bool = True):
    data = [(i, t, None if k % 5 == 4 else "en", "s", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(data, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for part in EXTRA.split(", "):
            name, kind = part.split()
            df = df.withColumn(name, F.lit("9").cast(kind))
    return df


def empty(spark):
    return documents(spark, [], extra=True)
