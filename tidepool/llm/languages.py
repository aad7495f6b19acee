"""Operator 4: language identification with error-correcting output codes.

Every language gets a codeword; one binary classifier per bit tells languages whose bit is 1 from the others by character n-grams, and the
word whose bits lose least, each loss weighted by how far apart its classifier puts the two sides' languages at least, is the prediction. A
near tie between two words is flagged as ambiguous. Codewords of two languages differ in the one bit there is and those of three in two, so
errors of single bits are outvoted from four languages on.

The classifiers are fitted on at most `per_language` labelled rows of each language, those with the smallest hashes of id and text; a draw
by that hash comes first, so that little more than these rows is moved. What reaches the driver is one count per language and n-gram bucket,
at most languages x BUCKETS rows.

Cases: null texts and texts without letters are `und` with score 0; a null language is never learned; with one language learned, that one
is predicted with score 1; with none (an empty table), `und`; texts of any length are read whole; repeated rows get equal results; ties
go to the language that sorts first; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import map_texts, ref, slices
from tidepool.runtime import ensure_workers

BUCKETS = 1 << 16
#: Texts are read in pieces of so many bytes when their n-grams are looked up; every piece counts.
PIECE = 1 << 20
UND = "und"


@dataclass(frozen=True)
class Settings:
    """per_language: labelled rows per language that the classifiers are fitted on, at most. most_bits: columns of the code beyond
    which an exhaustive code is not used. ambiguous: least lead of the best codeword, as a share of the whole loss."""

    per_language: int = 3000
    most_bits: int = 31
    ambiguous: float = 0.02
    smoothing: float = 0.5


def codewords(n: int, most_bits: int = 31) -> np.ndarray:
    """n rows of -1 and 1. Up to six languages: every split of them in two parts; more: the best of seeded random codes."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if (1 << (n - 1)) - 1 <= most_bits:
        splits = np.arange(1, 1 << (n - 1))
        bits = splits[None, :] >> np.arange(n)[:, None] & 1  # the last language is in the part of zeros
        return (2 * bits - 1).astype(np.int8)
    length = max(most_bits, int(np.ceil(10 * np.log2(n))))
    best, apart = None, -1
    rng = np.random.default_rng(n)
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, length))
        d = (code[:, None, :] != code[None, :, :]).sum(2)
        np.fill_diagonal(d, length)
        if d.min() > apart and (np.abs(code.sum(0)) < n).all():
            best, apart = code, d.min()
    return best


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every three bytes in a row of the lower-case letters of the texts, where each text begins and the last ends)."""
    whole = [b" " + t.lower().encode("utf-8", "replace") + b" " if t else b" " for t in texts]
    if not whole:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    kind = _kinds[np.frombuffer(b"".join(whole), np.uint8)]
    edges = np.concatenate([[0], np.cumsum([len(w) for w in whole])])
    solid = kind != 32
    solid[1:] |= solid[:-1]  # of a run of anything but letters, one space stays
    solid[edges[:-1]] = True
    total = np.concatenate([[0], np.cumsum(solid)])[edges]
    key = kind[solid].astype(np.uint32)
    key = key[:-2] * np.uint32(0x9E3779B1) + key[1:-1] * np.uint32(0x85EBCA77) + key[2:] * np.uint32(0xC2B2AE3D)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D)
    take = np.ones(int(total[-1]), bool)
    take[total[1:] - 1] = take[np.maximum(total[1:] - 2, total[:-1])] = False
    return (key >> np.uint32(16))[take[:-2]], np.concatenate([[0], np.cumsum(np.maximum(np.diff(total) - 2, 0))])


_kinds = np.arange(256, dtype=np.uint8)  # digits, signs and spaces say nothing about a language
_kinds[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    #: One row per bit: the weight of each n-gram bucket.
    weights: np.ndarray
    #: How much each bit counts, and by how much its mean weight is multiplied.
    trust: np.ndarray
    scale: np.ndarray
    ambiguous: float = Settings.ambiguous

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """One row per text, one column per bit: mean weight of the text's n-grams."""
        out = np.zeros((len(texts), self.code.shape[1]))
        if not self.code.shape[1]:
            return out
        bucket, edges = grams(texts)
        size = np.maximum(np.diff(edges), 1)
        full = np.flatnonzero(np.diff(edges))
        for k, weights in enumerate(self.weights):
            if len(full):
                out[full, k] = np.add.reduceat(weights[bucket], edges[full], dtype=np.float64)
        return out / size[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score from 0 to 1, whether it is ambiguous) of each text."""
        n = len(texts)
        if not self.languages:
            return [UND] * n, np.zeros(n), np.ones(n, bool)
        if len(self.languages) == 1:
            letters = np.array([has_letter(t) for t in texts], bool)
            return [self.languages[0] if x else UND for x in letters], letters.astype(float), ~letters
        loss = np.logaddexp(0, -self.code[None, :, :] * (self.margins(texts) * self.scale)[:, None, :]) @ self.trust
        best = loss.argmin(1)
        low = np.sort(loss, 1)
        lead = low[:, 1] - low[:, 0]
        score = 1 / np.exp(low[:, :1] - loss).sum(1)
        unclear = lead < self.ambiguous * loss.sum(1)
        names = [self.languages[b] for b in best]
        for i, t in enumerate(texts):
            if not has_letter(t):
                names[i], score[i], unclear[i] = UND, 0.0, True
        return names, score, unclear


def sample(known: DataFrame, sizes: dict[str, int], most: int) -> DataFrame:
    """Of each language the `most` rows of (id, text, lang) with the smallest hashes, all if there are no more."""
    room = most + 4 * most**0.5 + 16  # so that the draw leaves too few rows about once in 30,000 fits
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, room / n))])
    draw = F.pmod(F.xxhash64(F.lit("language"), "id", "text"), F.lit(1 << 30))
    drawn = known.withColumn("draw", draw).where(F.col("draw") / F.lit(float(1 << 30)) < share[F.col("lang")])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))
    return drawn.withColumn("place", place).where(F.col("place") <= most)


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Model:
    """A model of the languages of df's labelled rows; rows whose language or text is null are not learned."""
    ensure_workers(df.sparkSession)
    known = df.select(ref(id_col).cast("string").alias("id"), ref(text_col).cast("string").alias("text"), ref(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], codewords(0), np.zeros((0, BUCKETS)), np.zeros(0), np.zeros(0))
    code = codewords(len(languages), settings.most_bits)
    if len(languages) == 1:
        return Model(languages, code, np.zeros((0, BUCKETS)), np.zeros(0), np.zeros(0))
    chosen = sample(known, sizes, settings.per_language).select("lang", "text")
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), BUCKETS))
        for batch in batches:
            for part, texts in slices(batch, batch.column(1), PIECE):
                bucket, edges = grams(texts.to_pylist())
                lang = np.array([place[x] for x in part.column(0).to_pylist()], np.int64)
                own = np.repeat(lang, np.diff(edges))
                # each text counts as one, long or short
                weight = np.repeat(1 / np.maximum(np.diff(edges), 1), np.diff(edges))
                total += np.bincount(own * BUCKETS + bucket, weight, total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], names=["lang", "bucket", "n"])

    counts = chosen.mapInArrow(count, "lang int, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(languages), BUCKETS))
    total[counts["lang"].to_numpy(), counts["bucket"].to_numpy()] = np.round(counts["n"].to_numpy(), 6)
    share_of = total + settings.smoothing / BUCKETS
    share_of /= share_of.sum(1, keepdims=True)
    weights = np.stack([np.log(share_of[bit > 0].mean(0)) - np.log(share_of[bit < 0].mean(0)) for bit in code.T])
    # how far apart a bit's languages lie on average is how much it is trusted, and sets its scale
    apart = np.abs((share_of[:, None, :] * weights[None, :, :]).sum(2))
    near = apart.min(0)
    trust = near / near.sum()
    return Model(languages, code, weights.astype(np.float32), trust * len(trust), 6 / np.maximum(near, 1e-6), settings.ambiguous)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: remainder 2 of the id's CRC-32 by 4."""
    return F.coalesce(F.crc32(ref(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


FIELDS = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("ambiguous", T.BooleanType(), False)]


def identify(df: DataFrame, model: Model, *, keep: list[str] | None = None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """`keep` columns of each row, and lang_pred, score, ambiguous (names begin with prefix)."""
    fields = [T.StructField(prefix + f.name, f.dataType, False) for f in FIELDS]

    def make():
        def work(texts: pa.Array, _rows: pa.RecordBatch) -> list[pa.Array]:
            names, score, unclear = model.predict(texts.to_pylist())
            return [pa.array(names, pa.string()), pa.array(score), pa.array(unclear)]

        return work

    return map_texts(df, text_col, keep or ["doc_id"], fields, make, limit=PIECE)
