"""A training corpus from the documents table, in five stages: language identification, quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs; all but the
last return the columns of documents.

Cases: a document is judged by its own row, so repeated rows fare alike until near-duplicates, where one row of each class stays; null and
empty texts go in the first stage; rows without an id are compared like others, and of a class that has an id they go; empty tables pass through; columns beyond those of
documents stay as they are in all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.dartminhash import distinct_documents
from tidepool.llm.languages import fit, held_out, identify
from tidepool.llm.packing import pack_documents
from tidepool.llm.queries import tokenizer_file
from tidepool.llm.repetition import quality
from tidepool.llm.secrets import redact
from tidepool.runtime import discard, materialise, table


def _prefix(df: DataFrame) -> str:
    """Begins no column of df."""
    return "_" * (1 + max(len(c) for c in df.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language is ambiguous."""
    own = _prefix(docs)
    model = fit(docs.where(~held_out()))
    found = identify(docs, model, keep=docs.columns, prefix=own)
    return found.where(~F.col(own + "ambiguous")).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the repetition rules reject."""
    own = _prefix(docs)
    return quality(docs, keep=docs.columns, prefix=own).where(own + "kept").select(*docs.columns)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each class of near-duplicates."""
    return distinct_documents(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of every secret; n_chars follows."""
    done = redact(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 1024 tokens."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("language", language), ("rules", rules), ("duplicates", duplicates), ("secrets", secrets), ("packing", packing)]

#: SQL can express neither the tokens nor the signatures; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
