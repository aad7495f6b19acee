"""Corpus documents, the manifest that describes them, and commits to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANIFEST = "page_id string, canonical_url string, depth int, final_url string, status_code int, output_path string, bytes bigint, digest string, description string"
ERRORS = "page_id string, canonical_url string, depth int, attempts int, error_kind string, error string"


def build_document(url: Column, final_url: Column, title: Column, markdown: Column) -> Column:
    """Front matter, an empty line, and the page's Markdown, which ends with a line feed."""
    quoted = F.replace(F.replace(title, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    text = F.concat(F.lit("---\nurl: "), url, F.lit("\nfinal_url: "), final_url, F.lit('\ntitle: "'), quoted, F.lit('"\n---\n\n'), markdown)
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def manifest(corpus: DataFrame) -> DataFrame:
    """Manifest rows of corpus rows (canonical_url, depth, final_url, status_code, document, description)."""
    key = F.sha2(F.col("canonical_url").cast("binary"), 256)
    return corpus.select(
        key.alias("page_id"), "canonical_url", F.col("depth").cast("int").alias("depth"), "final_url", F.col("status_code").cast("int").alias("status_code"),
        F.concat(F.lit("pages/"), key, F.lit(".md")).alias("output_path"), F.octet_length("document").cast("bigint").alias("bytes"),
        F.sha2(F.col("document").cast("binary"), 256).alias("digest"), "description",
    )


def verified(records: DataFrame, documents: DataFrame) -> DataFrame:
    """records with a column verified: whether length and digest are those of the document (canonical_url, document)."""
    both = records.join(documents.select("canonical_url", "document"), "canonical_url", "left")
    same = (F.octet_length("document") == F.col("bytes")) & (F.sha2(F.col("document").cast("binary"), 256) == F.col("digest"))
    return both.withColumn("verified", F.coalesce(same, F.lit(False))).drop("document")


def safe_path(path: Column) -> Column:
    """Whether a relative path stays below its root."""
    return F.coalesce((path != "") & ~path.startswith("/") & ~path.contains("\\") & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", "..")), F.lit(False))


def classify_commit(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming manifest rows with a column commit: new, duplicate (an equal row is there), conflict (another one is), or unsafe_path."""
    facts = [c for c in incoming.columns if c != "page_id"]
    known = existing.select("page_id", F.struct(*facts).alias("known"))
    both = incoming.join(known, "page_id", "left")
    kind = F.when(~safe_path(F.col("output_path")), "unsafe_path").when(F.col("known").isNull(), "new").when(F.col("known").eqNullSafe(F.struct(*facts)), "duplicate").otherwise("conflict")
    return both.withColumn("commit", kind).drop("known")


def unterminated_removed(text: Column) -> Column:
    """A line file without a last line that was cut short."""
    return F.when(text.endswith("\n"), text).otherwise(F.regexp_replace(text, r"[^\n]*\z", ""))
