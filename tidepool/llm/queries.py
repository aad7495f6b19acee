"""The registered queries of the training-data operators: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.pieces import encode_texts

    done = encode_texts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.when(F.size("ends") > 0, F.element_at("ends", -1)).otherwise(0).cast("long").alias("source_bytes"),
        F.xxhash64("begins", "ends").alias("spans_xxhash64"),
    )


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.repetition import quality

    return quality(table(spark, sf_dir, "documents"))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.languages import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.secrets import find_secrets

    done = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return done.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "grammar")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        number("grammar").alias("n_grammar"),
    )


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.dartminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.multiindex import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op10_crossentropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.crossentropy import score

    targets = table(spark, sf_dir, "labels").where("quality = 1")
    return score(table(spark, sf_dir, "documents"), targets, tokenizer_file("byte_bpe_50k.json"))


#: A dated list for the synthetic pages: (list, kind, pattern, action, day).
LIST_ENTRIES = [
    ("gambling", "domain", "casino-win.example.com", "add", "2024-01-03"),
    ("gambling", "domain", "casino-win.example.com", "remove", "2024-01-20"),
    ("gambling", "domain", "casino-win.example.com", "add", "2024-02-01"),
    ("gambling", "domain", "casino-win.example.org", "add", "2024-01-10"),
    ("gambling", "domain", "casino-win.example.net", "add", "2024-01-10"),
    ("gambling", "domain", "free-bets.example.com", "add", "2024-01-05"),
    ("gambling", "domain", "free-bets.example.org", "add", "2024-01-05"),
    ("gambling", "domain", "free-bets.example.net", "add", "2024-01-25"),
    ("spam", "domain", "spam-farm.example.com", "add", "2024-01-01"),
    ("spam", "domain", "spam-farm.example.org", "add", "2024-01-15"),
    ("spam", "domain", "spam-farm.example.net", "add", "2024-01-15"),
    ("spam", "domain", "spam-farm.example.net", "remove", "2024-01-15"),
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-01-01"),
    ("spam", "domain", "cheap-pills.example.org", "add", "2024-01-08"),
    ("spam", "domain", "cheap-pills.example.org", "add", "2024-01-18"),
    ("spam", "domain", "cheap-pills.example.org", "remove", "2024-02-10"),
    ("ads", "domain", "ads-track.example.com", "add", "2024-01-02"),
    ("ads", "domain", "ads-track.example.net", "add", "2024-01-12"),
    ("adult", "domain", "adult-x.example.com", "add", "2024-01-06"),
    ("adult", "domain", "adult-x.example.net", "add", "2024-01-06"),
    ("adult", "domain", "adult-x.example.net", "remove", "2024-02-20"),
    ("ads", "prefix", "blog.tionsh.example.net/es", "add", "2024-01-04"),
    ("ads", "prefix", "blog.tionsh.example.com/en", "add", "2024-01-09"),
    ("ads", "prefix", "blog.tionsh.example.com/en", "remove", "2024-01-30"),
    ("ads", "prefix", "tionsh.example.net/de", "add", "2024-01-14"),
]


@query
def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table has no fetch times: page n counts as fetched on day n modulo 60 of 2024."""
    from tidepool.llm.urllists import judge

    entries = spark.createDataFrame(LIST_ENTRIES, "list string, kind string, pattern string, action string, day string").select("list", "kind", "pattern", "action", F.to_date("day").alias("at"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(60)).cast("int")).alias("fetched"))
    done = judge(pages, entries, id_col="page_id")
    return done.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "valid", "n_active", "blocked", F.array_join("lists", ",").alias("lists"), F.col("active_since").cast("string").alias("active_since"))


ORACLE["op5_url_lists"] = f"""
WITH entries(list, kind, pattern, action, day) AS (VALUES {", ".join("('" + "', '".join(e) + "')" for e in LIST_ENTRIES)}),
changes AS (SELECT DISTINCT list, kind, pattern, action, CAST(day AS DATE) AS since FROM entries),
spans AS (SELECT *, lead(since) OVER (PARTITION BY list, kind, pattern ORDER BY since, action) AS until FROM changes),
active AS (SELECT * FROM spans WHERE action = 'add' AND (until IS NULL OR until > since)),
captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 60 AS INTEGER) AS fetched,
         nullif(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '') AS host,
         lower(regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)?', 1)) AS path
  FROM pages)
SELECT page_id, host, CAST(fetched AS VARCHAR) AS fetched, host IS NOT NULL AS valid, CAST(count(a.list) AS BIGINT) AS n_active, count(a.list) > 0 AS blocked,
       coalesce(string_agg(DISTINCT a.list, ',' ORDER BY a.list), '') AS lists, CAST(min(a.since) AS VARCHAR) AS active_since
FROM captures c LEFT JOIN active a
  ON c.fetched >= a.since AND (a.until IS NULL OR c.fetched < a.until)
 AND ((a.kind = 'domain' AND (c.host = a.pattern OR ends_with(c.host, '.' || a.pattern)))
   OR (a.kind = 'prefix' AND (c.host || c.path = a.pattern OR starts_with(c.host || c.path, a.pattern || '/'))))
GROUP BY page_id, url, host, fetched
"""


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.llm.licenses import find_licenses

    done = find_licenses(table(spark, sf_dir, "documents"))
    hit = lambda h: F.concat_ws(":", h["license"], h["begin_word"].cast("string"), h["end_word"].cast("string"), h["matched"].cast("string"))
    return done.select("doc_id", "license", "coverage", F.size("hits").cast("long").alias("n_hits"), F.array_join(F.transform("hits", hit), ",").alias("hits"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
