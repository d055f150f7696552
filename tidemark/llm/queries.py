"""The queries opN_<name> over the whole driver tables, and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, lm, neardup, quality, rules, suffix, tokens, urls
from .text import Scratch


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers' files are; only their package knows."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; documents in fewer pieces than there are cores are dealt out, as all work here is by row."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op2"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op6"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), Scratch(spark, "op8"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op9"))


#: A dated filter list: domain, list, action, date. Fixed values of the query, not of the operator.
URL_ENTRIES = [
    ("www.cheap-pills.example.com", "spam", "add", "2024-01-01"),
    ("cheap-pills.example.com", "spam", "add", "2024-01-01"),
    ("cheap-pills.example.com", "spam", "remove", "2024-07-01"),
    ("tionsh.example.net", "adult", "add", "2024-02-10"),
    ("tionsh.example.net", "adult", "remove", "2024-05-20"),
    ("tionsh.example.net", "adult", "add", "2024-09-01"),
    ("blog.tionsh.example.net", "allow", "add", "2024-03-01"),
    ("blog.tionsh.example.net", "allow", "remove", "2024-10-15"),
    ("tionble.example.com", "malware", "add", "2024-04-01"),
    ("tionble.example.com", "spam", "add", "2024-04-01"),
    ("tionble.example.com", "spam", "remove", "2024-06-01"),
    ("thther.example.org", "spam", "add", "2024-05-05"),
    ("m.thther.example.org", "allow", "add", "2024-08-08"),
    ("tiontion.example.com", "adult", "add", "2024-01-15"),
    ("tiontion.example.com", "adult", "remove", "2024-01-16"),
    ("ththan.example.net", "gambling", "add", "2024-06-30"),
    ("ththan.example.net", "gambling", "add", "2024-08-30"),
    ("example.org", "parked", "add", "2024-11-01"),
    ("example.org", "parked", "remove", "2024-12-01"),
]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch time, so one is derived from the id: 2024-01-01 plus page_id mod 366 days."""
    entries = spark.createDataFrame(URL_ENTRIES, "domain string, list string, action string, date string")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched"))
    return urls.judge(captures, entries).withColumn("fetched", F.col("fetched").cast("string"))


OP10_SQL = f"""
WITH entries(domain, list, action, date) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in URL_ENTRIES)}),
days AS (SELECT domain, list, date, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT * FROM (SELECT *, lead(date) OVER (PARTITION BY domain, list ORDER BY date) AS until FROM days) WHERE action = 'add'),
captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host FROM pages),
ranked AS (
  SELECT c.page_id, s.domain, s.list, row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.domain) DESC, s.list <> 'allow', s.list) AS n
  FROM captures c JOIN spans s ON (c.host = s.domain OR ends_with(c.host, '.' || s.domain))
   AND s.date <= c.fetched AND (s.until IS NULL OR c.fetched < s.until))
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, c.host, r.domain AS matched_domain, r.list AS matched_list,
       coalesce(r.list <> 'allow', false) AS blocked
FROM captures c LEFT JOIN ranked r ON r.page_id = c.page_id AND r.n = 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_quality, op3_near_duplicates, op4_suffix_dedup, op5_token_counts, op6_lm_scores, op7_decontamination, op8_bpe, op9_quality_rules, op10_url_filters)}
ORACLE_SQL: dict[str, str] = {"op10_url_filters": OP10_SQL}
