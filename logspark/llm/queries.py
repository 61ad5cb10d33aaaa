"""One query for each corpus operator, applied with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .best_fit_packing import pack_documents
from .common import table
from .embedding_dedup import embedding_components
from .line_dedup import line_dedup
from .mixing import mix_sources
from .quality_rules import quality_verdicts
from .simhash_dedup import simhash_components
from .substring_dedup import remove_repeated_words
from .suffix_array_dedup import remove_repeated_bytes
from .token_counts import token_counts
from .url_filters import filter_urls, host, place

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).withColumn("shards", F.array_join("shards", ","))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents"))


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list for `pages`, which come without one: of all hosts, their last two labels, and places some are listed, by
    their MD5.

    A listed one is added on a day of the first half of the year, removed some weeks later, and every other one is
    added again."""
    names = [host(F.col("url")), F.regexp_extract(host(F.col("url")), r"([^.]+\.[^.]+)$", 1), place(F.col("url"))]
    names = pages.select(F.explode(F.array(*names)).alias("pattern")).where("pattern <> ''").distinct()
    hashed = names.withColumn("m", F.md5("pattern")).withColumn("v", F.conv(F.substring("m", 2, 4), 16, 10).cast("int")).where("substring(m, 1, 1) < '4'")
    day = F.expr("date_add(DATE'2024-01-01', v % 180)")
    back = F.expr("date_add(DATE'2024-01-01', v % 180 + 20 + v % 60)")
    again = F.expr("date_add(DATE'2024-01-01', v % 180 + 90 + v % 60)")
    return hashed.select("pattern", day.alias("day"), F.lit(True).alias("active")).unionByName(
        hashed.select("pattern", back.alias("day"), F.lit(False).alias("active"))
    ).unionByName(hashed.where("v % 2 = 0").select("pattern", again.alias("day"), F.lit(True).alias("active")))


@query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    fetched = F.expr("date_add(DATE'2024-01-01', CAST(page_id % 365 AS INT))")
    captures = pages.select("page_id", "url", fetched.alias("fetched"))
    return filter_urls(captures, dated_list(pages)).drop("url")


SQL["op8_url_filters"] = r"""
WITH p AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched, lower(url) AS u FROM pages),
h AS (
  SELECT page_id, fetched, u, rtrim(coalesce(regexp_extract(u, '^[a-z][a-z0-9+.\-]*://([^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)', 2), ''), '.') AS host,
         coalesce(regexp_extract(u, '^[a-z][a-z0-9+.\-]*://[^/?#]*/([^/?#]+)', 1), '') AS segment FROM p),
k AS (
  SELECT *, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain,
         CASE WHEN segment <> '' THEN host || '/' || segment ELSE '' END AS place FROM h),
names AS (SELECT host AS pattern FROM k UNION SELECT domain FROM k UNION SELECT place FROM k),
listed AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 2, 4) AS INTEGER) AS v FROM names
  WHERE pattern <> '' AND substr(md5(pattern), 1, 1) < '4'),
spells AS (
  SELECT pattern, DATE '2024-01-01' + CAST(v % 180 AS INTEGER) AS d1, DATE '2024-01-01' + CAST(v % 180 + 20 + v % 60 AS INTEGER) AS d2 FROM listed
  UNION ALL
  SELECT pattern, DATE '2024-01-01' + CAST(v % 180 + 90 + v % 60 AS INTEGER), DATE '9999-12-31' FROM listed WHERE v % 2 = 0),
m AS (
  SELECT k.page_id, k.fetched, k.host,
         EXISTS (SELECT 1 FROM spells s WHERE s.pattern = k.host AND k.fetched >= s.d1 AND k.fetched < s.d2) AS by_host,
         EXISTS (SELECT 1 FROM spells s WHERE (s.pattern = k.host OR ends_with(k.host, '.' || s.pattern)) AND contains(s.pattern, '.') AND NOT regexp_matches(k.host, '^([0-9]+([.][0-9]+){3}|\[.*)$') AND k.fetched >= s.d1 AND k.fetched < s.d2) AS by_domain,
         EXISTS (SELECT 1 FROM spells s WHERE s.pattern = k.place AND k.fetched >= s.d1 AND k.fetched < s.d2) AS by_place
  FROM k)
SELECT *, by_host OR by_domain OR by_place AS blocked FROM m
"""


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


SQL["op2_substring_dedup"] = sql.SUBSTRINGS
SQL["op5_suffix_array_dedup"] = sql.BYTES
SQL["op6_quality_rules"] = sql.quality()
SQL["op9_embedding_near_dedup"] = sql.EMBEDDINGS
SQL["op10_source_mixing"] = sql.mixing()
