"""Registered queries of the core and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import timestamps
from feedloom.operators import deliveries
from feedloom.plans import built_queries, page_queries, store_queries
from feedloom.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.pairs(spark, f"{d}/entries.parquet")


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.keep_one(spark, f"{d}/entries.parquet", ["entry_id", "batch_id", "title", "summary", "guid", "link", "feed", "status"])


def p5_messages(spark: SparkSession, d: str) -> DataFrame:
    return deliveries.groups(spark, f"{d}/entries.parquet").select(F.col("first.entry_id").alias("first_id"), "copies")


TIME_FIELDS = (("rss_items", "item_id", "pubdate"), ("atom_entries", "atom_id", "updated"), ("channels", "channel_id", "lastbuilddate"))


def times(spark: SparkSession, d: str) -> DataFrame:
    """(tab, rec_id, raw, utc_us) of each row of the tables of TIME_FIELDS; utc_us is null where raw is no time."""
    raw = None
    for tab, key, column in TIME_FIELDS:
        one = table(spark, d, tab).select(F.lit(tab).alias("tab"), F.col(key).alias("rec_id"), F.col(column).alias("raw"), timestamps.host_of(F.col("feed")).alias("host"))
        raw = one if raw is None else raw.unionAll(one)
    zones = table(spark, d, "sites").groupBy("host").agg(F.min("tz").alias("tz"))
    return raw.join(zones, "host", "left").select("tab", "rec_id", "raw", timestamps.utc_micros(F.col("raw"), F.col("tz")).alias("utc_us"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return times(spark, d).where("utc_us IS NOT NULL").select("tab", "rec_id", "utc_us")


def p7_normalized(spark: SparkSession, d: str) -> DataFrame:
    return times(spark, d)


_MESSAGES = r"""
WITH m AS (
  SELECT entry_id, coalesce(feed, chr(0)) AS scope,
         coalesce(nullif(regexp_replace(guid, '^[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g'), ''),
                  nullif(regexp_replace(link, '^[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g'), '')) AS ident
  FROM entries)
"""  # noqa: E501

QUERIES = {"p5_found": p5_found, "p5_kept": p5_kept, "p5_messages": p5_messages, "p7_found": p7_found, "p7_normalized": p7_normalized, **store_queries.QUERIES, **page_queries.QUERIES, **built_queries.QUERIES}

SQL = {
    "p5_found": _MESSAGES
    + "SELECT a.entry_id AS entry_id_a, b.entry_id AS entry_id_b FROM m a JOIN m b ON a.scope = b.scope AND a.ident = b.ident AND a.entry_id < b.entry_id",
    "p5_kept": _MESSAGES
    + """, w AS (SELECT entry_id, min(entry_id) OVER (PARTITION BY scope, coalesce(ident, chr(0) || entry_id)) AS first_id FROM m)
SELECT e.entry_id, batch_id, title, summary, guid, link, feed, status FROM entries e JOIN w USING (entry_id) WHERE w.first_id = e.entry_id""",
    "p5_messages": _MESSAGES + "SELECT min(entry_id) AS first_id, count(*) AS copies FROM m WHERE ident IS NOT NULL GROUP BY scope, ident HAVING count(*) > 1",
    **store_queries.SQL,
    **page_queries.SQL,
    **built_queries.SQL,
}
