"""Registered queries of the subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import bpe, garbled, markup_ops, mixture, page_ops, pii_ops, site_lines
from feedloom.functions.timestamps import host_of
from feedloom.session import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    x = spread(table(spark, d, "entries").select("entry_id", "summary", "feed", "updated"))
    x = site_lines.with_repeated(x, "feed", "summary", "updated", "numbers")
    return x.select("entry_id", F.explode_outer("numbers").alias("line_no")).where("line_no IS NOT NULL")  # explode would compute the numbers twice, to filter by their size first


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    x = spread(table(spark, d, "entries").select("entry_id", "summary", "feed", "updated"))
    x = site_lines.with_repeated(x, "feed", "summary", "updated", "numbers")
    return x.select("entry_id", site_lines.without_lines(F.col("summary"), F.col("numbers")).alias("summary"), F.size("numbers").alias("removed"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """(tab, rec_id, host, day, body) of the texts that may be whole pages."""
    host = host_of(F.col("feed")).alias("host")
    items = table(spark, d, "rss_items").select(F.lit("rss_items").alias("tab"), F.col("item_id").alias("rec_id"), host, F.col("fetched").alias("day"), F.col("content").alias("body"))
    return spread(items.unionAll(table(spark, d, "entries").select(F.lit("entries").alias("tab"), F.col("entry_id").alias("rec_id"), host, F.col("updated").alias("day"), F.col("summary").alias("body"))))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    x = page_ops.with_main(_records(spark, d), "host", "body", "day", "page")
    return x.select("tab", "rec_id", F.explode("page.furniture").alias("line_no"))


def p2_main(spark: SparkSession, d: str) -> DataFrame:
    x = page_ops.with_main(_records(spark, d), "host", "body", "day", "page")
    return x.select("tab", "rec_id", "page.residue", "page.main")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    x = page_ops.with_residue(_records(spark, d), "host", "body", "day", "kinds")
    return x.where("size(kinds) > 0").select("tab", "rec_id")


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    x = page_ops.with_residue(_records(spark, d), "host", "body", "day", "kinds")
    return x.where("size(kinds) = 0").select("tab", "rec_id", "body")


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, field_name, raw, affected, restored, text) of each title and description."""
    model = garbled.fit(spread(table(spark, d, "documents").select("text")), "text")
    x = spread(table(spark, d, "rss_items").select("item_id", "title", "description"))
    x = garbled.repair_columns(x, ["title", "description"], model)
    one = lambda c: F.struct(F.lit(c).alias("field_name"), F.col(c).alias("raw"), F.col(c + "_repair").alias("r"))
    x = x.select("item_id", F.explode(F.array(one("title"), one("description"))).alias("f"))
    return x.select("item_id", "f.field_name", "f.raw", "f.r.affected", "f.r.restored", "f.r.text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).where("affected").select("item_id", "field_name")


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("item_id", "field_name", "affected", "restored", "text")


def _marked(spark: SparkSession, d: str, convert: bool = True) -> DataFrame:
    """(item_id, host, field_name, m STRUCT<kinds, clean>) of each description and content."""
    x = spread(table(spark, d, "rss_items").select("item_id", host_of(F.col("feed")).alias("host"), "description", "content"))
    one = lambda c: F.struct(F.lit(c).alias("field_name"), F.col(c).alias("body"))
    x = x.select("item_id", "host", F.explode(F.array(one("description"), one("content"))).alias("f")).select("item_id", "host", "f.field_name", "f.body")
    return markup_ops.with_markup(x, "body", "m", convert)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d, convert=False).select("item_id", "field_name", F.explode("m.kinds").alias("markup"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("item_id", "field_name", F.col("m.clean").alias("text"))


def p6_unique(spark: SparkSession, d: str) -> DataFrame:
    x = _marked(spark, d).select("item_id", "field_name", "host", F.col("m.clean").alias("text"), F.concat_ws(":", "item_id", "field_name").alias("key"))
    return markup_ops.unique_runs(x, "key", "host", "text", "unique_text").select("item_id", "field_name", "unique_text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    x = spread(table(spark, d, "documents").select("doc_id", "text"))
    return bpe.encode_column(x, "text", "ids", bpe.default_vocabulary()).select("doc_id", "ids")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return bpe.decode_column(p8_ids(spark, d), "ids", "text", bpe.default_vocabulary()).select("doc_id", "text")


def _mix(spark: SparkSession, d: str):
    docs, targets = _texts_and_targets(spark, d)
    ranges, sizes, long = mixture.plan(docs, targets, "doc_id", "sources", "text", bpe.default_vocabulary())
    return docs, targets, ranges, sizes, long


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    docs, _, ranges, _, long = _mix(spark, d)
    x = mixture.mixture(docs.where("length(text) > 0"), ranges, long, "doc_id", "sources")
    return x.select("mix_id", "d.doc_id", "mix_source", "copy", "d.text")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    _, targets, ranges, sizes, _ = _mix(spark, d)
    return mixture.shares(ranges, sizes, targets)


def _texts_and_targets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    return docs.withColumn("sources", F.array("source")), table(spark, d, "mix_targets")


def p9_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The shares where a document belongs to every source that has its text, so that the flow chooses between them."""
    docs, targets = _texts_and_targets(spark, d)
    ranges, sizes, _ = mixture.plan(docs, targets, "doc_id", "sources", "text", bpe.default_vocabulary(), by_text=True)
    return mixture.shares(ranges, sizes, targets)


def p9_policies(spark: SparkSession, d: str) -> DataFrame:
    """What each way to treat scarce sources comes to."""
    docs, targets = _texts_and_targets(spark, d)
    return mixture.policies(mixture.measured(docs, "doc_id", "sources", "text", bpe.default_vocabulary(), 42), targets)


def _personal(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    finder = pii_ops.fit(spread(docs), "text", table(spark, d, "name_parts"))
    return pii_ops.with_pii(spread(docs), "text", finder, "pii")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pii_ops.found(spread(docs), "doc_id", "text", table(spark, d, "name_parts"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("doc_id", F.col("pii.text").alias("text"))


_P1 = r"""
WITH l AS (
  SELECT entry_id, coalesce(feed, chr(0)) AS src, unnest(string_split(summary, chr(10))) AS line, unnest(range(1, len(string_split(summary, chr(10))) + 1)) AS line_no
  FROM entries WHERE summary IS NOT NULL),
k AS (
  SELECT entry_id, src, line, line_no, regexp_replace(trim(regexp_replace(lower(regexp_replace(line, '[\x{200B}\x{FEFF}]', '', 'g')),
    '[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '\p{Nd}+', '0', 'g') AS key FROM l),
n AS (SELECT coalesce(feed, chr(0)) AS src, count(*) AS n FROM entries GROUP BY 1),
r AS (SELECT src, key FROM k JOIN n USING (src) WHERE key <> '' GROUP BY src, key, n HAVING count(DISTINCT entry_id) >= 5 AND count(DISTINCT entry_id) >= 0.1 * n)
"""  # noqa: E501

QUERIES = {"p1_found": p1_found, "p1_cleaned": p1_cleaned, "p2_found": p2_found, "p2_main": p2_main, "p3_found": p3_found, "p3_kept": p3_kept, "p4_found": p4_found, "p4_restored": p4_restored, "p6_found": p6_found, "p6_clean": p6_clean, "p6_unique": p6_unique, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_overlap": p9_overlap, "p9_policies": p9_policies, "p10_found": p10_found, "p10_redacted": p10_redacted}

SQL = {
    "p1_found": _P1 + "SELECT entry_id, line_no FROM k JOIN r USING (src, key)",
    "p1_cleaned": _P1
    + """, c AS (SELECT entry_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (r.key IS NULL) AS kept, count(r.key) AS removed FROM k LEFT JOIN r USING (src, key) GROUP BY entry_id)
SELECT entry_id, CASE WHEN removed = 0 THEN summary WHEN summary IS NOT NULL THEN coalesce(kept, '') END AS summary, CAST(coalesce(removed, 0) AS INTEGER) AS removed FROM entries LEFT JOIN c USING (entry_id)""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
