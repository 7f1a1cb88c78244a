"""Queries of pages and feed documents. Pages are the contents of RSS items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import article, dom
from feedloom.plans import pipelines
from feedloom.plans.store_queries import now
from feedloom.session import spread, table
from feedloom.sources import feeds as S


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "rss_items").select(F.col("item_id").alias("page_id"), F.col("link").alias("url"), F.col("content").alias("html")))


def q_extract_pages(spark: SparkSession, d: str) -> DataFrame:
    return article.extract(dom.nodes(_pages(spark, d), leaves=False))


def q_page_counts(spark: SparkSession, d: str) -> DataFrame:
    return dom.page_counts(_pages(spark, d))


def q_node_counts(spark: SparkSession, d: str) -> DataFrame:
    return dom.nodes(_pages(spark, d)).groupBy("tag").agg(F.count("*").alias("nodes"), F.countDistinct("page_id").alias("pages"))


def q_fragments(spark: SparkSession, d: str) -> DataFrame:
    x = dom.with_fragment(spread(table(spark, d, "rss_items").select("item_id", "link", "description")), "description", "link", "f")
    return x.select("item_id", F.col("f.html").alias("html"), F.col("f.words").alias("words"), F.col("f.links").alias("links"), F.col("f.images").alias("images"))


def _xml(c: str | Column):
    """A column as XML text; characters that XML can't hold go."""
    clean = F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"[^\x09\x0A\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    return F.regexp_replace(F.regexp_replace(clean, "&", "&amp;"), "<", "&lt;")


def _quoted(c: str | Column):
    """A column as the value of an XML attribute."""
    x = F.regexp_replace(_xml(c), '"', "&quot;")
    for sign, code in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):  # a parser makes blanks of them
        x = F.replace(x, F.lit(sign), F.lit(code))
    return x


#: Keys of so many items go to one document, so that no feed is one row however many items it has.
ITEMS = 500


def _documents(x: DataFrame, key: str, item: Column, head: str, tail: str) -> DataFrame:
    """(uri, xml): the items of each feed in order, in documents of at most ITEMS."""
    part = F.floor(F.col(key) / ITEMS).alias("part")
    x = x.select(F.col("feed").alias("uri"), part, F.struct(F.col(key).alias("key"), item.alias("xml")).alias("i"))
    x = x.groupBy("uri", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["xml"]), "").alias("items"))
    return x.select("uri", F.concat(F.lit(head), "items", F.lit(tail)).alias("xml"))


def _rss(spark: SparkSession, d: str) -> DataFrame:
    """Each feed's items written as RSS documents."""
    item = F.concat(F.lit("<item><title>"), _xml("title"), F.lit("</title><link>"), _xml("link"), F.lit("</link><guid>"), _xml("guid"), F.lit("</guid><description>"), _xml("description"), F.lit("</description></item>"))
    return _documents(table(spark, d, "rss_items"), "item_id", item, "<rss><channel><title>t</title><link>http://x/</link>", "</channel></rss>")


def _atom(spark: SparkSession, d: str) -> DataFrame:
    """Each feed's entries written as Atom documents."""
    link = lambda x: F.concat(F.lit('<link rel="'), _quoted(x["rel"]), F.lit('" href="'), _quoted(x["href"]), F.lit('"/>'))
    links = F.array_join(F.transform(F.coalesce("link", F.array().cast("array<struct<rel:string,href:string>>")), link), "")
    item = F.concat(F.lit("<entry><title>"), _xml("title"), F.lit("</title><id>"), _xml("id"), F.lit("</id><updated>"), _xml("updated"), F.lit("</updated><author><name>"), _xml("author.name"), F.lit("</name></author><summary>"), _xml("summary.body"), F.lit("</summary>"), links, F.lit("</entry>"))
    return _documents(table(spark, d, "atom_entries"), "atom_id", item, '<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><link rel="alternate" href="http://x/"/>', "</feed>")


def _opml(spark: SparkSession, d: str) -> DataFrame:
    """All feeds written as OPML documents."""
    x = table(spark, d, "feeds").select("link", F.concat(F.lit('<outline title="'), _quoted("title"), F.lit('" xmlUrl="'), _quoted("link"), F.lit('"/>')).alias("xml"))
    n = F.greatest(F.lit(1), F.ceil(F.lit(table(spark, d, "feeds").count()) / ITEMS))
    x = x.groupBy(F.pmod(F.xxhash64("link"), n).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("xml")), "").alias("items"))
    return x.select(F.col("part").cast("string").alias("uri"), F.concat(F.lit('<opml><body><outline title="all">'), "items", F.lit("</outline></body></opml>")).alias("xml"))


def q_rss(spark: SparkSession, d: str) -> DataFrame:
    return S.to_entries(S.read_feeds(_rss(spark, d)), now()).groupBy("feed").agg(F.count("*").alias("items"), F.sum(F.length("title")).alias("title_chars"))


def q_crawl(spark: SparkSession, d: str) -> DataFrame:
    """A crawl of all feeds whose documents are the items of each feed, into the store of all entries: what it adds."""
    feeds, entries = table(spark, d, "feeds"), table(spark, d, "entries")
    return pipelines.crawl(feeds, entries, _rss(spark, d), now()).added.select("link", "guid", "title", "status")


def q_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.diagnostics(table(spark, d, "entries"))


OPML = '<opml><body><outline title="news"><outline title="A" xmlUrl="http://a/"/><outline title="deep"><outline title="B" xmlUrl="http://b/"/></outline></outline><outline title="top" xmlUrl="http://t/"/></body></opml>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><link rel="self" href="http://f/"/><category term="x"/><entry><title>E</title><link rel="alternate" href="http://e/1"/><link rel="alternate" href="http://e/2"/><id></id><summary>a</summary><content>bc</content></entry></feed>'


def q_opml(spark: SparkSession, d: str) -> DataFrame:
    return S.read_opml(spark.createDataFrame([("u", OPML)], "uri string, xml string"), now()).select("link", "title", "ttl")


def q_atom(spark: SparkSession, d: str) -> DataFrame:
    return S.to_entries(S.read_feeds(spark.createDataFrame([("u", ATOM)], "uri string, xml string")), now()).select("title", "link", "guid", "feed", "category", "body")


def q_opml_feeds(spark: SparkSession, d: str) -> DataFrame:
    """All feeds through OPML; q_opml is the literal document of its SQL."""
    return S.read_opml(spread(_opml(spark, d)), now()).select("link", "title", "ttl")


def q_atom_entries(spark: SparkSession, d: str) -> DataFrame:
    """All Atom entries through their documents; q_atom is the literal document of its SQL."""
    return S.to_entries(S.read_feeds(spread(_atom(spark, d))), now()).select("title", "link", "guid", "updated", "author", "body")


QUERIES = {f.__name__: f for f in (q_extract_pages, q_page_counts, q_node_counts, q_fragments, q_rss, q_opml, q_opml_feeds, q_atom, q_atom_entries, q_crawl, q_diagnostics)}
SQL = {
    "q_rss": r"SELECT feed, count(*) AS items, CAST(sum(length(regexp_replace(coalesce(title, ''), '[^\x{09}\x{0A}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]', '', 'g'))) AS BIGINT) AS title_chars FROM rss_items GROUP BY feed",
    "q_opml": "SELECT * FROM (VALUES ('http://a/', 'A', 60), ('http://b/', 'B', 60)) t(link, title, ttl)",
    "q_atom": "SELECT 'E' AS title, 'http://e/2' AS link, 'http://e/2' AS guid, 'http://f/' AS feed, ['x'] AS category, 'bc' AS body",
}
