"""Whole flows as compositions of operators: crawl, subscribe, extract, and the diagnostic read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators import article, dom, store
from feedloom.sources import feeds as S
from feedloom.sources import fetched


@dataclass(frozen=True)
class Crawl:
    """What a crawl leaves: the new state of both tables and the entries it added."""

    feeds: DataFrame
    entries: DataFrame
    added: DataFrame


def crawl(feeds: DataFrame, entries: DataFrame, payloads: DataFrame, now: Column) -> Crawl:
    """Feeds that are not disabled, joined to what was fetched for them (uri, xml): items become entries, first wins by
    link; a payload that is no feed disables its feed. A feed without a payload stays as it is."""
    wanted = payloads.join(store.all_feeds(feeds).select(F.col("link").alias("uri")).distinct(), "uri", "left_semi")
    parsed = S.read_feeds(wanted)
    batch = S.with_summary(S.to_entries(parsed, now))
    none = F.lit(None).cast(entries.schema["content"].dataType).alias("content")
    batch = batch.select("*", none, F.xxhash64("feed", "link", "guid", "title").alias("seq"))
    added = store.inserted(entries.select(*[c for c in batch.columns if c in entries.columns]), batch, "seq").drop("seq")
    after = entries.unionByName(added.select(*[c for c in added.columns if c in entries.columns]), allowMissingColumns=True)
    return Crawl(store.disable(feeds, S.rejected(parsed)), after, added)


def due(feeds: DataFrame, now: Column) -> DataFrame:
    """What to fetch next, and when each will be due again."""
    links = store.timeout_feeds(feeds, now).select("link", "ttl")
    return store.touch(feeds, links, now)


def subscribe(feeds: DataFrame, payloads: DataFrame, now: Column) -> DataFrame:
    """The store of feeds with those of the payloads that it lacks."""
    new = S.to_feeds(S.read_feeds(payloads), now)
    return store.save(feeds, new.withColumn("seq", F.xxhash64("link")), "seq")


def extract(fetched_pages: DataFrame, document: bool = False) -> DataFrame:
    """(uri, word_count, link_count, images, text[, html]) of fetched pages (uri, status, content_type, content_encoding,
    body)."""
    pages = fetched.pages(fetched_pages).withColumn("page_id", F.xxhash64("uri"))
    got = article.extract(dom.nodes(pages, "page_id", "uri", "html", leaves=False), document)
    return pages.select("uri", "page_id").join(got, "page_id").drop("page_id")


def local_name(folder: str, uri: Column) -> Column:
    """Where the document of a page lies."""
    return F.concat(F.lit(folder + "/"), F.sha2(uri, 256))


def save_documents(extracted: DataFrame, folder: str) -> None:
    """The documents of pages as a table (local, uri, html) in a folder; a file for each would not scale."""
    extracted.select(local_name(folder, F.col("uri")).alias("local"), "uri", "html").write.mode("overwrite").parquet(folder)


def fill_content(entries: DataFrame, extracted: DataFrame, folder: str) -> DataFrame:
    """Entries with the content found for their links."""
    local = F.when(F.length("text") > 0, local_name(folder, F.col("uri"))).otherwise("")
    return store.set_content(entries, extracted.select(F.col("uri").alias("link"), local.alias("local"), F.col("word_count").cast("int").alias("words"), "images"))


def images(extracted: DataFrame) -> DataFrame:
    """(link, page): each image of extracted pages once, for a fetcher."""
    return extracted.select(F.col("uri").alias("page"), F.explode("images").alias("link")).where("length(link) > 0").groupBy("link").agg(F.min("page").alias("page"))


def diagnostics(entries: DataFrame, limit: int = 10) -> DataFrame:
    """(json): the newest unread entries as JSON objects."""
    x = store.top_n(entries, 0, limit)
    return x.select(fetched.responses(x).alias("json"))


def is_menu(items: Column, links: Column) -> Column:
    """A list most of whose items are links."""
    return (items > 0) & (F.call_function("div", links * 10, F.greatest(items, F.lit(1))) >= 5)
