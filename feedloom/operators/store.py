"""The store of feeds and entries: verbs over DataFrames keyed by `link`.

Reads are filters and ordered limits that Catalyst pushes into the scan; writes return the new state of a table. An
insert never changes rows that exist. `now` is always an argument. Each verb keeps all columns of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# States of an entry's content.
UNRESOLVED, READY, FAILED, UNAVAILABLE, SUMMARY = range(5)


# -- reads -------------------------------------------------------------------------------------------------------


def all_feeds(feeds: DataFrame) -> DataFrame:
    """feeds that are not disabled; a missing flag does not match."""
    return feeds.where("disabled = false")


def timeout_feeds(feeds: DataFrame, now: Column) -> DataFrame:
    """feeds whose refresh time has passed."""
    return all_feeds(feeds).where(F.col("refresh") < now)


def find(feeds: DataFrame, link: str) -> DataFrame:
    """the feed of a link; no row if there is none."""
    return feeds.where(F.col("link") == link).limit(1)


def unread(entries: DataFrame, feed: str | None = None, category: str | None = None) -> DataFrame:
    """unread entries, of a feed or a category if given."""
    x = entries.where("readed = false")
    if feed is not None:
        x = x.where(F.col("feed") == feed)
    return x.where(F.array_contains("category", category)) if category is not None else x


def top_n(entries: DataFrame, skip: int, limit: int, feed: str | None = None, category: str | None = None, tie: str = "link") -> DataFrame:
    """O1 to O3: the newest unread entries; ties by `tie`. A limit of 0 is none."""
    x = unread(entries, feed, category).orderBy(F.desc("created"), F.asc(tie)).offset(skip)
    return x.limit(limit) if limit else x


# -- writes ------------------------------------------------------------------------------------------------------


def first_wins(batch: DataFrame, order: str, key: str = "link") -> DataFrame:
    """The first record of each key; a null key is the empty one. The minimum is combined on the map side."""
    k = F.coalesce(F.col(key), F.lit(""))
    return batch.groupBy(k.alias("__k")).agg(F.min_by(F.struct(*batch.columns), F.col(order)).alias("__r")).select("__r.*")


def inserted(store: DataFrame, batch: DataFrame, order: str, key: str = "link") -> DataFrame:
    """The records of a batch that an insert adds: the first of each key that the store does not have."""
    new = first_wins(batch, order, key)
    return new.alias("n").join(store.select(F.coalesce(F.col(key), F.lit("")).alias("__have")).distinct(), F.coalesce(F.col(f"n.{key}"), F.lit("")) == F.col("__have"), "left_anti")


def save(store: DataFrame, batch: DataFrame, order: str, key: str = "link") -> DataFrame:
    """The store with what is inserted."""
    return store.unionByName(inserted(store, batch, order, key).select(*store.columns))


def remove(feeds: DataFrame, link: str) -> DataFrame:
    """All but the feed of a link; links that are null stay."""
    return feeds.where(~F.col("link").eqNullSafe(link))


def update(feeds: DataFrame, changes: DataFrame) -> DataFrame:
    """U4: of each feed in `changes` (link, ttl, category), ttl is replaced and categories it lacks are appended."""
    c = first_wins(changes, "ttl").select(F.col("link").alias("__l"), F.col("ttl").alias("__t"), F.col("category").alias("__c"))
    have, new = F.coalesce("category", F.array().cast("array<string>")), F.coalesce("__c", F.array().cast("array<string>"))
    x = feeds.join(c, F.col("link") == F.col("__l"), "left")
    x = x.withColumn("category", F.when(F.col("__l").isNotNull(), F.concat(have, F.array_except(new, have))).otherwise(F.col("category")))
    return x.withColumn("ttl", F.when(F.col("__l").isNotNull(), F.col("__t")).otherwise(F.col("ttl"))).select(*feeds.columns)


def touch(feeds: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    """The next refresh of each feed in `links` (link, ttl in minutes) is ttl from now."""
    t = links.groupBy(F.col("link").alias("__l")).agg(F.max("ttl").alias("__t"))
    x = feeds.join(t, F.col("link") == F.col("__l"), "left")
    return x.withColumn("refresh", F.when(F.col("__l").isNotNull(), now + F.make_interval(mins=F.coalesce("__t", F.lit(0)))).otherwise(F.col("refresh"))).select(*feeds.columns)


def disable(feeds: DataFrame, failures: DataFrame) -> DataFrame:
    """Set the flag of each feed in `failures` (link, disabled)."""
    f = failures.groupBy(F.col("link").alias("__l")).agg(F.max("disabled").alias("__d"))
    x = feeds.join(f, F.col("link") == F.col("__l"), "left")
    return x.withColumn("disabled", F.coalesce("__d", "disabled")).select(*feeds.columns)


def mark_read(entries: DataFrame, link: str, readed: bool = True) -> DataFrame:
    """U7."""
    return entries.withColumn("readed", F.when(F.col("link") == link, F.lit(readed)).otherwise(F.col("readed")))


def content_status(file: Column, words: Column, images: Column) -> Column:
    """Ready if there is a file and enough in it, else failed."""
    return F.when((F.length(file) > 0) & (words + images * 128 > 192), READY).otherwise(FAILED)


def summary_status(words: Column, images: Column) -> Column:
    """Whether a summary can stand for the content."""
    return F.when(words + images * 128 > 128, SUMMARY).otherwise(UNRESOLVED)


def set_content(entries: DataFrame, found: DataFrame) -> DataFrame:
    """U8: of each entry in `found` (link, local, words, images ARRAY) set status and content, append the images."""
    f = found.groupBy(F.col("link").alias("__l")).agg(F.min(F.struct(F.coalesce("local", F.lit("")).alias("local"), F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("images", F.array().cast("array<string>")).alias("images"))).alias("__f"))
    x = entries.join(f, F.col("link") == F.col("__l"), "left")
    hit, imgs = F.col("__l").isNotNull(), F.size("__f.images")
    new = F.struct(F.col("__f.local").alias("local"), F.col("__f.words").cast("int").alias("words"), imgs.cast("int").alias("imgs"))
    return x.withColumns(
        {
            "status": F.when(hit, content_status(F.col("__f.local"), F.col("__f.words"), imgs)).otherwise(F.col("status")),
            "content": F.when(hit, new).otherwise(F.col("content")),
            "image": F.when(hit, F.concat(F.coalesce("image", F.array().cast("array<string>")), F.col("__f.images"))).otherwise(F.col("image")),
        }
    ).select(*entries.columns)


# -- legacy verbs ------------------------------------------------------------------------------------------------


def save_overwrite(store: DataFrame, batch: DataFrame, order: str, key: str = "link") -> DataFrame:
    """L1: insert or overwrite by key."""
    new = first_wins(batch, order, key)
    return store.join(new.select(key), key, "left_anti").select(*store.columns).unionByName(new.select(*store.columns))


def matched(store: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("link", "guid", "title")) -> DataFrame:
    """L1: records of a batch that match a row of the store by any of the keys: one equi-join each, never an OR."""
    rows = batch.withColumn("__row", F.monotonically_increasing_id()) if "seq" not in batch.columns else batch.withColumn("__row", F.col("seq"))
    hits = None
    for k in keys:
        one = rows.where(F.length(k) > 0).join(store.where(F.length(k) > 0).select(k).distinct(), k, "left_semi").select(*rows.columns)
        hits = one if hits is None else hits.unionByName(one)
    return hits.dropDuplicates(["__row"]).drop("__row")


def images_unready(images: DataFrame) -> DataFrame:
    """L2: images never tried."""
    return images.where("ready IS NULL")


def content_unready(entries: DataFrame) -> DataFrame:
    """L4: unread entries whose content is unresolved."""
    return unread(entries).where(F.col("status") == UNRESOLVED)


def refresh_channels(feeds: DataFrame, now: Column) -> DataFrame:
    """Feeds whose refresh time is still to come (the older verb has the opposite sign to F2)."""
    return feeds.where(F.col("refresh") > now)


def touch_all(feeds: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    """As `touch`, of every match."""
    return touch(feeds, links, now)


def set_state(entries: DataFrame, link: str, local: str) -> DataFrame:
    """Status by whether there is a path."""
    return entries.withColumn("status", F.when(F.col("link") == link, F.lit(READY if local else FAILED)).otherwise(F.col("status")))


def entry_images(entries: DataFrame) -> DataFrame:
    """(link, entry) of each distinct image of the entries."""
    x = entries.select(F.col("link").alias("entry"), F.explode("image").alias("link")).where("length(link) > 0")
    return x.groupBy("link").agg(F.min("entry").alias("entry"))


def mark_read_before(entries: DataFrame, before: Column, feed: str | None = None, category: str | None = None) -> DataFrame:
    """Mark entries of a feed or category that were created before a time."""
    hit = F.col("created") < before
    if feed is not None:
        hit = hit & (F.col("feed") == feed)
    if category is not None:
        hit = hit & F.array_contains("category", category)
    return entries.withColumn("readed", F.when(hit, True).otherwise(F.col("readed")))


def rank_unread(entries: DataFrame, per: str = "feed", most: int = 10) -> DataFrame:
    """The newest unread entries of each feed; with rank from 1."""
    w = Window.partitionBy(per).orderBy(F.desc("created"), F.asc("link"))
    return unread(entries).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
