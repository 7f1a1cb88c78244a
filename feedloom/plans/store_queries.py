"""Queries of the store's verbs, the block rules and the projections, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import text as X
from feedloom.operators import blocks, rules, store
from feedloom.session import table
from feedloom.sources import feeds as S
from feedloom.sources import fetched



def now():
    """The fixed time that stands for now."""
    return F.lit("2013-12-01 00:00:00").cast("timestamp")

_NOW = "TIMESTAMPTZ '2013-12-01 00:00:00+00'"
STOP = X.STOP

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# -- text and blocks ---------------------------------------------------------------------------------------------

_WORDS = f"length(regexp_replace(T, '[0-9A-Za-z_]+', 'w', 'g')) - length(regexp_replace(T, '[^{STOP}]', '', 'g'))"


@query(
    "SELECT doc_id, length(regexp_replace(text, '[0-9A-Za-z_]+', 'w', 'g')) AS tokens, " + _WORDS.replace("T,", "text,") + r" AS words, length(regexp_replace(text, '\PP', '', 'g')) AS commas FROM documents"
)
def q_word_count(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.tokens(c).alias("tokens"), X.words(c).alias("words"), X.commas(c).alias("commas"))


_LINES = f"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_idx, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) - 1 AS block_idx, line FROM l WHERE regexp_matches(line, '[^ \t\r\n\f]')),
f AS (SELECT doc_id, block_idx, line, {_WORDS.replace("T,", "line,")} AS words, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS anchor_words,
  CASE WHEN line LIKE '%?' THEN 1 ELSE 0 END AS forms, CASE WHEN line ~ '.*[A-Z].*' THEN 1 ELSE 0 END AS anchors, 0 AS imgs, 0 AS anchor_imgs FROM b),
g AS (SELECT *, CASE WHEN words = 0 THEN CASE WHEN anchors > 0 THEN 100 ELSE 0 END ELSE ((anchor_words + 4 * anchor_imgs) * 100) // (words + 4 * anchor_imgs) END AS density FROM f),
n AS (SELECT *, lag(density, 1, 0) OVER w AS pd, lag(words, 1, 0) OVER w AS pw, lead(density, 1, 0) OVER w AS nd, lead(words, 1, 0) OVER w AS nw, lead(forms, 1, 0) OVER w AS nf
  FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)),
c AS (SELECT *, CASE WHEN forms > 0 AND words = 0 THEN false WHEN words < 8 AND nd > 55 THEN false WHEN density > 33 THEN false
  ELSE (pd <= 55 AND (words > 20 OR nw > 15 OR pw > 8)) OR (pd > 55 AND (words > 40 OR nw > 17)) OR (pd <= 33 AND nd <= 33 AND words = 0 AND imgs > 0 AND anchor_imgs = 0)
    OR (pd < 13 AND nd < 13 AND density < 13 AND words < 40) END AS is_content FROM n)
"""


def _line_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents; capitals stand for linked words and a question mark at the end for a form (proxies)."""
    x = blocks.line_blocks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return x.withColumns(
        {
            "anchor_words": F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("bigint"),
            "anchors": F.when(F.col("text").rlike("[A-Z]"), 1).otherwise(0).cast("bigint"),
            "forms": F.when(F.col("text").endswith("?"), 1).otherwise(0).cast("bigint"),
            "imgs": F.lit(0).cast("bigint"),
            "anchor_imgs": F.lit(0).cast("bigint"),
        }
    )


@query(_LINES + "SELECT doc_id, block_idx, words FROM f")
def q_line_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.line_blocks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "block_idx", "words")


@query(_LINES + "SELECT doc_id, block_idx, density, (words + 64) // 65 AS lines, words - words % 65 AS wrapped FROM g")
def q_link_density(spark: SparkSession, d: str) -> DataFrame:
    x = _line_blocks(spark, d)
    return x.select("doc_id", "block_idx", blocks.density(x).alias("density"), X.lines(F.col("words")).alias("lines"), X.wrapped_words(F.col("words")).alias("wrapped"))


@query(_LINES + "SELECT doc_id, block_idx, density, is_content FROM c")
def q_classify_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.classify(_line_blocks(spark, d), "doc_id").select("doc_id", "block_idx", "density", "is_content")


@query(_LINES + "SELECT doc_id, block_idx, is_content AND NOT (nf > 0 AND words < 16) AS final FROM c")
def q_form_prefix(spark: SparkSession, d: str) -> DataFrame:
    return blocks.form_prefix(blocks.classify(_line_blocks(spark, d), "doc_id"), "doc_id").select("doc_id", "block_idx", "final")


@query(_LINES + "SELECT doc_id, CAST(sum(words) AS BIGINT) AS words, count(*) AS blocks FROM c WHERE is_content GROUP BY doc_id")
def q_article_stats(spark: SparkSession, d: str) -> DataFrame:
    x = blocks.content(blocks.classify(_line_blocks(spark, d), "doc_id"))
    return x.groupBy("doc_id").agg(F.sum("words").alias("words"), F.count("*").alias("blocks"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t]+$', ''), '[ \t]*[\r\n]+[ \t]*', chr(10), 'g') AS text FROM documents")
def q_merge_tail_spaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.merge_tail_spaces(F.col("text")).alias("text"))


_CONTRIBUTIONS = """
WITH s AS (SELECT l_orderkey, 1 + least((CAST(l_quantity AS BIGINT) + 64) // 65, 3) AS s FROM lineitem),
o AS (SELECT o_orderkey, o_custkey, sum(s) AS given, sum(s // 2) AS half FROM s JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
c AS (SELECT 'order' AS kind, o_orderkey AS id, CAST(given AS BIGINT) AS score, o_custkey AS cust FROM o UNION ALL SELECT 'customer', o_custkey, CAST(sum(half) AS BIGINT), o_custkey FROM o GROUP BY o_custkey)
"""


def _rollup(spark: SparkSession, d: str) -> DataFrame:
    """The roll-up of points to parents and grandparents, over line items, orders and customers as a tree (proxy)."""
    line = table(spark, d, "lineitem").select("l_orderkey", (1 + F.least(X.lines(F.col("l_quantity").cast("bigint")), F.lit(3))).alias("s"))
    line = line.groupBy("l_orderkey").agg(F.sum("s").alias("given"), F.sum(F.call_function("div", F.col("s"), F.lit(2))).alias("half"))
    o = line.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    up = o.groupBy("o_custkey").agg(F.sum("half").alias("score")).select(F.lit("customer").alias("kind"), F.col("o_custkey").alias("id"), "score", F.col("o_custkey").alias("cust"))
    return o.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("given").alias("score"), F.col("o_custkey").alias("cust")).unionAll(up)


@query(_CONTRIBUTIONS + "SELECT kind, id, score FROM c")
def q_candidate_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _rollup(spark, d).select("kind", "id", "score")


@query(_CONTRIBUTIONS + "SELECT cust, id, score FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY score DESC, id) AS r FROM c WHERE kind = 'order') WHERE r = 1")
def q_top_candidate(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id")))
    return _rollup(spark, d).where("kind = 'order'").groupBy("cust").agg(best.alias("b")).select("cust", "b.id", "b.score")


# -- the store ---------------------------------------------------------------------------------------------------


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entries")


def _feeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feeds")


@query("SELECT link FROM feeds WHERE disabled = false")
def q_all_feeds(spark: SparkSession, d: str) -> DataFrame:
    return store.all_feeds(_feeds(spark, d)).select("link")


@query(f"SELECT link, refresh FROM feeds WHERE disabled = false AND refresh < {_NOW}")
def q_timeout_feeds(spark: SparkSession, d: str) -> DataFrame:
    return store.timeout_feeds(_feeds(spark, d), now()).select("link", "refresh")


LINK = "http://planet.reedmoor.test/feeds/all.xml"


@query(f"SELECT link, title FROM feeds WHERE link = '{LINK}' LIMIT 1")
def q_find(spark: SparkSession, d: str) -> DataFrame:
    return store.find(_feeds(spark, d), LINK).select("link", "title")


_TOP = "SELECT entry_id, created FROM entries WHERE readed = false {} ORDER BY created DESC, entry_id LIMIT {} OFFSET {}"


@query(_TOP.format("", 50, 10))
def q_unread_topn(spark: SparkSession, d: str) -> DataFrame:
    return store.top_n(_entries(spark, d), 10, 50, tie="entry_id").select("entry_id", "created")


@query(_TOP.format(f"AND feed = '{LINK}'", 20, 0))
def q_topn_by_feed(spark: SparkSession, d: str) -> DataFrame:
    return store.top_n(_entries(spark, d), 0, 20, feed=LINK, tie="entry_id").select("entry_id", "created")


@query(_TOP.format("AND list_contains(category, 'market')", 20, 5))
def q_topn_by_category(spark: SparkSession, d: str) -> DataFrame:
    return store.top_n(_entries(spark, d), 5, 20, category="market", tie="entry_id").select("entry_id", "created")


_NEW = """
WITH s AS (SELECT DISTINCT coalesce(link, '') AS k FROM entries WHERE batch_id % 2 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY coalesce(link, '') ORDER BY entry_id) AS r FROM entries WHERE batch_id % 2 = 1),
n AS (SELECT * FROM b WHERE r = 1 AND coalesce(link, '') NOT IN (SELECT k FROM s))
"""


@query(_NEW + "SELECT entry_id, link FROM n")
def q_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return store.inserted(e.where("batch_id % 2 = 0"), e.where("batch_id % 2 = 1"), "entry_id").select("entry_id", "link")


@query(_NEW + "SELECT entry_id, link FROM n UNION ALL SELECT entry_id, link FROM entries WHERE batch_id % 2 = 0")
def q_save(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return store.save(e.where("batch_id % 2 = 0"), e.where("batch_id % 2 = 1"), "entry_id").select("entry_id", "link")


@query("SELECT entry_id, link FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(link, '') ORDER BY entry_id) AS r FROM entries) WHERE r = 1")
def q_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return store.first_wins(_entries(spark, d), "entry_id").select("entry_id", "link")


@query(f"SELECT link, title FROM feeds WHERE link <> '{LINK}'")
def q_remove(spark: SparkSession, d: str) -> DataFrame:
    return store.remove(_feeds(spark, d), LINK).select("link", "title")


@query(
    """WITH c AS (SELECT feed, min(ttl) AS ttl FROM channels WHERE ttl IS NOT NULL AND feed IS NOT NULL GROUP BY feed)
SELECT link, CASE WHEN feed IS NOT NULL THEN c.ttl ELSE feeds.ttl END AS ttl,
  CASE WHEN feed IS NULL THEN category WHEN list_contains(coalesce(category, []), 'fresh') THEN category ELSE list_concat(coalesce(category, []), ['fresh']) END AS category
FROM feeds LEFT JOIN c ON feed = link"""
)
def q_update_addtoset(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "channels").where("ttl IS NOT NULL AND feed IS NOT NULL").select(F.col("feed").alias("link"), "ttl", F.array(F.lit("fresh")).alias("category"))
    return store.update(_feeds(spark, d), c).select("link", "ttl", "category")


@query(f"WITH c AS (SELECT feed, max(ttl) AS ttl FROM channels GROUP BY feed) SELECT link, CASE WHEN feed IS NOT NULL THEN {_NOW} + to_minutes(coalesce(c.ttl, 0)) ELSE refresh END AS refresh FROM feeds LEFT JOIN c ON feed = link")
def q_touch(spark: SparkSession, d: str) -> DataFrame:
    return store.touch(_feeds(spark, d), table(spark, d, "channels").select(F.col("feed").alias("link"), "ttl"), now()).select("link", "refresh")


@query("WITH f AS (SELECT feed FROM channels WHERE title IS NULL OR title = '' GROUP BY feed) SELECT link, CASE WHEN feed IS NOT NULL THEN true ELSE disabled END AS disabled FROM feeds LEFT JOIN f ON feed = link")
def q_disable(spark: SparkSession, d: str) -> DataFrame:
    bad = table(spark, d, "channels").where("title IS NULL OR title = ''").select(F.col("feed").alias("link"), F.lit(True).alias("disabled"))
    return store.disable(_feeds(spark, d), bad).select("link", "disabled")


ENTRY = "http://kitchen.peliton.example/a/201001/archive?id=1078"


@query(f"SELECT entry_id, CASE WHEN link = '{ENTRY}' THEN true ELSE readed END AS readed FROM entries")
def q_mark_read(spark: SparkSession, d: str) -> DataFrame:
    return store.mark_read(_entries(spark, d), ENTRY).select("entry_id", "readed")


@query(
    """WITH f AS (SELECT link AS l, min({'local': '/cache/' || item_id, 'words': length(content) // 5, 'images': [guid]}) AS f FROM rss_items WHERE length(content) > 0 AND link IS NOT NULL AND guid IS NOT NULL GROUP BY link)
SELECT entry_id, CASE WHEN l IS NULL THEN status WHEN f.words + 128 > 192 THEN 1 ELSE 2 END AS status, CASE WHEN l IS NULL THEN image ELSE list_concat(coalesce(image, []), f.images) END AS image,
  CASE WHEN l IS NULL THEN content.words ELSE CAST(f.words AS INTEGER) END AS words
FROM entries LEFT JOIN f ON l = link"""
)
def q_set_content(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "rss_items").where("length(content) > 0 AND link IS NOT NULL AND guid IS NOT NULL")
    f = f.select("link", F.concat(F.lit("/cache/"), "item_id").alias("local"), F.expr("length(content) div 5").alias("words"), F.array("guid").alias("images"))
    return store.set_content(_entries(spark, d), f).select("entry_id", "status", "image", F.col("content.words").alias("words"))


@query("SELECT entry_id, CASE WHEN statis.words + 128 * statis.imgs > 128 THEN 4 ELSE 0 END AS status FROM entries")
def q_status_summary(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("entry_id", store.summary_status(F.col("statis.words"), F.col("statis.imgs")).alias("status"))


@query("SELECT entry_id, rank FROM (SELECT entry_id, row_number() OVER (PARTITION BY feed ORDER BY created DESC, link, entry_id) AS rank FROM entries WHERE readed = false) WHERE rank <= 3")
def q_rank_unread(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).withColumn("link", F.concat_ws("\x01", F.coalesce("link", F.lit("")), F.lpad(F.col("entry_id").cast("string"), 12, "0")))
    return store.rank_unread(e, "feed", 3).select("entry_id", "rank")


SQL["q_rank_unread"] = SQL["q_rank_unread"].replace("link, entry_id", "coalesce(link, ''), entry_id")


# -- legacy verbs ------------------------------------------------------------------------------------------------


@query("WITH n AS (SELECT entry_id, coalesce(link, '') AS k, row_number() OVER (PARTITION BY coalesce(link, '') ORDER BY entry_id) AS r FROM entries WHERE batch_id % 2 = 1 AND link IS NOT NULL) SELECT entry_id FROM n WHERE r = 1 UNION ALL SELECT entry_id FROM entries WHERE batch_id % 2 = 0 AND (link IS NULL OR link NOT IN (SELECT k FROM n))")
def q_legacy_overwrite(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return store.save_overwrite(e.where("batch_id % 2 = 0"), e.where("batch_id % 2 = 1 AND link IS NOT NULL"), "entry_id").select("entry_id")


@query(
    "WITH s AS (SELECT link, guid, title FROM entries WHERE batch_id % 2 = 0) SELECT entry_id FROM entries WHERE batch_id % 2 = 1 AND ((length(link) > 0 AND link IN (SELECT link FROM s WHERE link IS NOT NULL)) OR (length(guid) > 0 AND guid IN (SELECT guid FROM s WHERE guid IS NOT NULL)) OR (length(title) > 0 AND title IN (SELECT title FROM s WHERE title IS NOT NULL)))"
)
def q_legacy_match(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return store.matched(e.where("batch_id % 2 = 0"), e.where("batch_id % 2 = 1").withColumn("seq", F.col("entry_id"))).select("entry_id")


@query("SELECT entry_id FROM entries WHERE readed = false AND status = 0")
def q_legacy_unready(spark: SparkSession, d: str) -> DataFrame:
    return store.content_unready(_entries(spark, d)).select("entry_id")


@query(f"SELECT link FROM feeds WHERE refresh > {_NOW}")
def q_legacy_refresh(spark: SparkSession, d: str) -> DataFrame:
    return store.refresh_channels(_feeds(spark, d), now()).select("link")


@query("SELECT i AS link, min(link) AS entry FROM (SELECT link, unnest(image) AS i FROM entries) WHERE length(i) > 0 GROUP BY i")
def q_legacy_images(spark: SparkSession, d: str) -> DataFrame:
    return store.entry_images(_entries(spark, d))


@query("SELECT entry_id, CASE WHEN created < TIMESTAMPTZ '2012-01-01 00:00:00+00' AND list_contains(category, 'market') THEN true ELSE readed END AS readed FROM entries")
def q_legacy_mark_before(spark: SparkSession, d: str) -> DataFrame:
    return store.mark_read_before(_entries(spark, d), F.lit("2012-01-01").cast("timestamp"), category="market").select("entry_id", "readed")


# -- URLs --------------------------------------------------------------------------------------------------------

RULES = ["[list 1.0]", "! comment", "||reedmoor.test", "||kelham", "@@||planet.reedmoor.test", "|http://blog.garholt.invalid/a/", "|https://x.test/", "tech.yarby.test/20*html", "wire.kelden.example/a/2012*id=1", "||exa", "/re/"]


def _rules(spark: SparkSession) -> DataFrame:
    return rules.load(spark.createDataFrame(list(enumerate(RULES)), "line_no int, value string"))


_BLOCKED = """
WITH u AS (SELECT entry_id, coalesce(link, '') AS url FROM entries),
p AS (SELECT entry_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, 1, strpos(url, '://') - 1) ELSE '' END AS scheme, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE url END AS rest FROM u),
h AS (SELECT *, split_part(rest, '/', 1) AS host FROM p)
SELECT entry_id, NOT contains(host, 'planet.reedmoor.test') AND ((scheme = 'http' AND rest LIKE 'blog.garholt.invalid/a/%') OR (scheme = 'https' AND rest LIKE 'x.test/%') OR contains(host, 'reedmoor.test') OR contains(host, 'kelham')
  OR (scheme = 'http' AND (rest LIKE '%tech.yarby.test/20%html%' OR rest LIKE '%wire.kelden.example/a/2012%id=1%'))) AS blocked FROM h"""


@query(_BLOCKED)
def q_rule_block(spark: SparkSession, d: str) -> DataFrame:
    return rules.blocked(_entries(spark, d).select("entry_id", "link"), _rules(spark), "entry_id", "link").select("entry_id", "blocked")


@query(_BLOCKED)
def q_rule_ngram(spark: SparkSession, d: str) -> DataFrame:
    return rules.blocked_by_key(_entries(spark, d).select("entry_id", "link"), _rules(spark), "entry_id", "link").select("entry_id", "blocked")


@query(
    "SELECT entry_id, CASE WHEN strpos(link, '://') > 0 THEN substr(link, 1, strpos(link, '://') - 1) ELSE '' END AS scheme, split_part(CASE WHEN strpos(link, '://') > 0 THEN substr(link, strpos(link, '://') + 3) ELSE link END, '/', 1) AS host FROM entries WHERE link IS NOT NULL"
)
def q_url_parse(spark: SparkSession, d: str) -> DataFrame:
    p = rules.url_parts(F.col("link"))
    return _entries(spark, d).where("link IS NOT NULL").select("entry_id", p["scheme"].alias("scheme"), p["host"].alias("host"))


# -- projections of feeds ----------------------------------------------------------------------------------------


@query("SELECT item_id, CASE WHEN strlen(coalesce(description, '')) > strlen(coalesce(content, '')) THEN coalesce(description, '') ELSE coalesce(content, '') END AS body FROM rss_items")
def q_longer_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rss_items").select("item_id", X.longer(F.col("description"), F.col("content")).alias("body"))


@query(
    "SELECT atom_id, CASE WHEN coalesce(list_last(list_filter(link, lambda x: x.rel = 'self')).href, '') <> '' THEN list_last(list_filter(link, lambda x: x.rel = 'self')).href ELSE coalesce(list_last(list_filter(link, lambda x: x.rel = 'alternate')).href, '') END AS link FROM atom_entries WHERE link IS NOT NULL"
)
def q_atom_link(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "atom_entries").where("link IS NOT NULL").select("atom_id", S.last_link(F.col("link")).alias("link"))


@query("SELECT channel_id, CASE updateperiod WHEN 'hourly' THEN 60 WHEN 'daily' THEN 1440 WHEN 'weekly' THEN 10080 WHEN 'monthly' THEN 43200 WHEN 'yearly' THEN 525600 ELSE CASE WHEN coalesce(ttl, 0) <> 0 THEN ttl ELSE 60 END END AS ttl FROM channels")
def q_feed_ttl(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "channels").select("channel_id", S.ttl_minutes(F.col("updateperiod"), F.col("ttl")).alias("ttl"))


@query(
    r"""SELECT item_id, CASE WHEN regexp_full_match(pubdate, '(Mon|Tue|Wed|Thu|Fri|Sat|Sun), \d{1,2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}')
  THEN coalesce(try_strptime(substr(pubdate, 6), '%d %b %Y %H:%M:%S %z'), """ + _NOW + ") ELSE " + _NOW + " END AS updated FROM rss_items"
)
def q_mail_time(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rss_items").select("item_id", S.mail_time(F.col("pubdate"), now()).alias("updated"))


@query("SELECT item_id, CASE WHEN coalesce(guid, '') = '' THEN link ELSE guid END AS guid, list_concat(coalesce(i.category, []), coalesce(f.category, [])) AS category FROM rss_items i LEFT JOIN feeds f ON f.link = i.feed".replace("THEN link", "THEN i.link"))
def q_rss_entries(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    f = _feeds(spark, d).select(F.col("link").alias("feed"), F.col("category").alias("more"))
    x = table(spark, d, "rss_items").join(f, "feed", "left")
    guid = F.when(F.coalesce("guid", F.lit("")) == "", F.col("link")).otherwise(F.col("guid"))
    return x.select("item_id", guid.alias("guid"), F.concat(F.coalesce("category", none), F.coalesce("more", none)).alias("category"))


BYTES = [(1, "89504e470d0a1a0a"), (2, "474946383961"), (3, "ffd8ffe000104a46"), (4, "ffd8ffe1"), (5, "424d36"), (6, "49492a0008"), (7, "4d4d002a"), (8, "00"), (9, None)]


@query("SELECT * FROM (VALUES (1, 'png'), (2, 'gif'), (3, 'jpeg'), (4, 'jpeg2'), (5, 'bmp'), (6, 'tiff'), (7, 'tiff2'), (8, NULL), (9, NULL)) t(id, kind)")
def q_magic_bytes(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(BYTES, "id int, bytes string").select("id", fetched.magic(F.col("bytes")).alias("kind"))


@query("SELECT channel_id, CASE WHEN regexp_matches(feed, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'load' ELSE 'find' END AS route FROM channels WHERE feed IS NOT NULL")
def q_route(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "channels").where("feed IS NOT NULL").select("channel_id", fetched.route(F.col("feed")).alias("route"))


@query("SELECT channel_id, title, ttl FROM channels WHERE title IS NOT NULL")
def q_json(spark: SparkSession, d: str) -> DataFrame:
    """Rows to the JSON of a search result and back."""
    x = table(spark, d, "channels").where("title IS NOT NULL").select("channel_id", "title", "ttl")
    x = x.select("channel_id", "ttl", F.to_json(F.struct(F.struct(F.array(F.struct("title")).alias("entries")).alias("responseData"))).alias("json"))
    return fetched.found_feeds(x, "json", "channel_id").join(x, "channel_id").select("channel_id", "title", "ttl")
