"""Feeds: RSS, Atom and OPML documents as tables, and their items as entries.

Names in these documents are told apart by namespace and OPML outlines nest without bound, which the built-in XML
reader can't express; so each payload is parsed by one Python call into typed rows, and all that follows is native.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions import text as X
from feedloom.functions.timestamps import utc_micros
from feedloom.operators import store

ATOM = "{http://www.w3.org/2005/Atom}"
CONTENT = "{http://purl.org/rss/1.0/modules/content/}"
# Minutes of the update periods.
PERIODS = {"hourly": 60, "daily": 1440, "weekly": 10080, "monthly": 43200, "yearly": 525600}

LINK = "struct<rel:string,href:string>"
ITEM = f"struct<title:string,link:string,links:array<{LINK}>,pubdate:string,category:array<string>,creator:string,description:string,content:string,guid:string>"
FEED = f"kind string, title string, links array<{LINK}>, ttl int, updateperiod string, category array<string>, items array<{ITEM}>"


def decode_payload(body: bytes | str | None, charset: str | None = None) -> str | None:
    """Bytes by the given or declared charset, where gb2312 and none at all mean gbk for pages and UTF-8 for XML."""
    if body is None or isinstance(body, str):
        return body
    declared = re.match(rb"\s*<\?xml[^>]*encoding=[\"']([A-Za-z0-9._-]+)", body[:200])
    name = (charset or (declared[1].decode() if declared else "utf-8")).lower()
    try:
        return body.decode("gbk" if name in ("gb2312", "gbk") else name, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _texts(e: ET.Element, name: str) -> list[str]:
    return [(k.text or "") for k in e if _local(k) == name]


def _text(e: ET.Element, name: str) -> str:
    """The last of several, as a decoder that overwrites leaves it; '' if there is none."""
    return (_texts(e, name) or [""])[-1]


def _links(e: ET.Element) -> list[dict]:
    return [{"rel": k.get("rel", ""), "href": k.get("href", "")} for k in e if _local(k) == "link"]


def _int(s: str) -> int:
    try:
        return int(s.strip())
    except ValueError:
        return 0


def parse_feed(xml: str | None) -> dict | None:
    """An RSS document, else an Atom one, else nothing. A document without a link is invalid."""
    try:
        root = ET.fromstring(re.sub(r"\A\s*<\?xml[^>]*\?>", "", xml or ""))
    except ET.ParseError:
        return None
    if root.tag == "rss":
        channel = next((k for k in root if _local(k) == "channel"), None)
        if channel is None or not _links(channel):
            return None
        period = [k.text or "" for k in channel if k.tag == ATOM + "updatePeriod"]
        items = []
        for i in (k for k in channel if _local(k) == "item"):
            content = [k.text or "" for k in i if k.tag == CONTENT + "encoded"]
            items.append({"title": _text(i, "title"), "link": _text(i, "link"), "links": _links(i), "pubdate": _text(i, "pubDate"), "category": _texts(i, "category"), "creator": _text(i, "creator"), "description": _text(i, "description"), "content": (content or [""])[-1], "guid": _text(i, "guid")})
        return {"kind": "rss", "title": _text(channel, "title"), "links": _links(channel), "ttl": _int(_text(channel, "ttl")), "updateperiod": (period or [""])[-1], "category": _texts(channel, "category"), "items": items}
    if root.tag == ATOM + "feed":
        if not _links(root):
            return None
        items = []
        for i in (k for k in root if _local(k) == "entry"):
            author = next((k for k in i if _local(k) == "author"), None)
            items.append({"title": _text(i, "title"), "link": "", "links": _links(i), "pubdate": _text(i, "updated"), "category": [], "creator": _text(author, "name") if author is not None else "", "description": _text(i, "summary"), "content": _text(i, "content"), "guid": _text(i, "id")})
        terms = [k.get("term", "") for k in root if _local(k) == "category"]
        return {"kind": "atom", "title": _text(root, "title"), "links": _links(root), "ttl": 0, "updateperiod": "", "category": terms, "items": items}
    return None


def read_feeds(payloads: DataFrame, uri: str = "uri", body: str = "xml") -> DataFrame:
    """(uri, feed STRUCT): the parsed document of each payload; feed is null where it is neither RSS nor Atom."""
    kind = T.StructType([T.StructField("uri", T.StringType()), T.StructField("feed", T.StructType.fromDDL(FEED))])
    arrow = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uris, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array([parse_feed(decode_payload(t)) for t in texts], arrow.field("feed").type)], names=["uri", "feed"])

    return payloads.selectExpr(f"`{uri}` AS uri", f"`{body}` AS body").mapInArrow(run, kind)


def _arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


# -- projections -------------------------------------------------------------------------------------------------


def first_self(links: Column, uri: Column) -> Column:
    """P5: the first link to itself, else the address it was fetched from."""
    return F.coalesce(F.get(F.filter(links, lambda x: x["rel"] == "self"), F.lit(0))["href"], uri)


def last_link(links: Column) -> Column:
    """The last link to itself if there is one with an address, else the last alternate, else ''."""
    last = lambda rel: F.coalesce(F.try_element_at(F.filter(links, lambda x: x["rel"] == rel), F.lit(-1))["href"], F.lit(""))
    return F.when(F.length(last("self")) > 0, last("self")).otherwise(last("alternate"))


def ttl_minutes(period: Column, ttl: Column) -> Column:
    """Minutes of the update period, else those given, else 60."""
    out = None
    for name, minutes in PERIODS.items():
        out = F.when(period == name, minutes) if out is None else out.when(period == name, minutes)
    return out.when(F.coalesce(ttl, F.lit(0)) != 0, ttl).otherwise(60).cast("int")


def to_feeds(parsed: DataFrame, now: Column) -> DataFrame:
    """One row of the store for each parsed document."""
    f = F.col("feed")
    return parsed.where("feed IS NOT NULL").select(
        first_self(f["links"], F.col("uri")).alias("link"), f["title"].alias("title"), now.alias("refresh"), ttl_minutes(f["updateperiod"], f["ttl"]).alias("ttl"), f["category"].alias("category"), F.lit(False).alias("disabled")
    )


_MAIL = r"\A(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), \d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}\z"


def mail_time(c: Column, now: Column) -> Column:
    """The one layout with a numeric zone; any other string means now."""
    return F.coalesce(F.when(c.rlike(_MAIL), F.timestamp_micros(utc_micros(c, F.lit("UTC")))), now)


def any_time(c: Column, now: Column, compat: bool = False) -> Column:
    """The time a string denotes, else now. With `compat` the older behaviour, whose test is inverted."""
    t = F.timestamp_micros(utc_micros(c, F.lit("UTC")))
    zero = F.to_timestamp(F.lit("0001-01-01 00:00:00"))
    return F.when(c.rlike(r"\A[A-Z][a-z]{2},? "), now).otherwise(zero) if compat else F.coalesce(t, now)


def to_entries(parsed: DataFrame, now: Column) -> DataFrame:
    """Items as entries with the text to clean in `body`.

    The guid is the link where it is empty; categories of the feed follow those of an RSS item, an Atom entry has only the
    feed's; the longer of description and content is taken.
    """
    x = parsed.where("feed IS NOT NULL").select("uri", "feed", F.explode("feed.items").alias("i"))
    rss, i = F.col("feed.kind") == "rss", F.col("i")
    link = F.when(rss, i["link"]).otherwise(last_link(i["links"]))
    return x.select(
        i["title"].alias("title"),
        i["creator"].alias("author"),
        F.when(F.length(i["guid"]) == 0, link).otherwise(i["guid"]).alias("guid"),
        link.alias("link"),
        first_self(F.col("feed.links"), F.col("uri")).alias("feed"),
        F.when(rss, mail_time(i["pubdate"], now)).otherwise(any_time(i["pubdate"], now)).alias("updated"),
        now.alias("created"),
        F.lit(False).alias("readed"),
        F.when(rss, F.concat(i["category"], F.col("feed.category"))).otherwise(F.col("feed.category")).alias("category"),
        X.longer(i["description"], i["content"]).alias("body"),
    )


def with_summary(entries: DataFrame) -> DataFrame:
    """Clean `body` to `summary` and add status, statis and image."""
    from feedloom.operators.dom import with_fragment

    x = with_fragment(entries, "body", "link", "__f")
    n = F.size("__f.images")
    return x.select(
        *[c for c in entries.columns if c != "body"],
        F.col("__f.html").alias("summary"),
        store.summary_status(F.col("__f.words"), n).alias("status"),
        F.struct(F.col("__f.words").alias("words"), n.cast("int").alias("imgs")).alias("statis"),
        F.col("__f.images").alias("image"),
    )


def rejected(parsed: DataFrame) -> DataFrame:
    """(link, disabled) of payloads that are no feed, as `store.disable` takes them."""
    return parsed.where("feed IS NULL").select(F.col("uri").alias("link"), F.lit(True).alias("disabled"))


# -- OPML --------------------------------------------------------------------------------------------------------

def _chain(path: tuple | None) -> list[str]:
    out = []
    while path is not None:
        path, name = path
        out.append(name)
    return out[::-1]


OUTLINE = "uri string, link string, title string, htmlurl string, category array<string>"


def outlines(xml: str | None, keep_category: bool = False) -> list[dict]:
    """Outlines with an address below another outline, in order; what is below such a one is not looked at.

    Top outlines are folders even if they have an address. The path of folders is dropped unless `keep_category`.
    """
    try:
        root = ET.fromstring(re.sub(r"\A\s*<\?xml[^>]*\?>", "", xml or ""))
    except ET.ParseError:
        return []
    found: list[dict] = []

    for body in (k for k in root if _local(k) == "body"):
        todo = [(top, (None, top.get("title", ""))) for top in reversed(list(body)) if _local(top) == "outline"]
        while todo:  # an outline, and its folders as a chain from the innermost
            e, path = todo.pop()
            if e.get("xmlUrl") and path[0] is not None:
                found.append({"link": e.get("xmlUrl"), "title": e.get("title", ""), "htmlurl": e.get("htmlUrl", ""), "category": _chain(path[0]) if keep_category else []})
            else:
                todo += [(k, (path, k.get("title", ""))) for k in reversed(list(e)) if _local(k) == "outline"]
    return found


def read_opml(payloads: DataFrame, now: Column, uri: str = "uri", body: str = "xml", keep_category: bool = False) -> DataFrame:
    """The feeds of OPML documents as rows of the store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"uri": u, **o} for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for o in outlines(decode_payload(t), keep_category)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("uri", pa.string()), ("link", pa.string()), ("title", pa.string()), ("htmlurl", pa.string()), ("category", pa.list_(pa.string()))]))

    x = payloads.selectExpr(f"`{uri}` AS uri", f"`{body}` AS body").mapInArrow(run, OUTLINE)
    return x.select("link", "title", now.alias("refresh"), F.lit(60).alias("ttl"), "category", F.lit(False).alias("disabled"))
