"""Fetched bytes: pages, rule lists, images and search results as tables.

There is no network in a plan. What a crawler fetched lies as files or as a table (uri, status, content_type,
content_encoding, body); these functions decode and type it.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of files."""
    return spark.read.format("binaryFile").load(path)


def rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file, numbered in order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def inflate(body: bytes | None, encoding: str | None) -> bytes | None:
    """The body without its transfer coding; null if it is broken."""
    try:
        if body is not None and (encoding or "").lower() == "gzip":
            return gzip.decompress(body)
        if body is not None and (encoding or "").lower() == "deflate":
            try:
                return zlib.decompress(body)
            except zlib.error:
                return zlib.decompress(body, -15)
    except (OSError, zlib.error, EOFError):
        return None
    return body


_META = re.compile(rb"<meta\b([^<>]*)>", re.I)
_ATTRIBUTE = re.compile(rb"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def sniff(body: bytes) -> str:
    """The charset of the first meta element that tells of one, '' if none does.

    The content of a content-type counts even if it names none, and before a charset of the same element.
    """
    for m in _META.finditer(body):
        named = {a[1].lower(): (a[2] or a[3] or a[4] or b"").decode("latin-1") for a in _ATTRIBUTE.finditer(m[1])}
        if named.get(b"http-equiv", "").lower() == "content-type":
            c = _CHARSET.search(named.get(b"content", ""))
            return c[1] if c else ""
        if named.get(b"charset"):
            return named[b"charset"]
    return ""


def to_text(body: bytes | None, content_type: str | None) -> str | None:
    """By the charset of the header, else of the page; none or gb2312 means gbk."""
    if body is None:
        return None
    c = _CHARSET.search(content_type or "")
    name = c[1] if c else sniff(body)
    name = "gbk" if not name or name.lower() == "gb2312" else name
    try:
        return body.decode(name, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def pages(fetched: DataFrame) -> DataFrame:
    """(uri, html) of the rows of (uri, status, content_type, content_encoding, body) fetched with success."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, t, e, body = (c.to_pylist() for c in b.columns)
            html = [to_text(inflate(x, enc), kind) for x, kind, enc in zip(body, t, e, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(html, pa.string())], names=["uri", "html"])

    return fetched.where("status = 200").select("uri", "content_type", "content_encoding", "body").mapInArrow(run, "uri string, html string")


def file_suffix(disposition: Column, media: Column) -> Column:
    """The suffix of a file: that of the name in the header, else a point and the media subtype."""
    name = F.regexp_extract(disposition, r"filename\*?=(?:UTF-8'')?([^;]+)", 1)
    name = F.btrim(F.url_decode(F.regexp_replace(name, "%(?![0-9A-Fa-f]{2})", "%25")), F.lit(" \\t\"'"))
    subtype = F.trim(F.substring_index(F.substring_index(media, ";", 1), "/", -1))
    return F.when(F.length(name) > 0, name).otherwise(F.when(F.length(media) > 0, F.concat(F.lit("."), subtype)).otherwise(""))


# First bytes of image formats.
MAGIC = {"bmp": "424D", "gif": "47494638", "png": "89504E47", "tiff": "49492A00", "tiff2": "4D4D002A", "jpeg": "FFD8FFE0", "jpeg2": "FFD8FFE1"}


def magic(hex_bytes: Column) -> Column:
    """The image format by the first bytes, given as upper-case hex; null if unknown."""
    out = None
    for name, prefix in MAGIC.items():
        hit = F.upper(hex_bytes).startswith(prefix)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def probe(body: bytes | None) -> dict:
    """Format and size of a GIF, PNG or JPEG by its header; nulls where it is none of them or too short."""
    none = {"mediatype": None, "width": None, "height": None, "filelength": len(body) if body is not None else None}
    if body is None or len(body) < 16:
        return none
    if body[:6] in (b"GIF87a", b"GIF89a"):
        w, h = struct.unpack("<HH", body[6:10])
        return none | {"mediatype": "gif", "width": w, "height": h}
    if body[:8] == b"\x89PNG\r\n\x1a\n" and len(body) >= 24:
        w, h = struct.unpack(">II", body[16:24])
        return none | {"mediatype": "png", "width": w, "height": h}
    if body[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(body) and body[at] == 0xFF:
            kind = body[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", body[at + 5 : at + 9])
                return none | {"mediatype": "jpeg", "width": w, "height": h}
            at += 1 if kind == 0xFF else 2 + struct.unpack(">H", body[at + 2 : at + 4])[0]
    return none


def probe_images(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """S14 over a table: (key, mediatype, width, height, filelength)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("key", pa.string()), ("mediatype", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("filelength", pa.int64())])
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"key": k, **probe(x)} for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], schema=kind)

    return files.selectExpr(f"cast(`{key}` as string) AS key", f"`{content}` AS content").mapInArrow(run, "key string, mediatype string, width int, height int, filelength bigint")


# -- search results ----------------------------------------------------------------------------------------------

FOUND = "struct<responseData:struct<query:string,entries:array<struct<title:string,link:string,contentSnippet:string,url:string>>>,responseDetails:string,responseStatus:int>"
LOADED = "struct<responseData:struct<feed:struct<feedUrl:string,title:string,link:string,description:string,author:string,type:string,entries:array<struct<title:string,link:string,author:string,content:string,contentSnippet:string,publishedDate:string,categories:array<string>>>>>,responseDetails:string,responseStatus:int>"


def found_feeds(df: DataFrame, json: str, key: str) -> DataFrame:
    """(key, title, link, snippet, url) of the results of a feed search; broken JSON gives none."""
    x = df.select(key, F.from_json(json, FOUND).alias("r")).select(key, F.explode("r.responseData.entries").alias("e"))
    return x.select(key, "e.title", "e.link", F.col("e.contentSnippet").alias("snippet"), "e.url")


def loaded_entries(df: DataFrame, json: str, key: str) -> DataFrame:
    """The entries of a loaded feed."""
    x = df.select(key, F.from_json(json, LOADED).alias("r")).select(key, F.col("r.responseData.feed").alias("f"))
    return x.select(key, F.col("f.feedUrl").alias("feed"), F.explode("f.entries").alias("e")).select(key, "feed", "e.title", "e.link", "e.author", "e.content", F.col("e.publishedDate").alias("published"), "e.categories")


def route(query: Column) -> Column:
    """An absolute address is loaded, anything else is searched for."""
    return F.when(query.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "load").otherwise("find")


def responses(df: DataFrame) -> Column:
    """Each row as a JSON object."""
    return F.to_json(F.struct(*df.columns))
