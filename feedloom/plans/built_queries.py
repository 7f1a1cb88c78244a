"""Queries over pages, payloads and bytes that are built from whole tables, so that SQL can tell what must come out.

The page operators read HTML, which SQL can't parse. Here the HTML is written from the lines of documents by rules that
SQL knows too, so each operator is compared with plain arithmetic over the lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import text as X
from feedloom.operators import article, dom, rules, store
from feedloom.plans import page_queries, pipelines
from feedloom.plans.page_queries import _xml
from feedloom.plans.store_queries import _NOW, _WORDS, now
from feedloom.session import shared_folder, spread, strip_space, table
from feedloom.sources import feeds as S
from feedloom.sources import fetched
from feedloom.streaming import ingest

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


# -- lines of documents ------------------------------------------------------------------------------------------

_CONTROLS = r"[\x00-\x1F\x7F-\x9F]"
_SPACE_SQL = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _plain(c: str) -> str:
    """SQL of a line without control characters and without white space at its ends."""
    return rf"regexp_replace(regexp_replace({c}, '[\x{{00}}-\x{{1F}}\x{{7F}}-\x{{9F}}]', ' ', 'g'), '^{_SPACE_SQL}|{_SPACE_SQL}$', '', 'g')"


def _words(c: str) -> str:
    return "(" + _WORDS.replace("T,", f"{c},") + ")"


def _escaped_sql(c: str) -> str:
    return f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')"


_LINES = f"""
WITH r AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, pos, {_plain("raw")} AS line FROM r),
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, line, {_words("line")} AS w FROM p WHERE line <> '')
"""
_NO_LINES = "d AS (SELECT doc_id FROM documents)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lines ARRAY): the lines of each document that are not blank, as they come out of a page."""
    one = lambda x: strip_space(F.regexp_replace(x, _CONTROLS, " "))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), one), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", lines.alias("lines"))


def _text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")


def _joined(each) -> Column:
    return F.array_join(F.transform("lines", each), "")


def _page(spark: SparkSession, d: str, html: Column) -> DataFrame:
    return spread(_lines(spark, d).select(F.col("doc_id").alias("page_id"), F.lit("http://h.test/a/").alias("url"), html.alias("html")))


# -- pages of groups of paragraphs -------------------------------------------------------------------------------

#: Lines of a group; every fifth kind of line is linked, has an image or is hidden; groups have one of three classes.
GROUP = 2
_HEAD = '<html><head><title>t</title></head><body><nav>menu</nav><!-- c --><script>x</script><div class="sidebar"><p>away</p></div><div class="wrap">'


def _groups() -> Column:
    def paragraph(x: Column, i: Column) -> Column:
        body = F.when(i % 5 == 2, F.concat(F.lit('<p><a href="x/'), i.cast("string"), F.lit('">'), _text(x), F.lit("</a></p>")))
        body = body.when(i % 5 == 3, F.concat(F.lit("<p>"), _text(x), F.lit('<img src="'), i.cast("string"), F.lit('.png"></p>')))
        body = body.when(i % 5 == 4, F.concat(F.lit('<p style="display: none">'), _text(x), F.lit("</p>"))).otherwise(F.concat(F.lit("<p>"), _text(x), F.lit("</p>")))
        g = F.call_function("div", i, F.lit(GROUP)) % 3
        name = F.when(g == 0, "grp").when(g == 1, "tool").otherwise("story")
        return F.concat(F.when(i % GROUP == 0, F.concat(F.when(i > 0, "</div>").otherwise(""), F.lit('<div class="'), name, F.lit('">'))).otherwise(""), body)

    return F.concat(F.lit(_HEAD), _joined(paragraph), F.when(F.size("lines") > 0, "</div>").otherwise(""), F.lit("</div></body></html>"))


_GROUPS = (
    _LINES
    + f""", {_NO_LINES},
k AS (SELECT *, i // {GROUP} AS g, i % 5 = 2 AS linked, i % 5 = 3 AS pictured, i % 5 = 4 AS hidden FROM l),
f AS (SELECT doc_id, g, CASE g % 3 WHEN 0 THEN 'grp' WHEN 1 THEN 'tool' ELSE 'story' END AS class,
  CAST(sum(CASE WHEN hidden THEN 0 ELSE w END) AS BIGINT) AS words, CAST(sum(CASE WHEN linked THEN w ELSE 0 END) AS BIGINT) AS anchor_words, count(*) FILTER (linked) AS anchors, count(*) FILTER (pictured) AS imgs,
  CAST(sum(CASE WHEN hidden OR linked THEN 0 ELSE w END) AS BIGINT) AS out_words, CAST(sum(CASE WHEN hidden THEN 0 ELSE 1 + least((w + 64) // 65, 3) END) AS BIGINT) AS points,
  CAST(sum(CASE WHEN hidden THEN 0 ELSE (1 + least((w + 64) // 65, 3)) // 2 END) AS BIGINT) AS half, count(*) FILTER (NOT hidden) AS blocks FROM k GROUP BY doc_id, g),
n AS (SELECT doc_id, g, class, words, anchor_words, anchors, imgs, out_words, points, blocks FROM f UNION ALL
  SELECT doc_id, -1, 'wrap', CAST(sum(words) AS BIGINT), CAST(sum(anchor_words) AS BIGINT), CAST(sum(anchors) AS BIGINT), CAST(sum(imgs) AS BIGINT), CAST(sum(out_words) AS BIGINT), CAST(sum(half) AS BIGINT), CAST(sum(blocks) AS BIGINT) FROM f GROUP BY doc_id),
s AS (SELECT doc_id, g, class, ((points + 5 + CASE class WHEN 'tool' THEN 25 WHEN 'story' THEN -25 ELSE 0 END) * (100 - CASE WHEN words = 0 THEN CASE WHEN anchors > 0 THEN 100 ELSE 0 END ELSE anchor_words * 100 // words END)) // 100 AS score FROM n WHERE blocks > 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, g) AS r FROM s) WHERE r = 1),
q AS (SELECT s.doc_id, s.g FROM s JOIN t USING (doc_id) WHERE (s.g = t.g) OR (s.g >= 0 AND t.g >= 0 AND (s.class = t.class OR s.score > greatest(10, t.score // 5)))),
b AS (SELECT k.doc_id, row_number() OVER (PARTITION BY k.doc_id ORDER BY i) - 1 AS block_idx, i, CASE WHEN hidden THEN '' ELSE line END AS line, CASE WHEN hidden THEN 0 ELSE w END AS words,
  CASE WHEN linked THEN w ELSE 0 END AS anchor_words, CASE WHEN linked THEN 1 ELSE 0 END AS anchors, CASE WHEN pictured THEN 1 ELSE 0 END AS imgs, CASE WHEN hidden THEN 1 ELSE 0 END AS forms
  FROM k JOIN (SELECT DISTINCT doc_id, g FROM q) q ON k.doc_id = q.doc_id AND (q.g = k.g OR q.g = -1)),
e AS (SELECT *, CASE WHEN words = 0 THEN CASE WHEN anchors > 0 THEN 100 ELSE 0 END ELSE anchor_words * 100 // words END AS density FROM b),
o AS (SELECT *, lag(density, 1, 0) OVER v AS pd, lag(words, 1, 0) OVER v AS pw, lead(density, 1, 0) OVER v AS nd, lead(words, 1, 0) OVER v AS nw, lead(forms, 1, 0) OVER v AS nf FROM e WINDOW v AS (PARTITION BY doc_id ORDER BY block_idx)),
c AS (SELECT *, CASE WHEN forms > 0 AND words = 0 THEN false WHEN words < 8 AND nd > 55 THEN false WHEN density > 33 THEN false
  ELSE (pd <= 55 AND (words > 20 OR nw > 15 OR pw > 8)) OR (pd > 55 AND (words > 40 OR nw > 17)) OR (pd <= 33 AND nd <= 33 AND words = 0 AND imgs > 0) OR (pd < 13 AND nd < 13 AND density < 13 AND words < 40) END AS good FROM o),
z AS (SELECT * FROM c WHERE good AND NOT (nf > 0 AND words < 16))
"""
)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return dom.nodes(_page(spark, d, _groups()))


def _named(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, g): the groups by number, -1 for what is around them."""
    x = nodes.where("tag = 'div'").groupBy("page_id").agg(F.array_sort(F.collect_list("node_id")).alias("ids"))
    return x.select("page_id", F.posexplode("ids").alias("at", "node_id")).select("page_id", "node_id", (F.col("at") - 1).alias("g"))


@query(_GROUPS + "SELECT doc_id AS page_id, g, words, anchor_words, anchors, imgs, out_words, anchors AS links FROM n")
def q_built_features(spark: SparkSession, d: str) -> DataFrame:
    """What is counted below each group."""
    nodes = _nodes(spark, d)
    x = article.features(nodes).join(_named(nodes), ["page_id", "node_id"])
    return x.select("page_id", "g", "words", "anchor_words", "anchors", "imgs", "out_words", "links")


@query(_GROUPS + "SELECT doc_id AS page_id, g, class, score FROM s")
def q_built_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A3, J2, X5, X7, X8."""
    nodes = _nodes(spark, d)
    return article.candidates(nodes).join(_named(nodes), ["page_id", "node_id"]).select("page_id", "g", "class", "score")


@query(_GROUPS + "SELECT doc_id AS page_id, g, class, score FROM t")
def q_built_top(spark: SparkSession, d: str) -> DataFrame:
    """A4, O4."""
    nodes = _nodes(spark, d)
    return article.top(article.candidates(nodes)).join(_named(nodes), ["page_id", "node_id"]).select("page_id", "g", "class", "score")


@query(_GROUPS + "SELECT doc_id AS page_id, g FROM q")
def q_built_siblings(spark: SparkSession, d: str) -> DataFrame:
    """J3, D11, X21."""
    nodes = _nodes(spark, d)
    return article.kept_siblings(nodes).join(_named(nodes), ["page_id", "node_id"]).select("page_id", "g")


@query(_GROUPS + "SELECT doc_id AS page_id, block_idx, line AS text, words, anchor_words, forms FROM b")
def q_built_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of the article in order."""
    return article.article_blocks(_nodes(spark, d)).select("page_id", "block_idx", "text", "words", "anchor_words", "forms")


@query(
    _GROUPS
    + """SELECT d.doc_id AS page_id, CAST(coalesce(sum(CASE WHEN anchors > 0 THEN 0 ELSE words END), 0) AS BIGINT) AS word_count, CAST(coalesce(sum(anchors), 0) AS BIGINT) AS link_count,
  coalesce(list(i || '.png' ORDER BY i) FILTER (imgs > 0), []) AS images, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS text FROM d LEFT JOIN z USING (doc_id) GROUP BY d.doc_id"""
)
def q_built_extract(spark: SparkSession, d: str) -> DataFrame:
    """The whole extraction."""
    return article.extract(_nodes(spark, d))


@query(
    _GROUPS
    + f"""SELECT d.doc_id AS page_id, '{article.BEFORE}' || coalesce(string_agg(CASE WHEN anchors > 0 THEN '<p><a href="http://h.test/a/x/' || i || '">' || {_escaped_sql("line")} || '</a></p>'
    WHEN imgs > 0 THEN '<p>' || {_escaped_sql("line")} || '<img src="' || i || '.png"/></p>' ELSE '<p>' || {_escaped_sql("line")} || '</p>' END, '' ORDER BY i), '') || '{article.BEHIND}' AS html
FROM d LEFT JOIN z USING (doc_id) GROUP BY d.doc_id"""
)
def q_built_documents(spark: SparkSession, d: str) -> DataFrame:
    """The article as a document of its own."""
    return article.extract(_nodes(spark, d), document=True).select("page_id", "html")


@query(
    _GROUPS
    + """SELECT d.doc_id AS page_id, CAST(1 + coalesce(sum(w), 0) AS INTEGER) AS text_words, CAST(coalesce(sum(CASE WHEN linked THEN w ELSE 0 END), 0) AS INTEGER) AS anchor_words, CAST(count(*) FILTER (linked) AS INTEGER) AS links,
  CAST(count(*) FILTER (pictured) AS INTEGER) AS imgs, 0 AS link_imgs, 0 AS lis, 0 AS h1 FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id"""
)
def q_built_counts(spark: SparkSession, d: str) -> DataFrame:
    """A2, D2."""
    return dom.page_counts(_page(spark, d, _groups())).select("page_id", "text_words", "anchor_words", "links", "imgs", "link_imgs", "lis", "h1")


def _fragments(spark: SparkSession, d: str, html: Column) -> DataFrame:
    x = dom.with_fragment(_page(spark, d, html), "html", "url", "f")
    return x.select("page_id", F.col("f.html").alias("html"), F.col("f.words").alias("words"), F.col("f.links").alias("links"), F.col("f.images").alias("images"))


@query(
    _GROUPS
    + f"""SELECT d.doc_id AS page_id, '<div>' || coalesce(string_agg(CASE WHEN linked THEN '<p><a href="http://h.test/a/x/' || i || '">' || {_escaped_sql("line")} || '</a></p>'
    WHEN pictured THEN '<p>' || {_escaped_sql("line")} || '<img src="' || i || '.png"/></p>' WHEN hidden THEN '<input>' || {_escaped_sql("line")} || '</input>' ELSE '<p>' || {_escaped_sql("line")} || '</p>' END, '' ORDER BY i), '') || '</div>' AS html,
  CAST(coalesce(sum(CASE WHEN linked THEN 0 ELSE w END), 0) AS INTEGER) AS words, CAST(count(*) FILTER (linked) AS INTEGER) AS links, coalesce(list(i || '.png' ORDER BY i) FILTER (pictured), []) AS images FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id"""
)
def q_built_fragments(spark: SparkSession, d: str) -> DataFrame:
    """D14, D15, P10, P11, X12, X26, F9."""
    return _fragments(spark, d, _groups())


# -- single rules of the cleaner ---------------------------------------------------------------------------------

_P = f"'<p>' || {_escaped_sql('line')} || '</p>'"


def _whole(each: str, where: str = "true") -> str:
    return _LINES + f", {_NO_LINES} SELECT d.doc_id AS page_id, '<div>' || coalesce(string_agg({each}, '' ORDER BY i) FILTER ({where}), '') || '</div>' AS html FROM d LEFT JOIN l ON d.doc_id = l.doc_id GROUP BY d.doc_id"


@query(_whole(_P, "i IS NOT NULL"))
def q_built_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Text between line breaks among blocks becomes paragraphs, formatting goes."""
    body = F.array_join(F.transform("lines", lambda x, i: F.concat(F.when(i % 2 == 0, F.concat(F.lit("<b>"), _text(x), F.lit("</b>"))).otherwise(F.concat(F.lit(" \n"), _text(x), F.lit("\t"))))), "<br>")
    return _fragments(spark, d, F.concat(F.lit("<body>"), body, F.lit("<br></body>"))).select("page_id", "html")


_DROPS = ['div class="comment"', 'div id="xextra"', "aside", 'div class="Menu"', "noscript", "marquee", 'div class="plain" id="a"']


@query(_whole(_P, "i % 7 IN (3, 6)"))
def q_built_dropped(spark: SparkSession, d: str) -> DataFrame:
    """elements that are dropped by their names, letter case counts, and by their tags."""
    names = F.array(*map(F.lit, _DROPS))
    return _fragments(spark, d, F.concat(F.lit("<body>"), _joined(lambda x, i: F.concat(F.lit("<"), F.get(names, i % 7), F.lit("><p>"), _text(x), F.lit("</p></"), F.substring_index(F.get(names, i % 7), " ", 1), F.lit(">"))), F.lit("</body>"))).select("page_id", "html")


@query(_whole(_P, "i IS NOT NULL"))
def q_built_empty(spark: SparkSession, d: str) -> DataFrame:
    """Comments, and elements with nothing in them."""
    return _fragments(spark, d, F.concat(F.lit("<body>"), _joined(lambda x, i: F.concat(F.lit("<div><span></span><ul><li></li></ul></div><!-- n --><p>"), _text(x), F.lit("</p><p></p>"))), F.lit("</body>"))).select("page_id", "html")


@query(
    _LINES
    + f""", {_NO_LINES}, n AS (SELECT doc_id, sum(octet_length(encode(line))) AS bytes FROM l GROUP BY doc_id)
SELECT d.doc_id AS page_id, '<div>' || CASE WHEN max(bytes) IS NULL THEN '' WHEN max(bytes) < 60 THEN '<p>' || string_agg({_escaped_sql("line")}, '' ORDER BY i) || '</p>' ELSE string_agg({_P}, '' ORDER BY i) END || '</div>' AS html
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id"""
)
def q_built_lists(spark: SparkSession, d: str) -> DataFrame:
    """items of a list of few bytes stand in one line."""
    return _fragments(spark, d, F.concat(F.lit("<body><ul>"), _joined(lambda x, i: F.concat(F.lit("<li>"), _text(x))), F.lit("</ul></body>"))).select("page_id", "html")


@query(_whole(f"""'<p>' || {_escaped_sql("line")} || '<a href="http://h.test/">' || CASE WHEN (i * 37 % 400) * (i * 37 % 400) < 32400 THEN '<img/>' ELSE '<img src="i.png"/>' END || '</a><img src="j.png"/></p>'""", "i IS NOT NULL"))
def q_built_images(spark: SparkSession, d: str) -> DataFrame:
    """Small linked images lose their address, attributes that are not kept go."""
    side = lambda i: (i * 37 % 400).cast("string")
    html = _joined(lambda x, i: F.concat(F.lit("<p>"), _text(x), F.lit('<a href="/" rel="x"><img alt="y" src="i.png" width="'), side(i), F.lit('" height="'), side(i), F.lit('"></a><img src="j.png" width="1" height="1"></p>')))
    return _fragments(spark, d, F.concat(F.lit("<body>"), html, F.lit("</body>"))).select("page_id", "html")


_ONE = _LINES + f", {_NO_LINES}, o AS (SELECT doc_id, string_agg(line, ' ' ORDER BY i) AS t FROM l GROUP BY doc_id), x AS (SELECT doc_id, coalesce(t, '') AS t, {_words(chr(34) + 't' + chr(34)).replace(chr(34), '')} AS w FROM d LEFT JOIN o USING (doc_id)) "
#: 599 words, so that a text must have some length to be a fifth or a third of its page.
_OUT = "out " * 299 + "out"


def _whole_text() -> Column:
    return _text(F.array_join("lines", " "))


@query(_ONE + "SELECT doc_id AS page_id, CAST(CASE WHEN octet_length(encode('T' || t)) > 195 AND 1 + coalesce(w, 0) >= 65 AND (1 + w) * 100 // (1 + w + 599 + 1) >= 20 THEN 1 + w ELSE 600 + coalesce(w, 0) END AS INTEGER) AS words FROM x")
def q_built_heading(spark: SparkSession, d: str) -> DataFrame:
    """Of a page with one heading what is around it, if that holds enough of the page."""
    html = F.concat(F.lit(f"<body><p>{_OUT}</p><div><h1>T</h1><p>"), _whole_text(), F.lit("</p></div></body>"))
    return _fragments(spark, d, html).select("page_id", "words")


@query(_ONE + "SELECT doc_id AS page_id, CAST(CASE WHEN coalesce(w, 0) * 100 // (1 + coalesce(w, 0) + 599) > 33 THEN 599 + w ELSE 599 END AS INTEGER) AS words FROM x")
def q_built_form(spark: SparkSession, d: str) -> DataFrame:
    """A form with more than a third of the words is a part of the page."""
    html = F.concat(F.lit("<body><form><p>"), _whole_text(), F.lit(f"</p></form><p>{_OUT}</p></body>"))
    return _fragments(spark, d, html).select("page_id", "words")


@query(
    _LINES
    + f""", {_NO_LINES}, c AS (SELECT doc_id, coalesce(sum(w) FILTER (i % 2 = 0), 0) AS a, coalesce(sum(w) FILTER (i % 2 = 1), 0) AS b FROM d LEFT JOIN l USING (doc_id) GROUP BY doc_id)
SELECT doc_id AS page_id, CAST(CASE WHEN (a + b) * 100 // (a + b + 599 + 1) < 33 THEN a + b + 599 WHEN b + 8 > a THEN b ELSE a END AS INTEGER) AS words FROM c"""
)
def q_built_table(spark: SparkSession, d: str) -> DataFrame:
    """Of a page laid out in a table the cell of most worth; a picture is worth eight words."""
    cell = lambda k: F.array_join(F.transform(F.filter("lines", lambda x, i: i % 2 == k), lambda x: F.concat(F.lit("<p>"), _text(x), F.lit("</p>"))), "")
    html = F.concat(F.lit(f"<body><p>{_OUT}</p><table><tr><td>"), cell(0), F.lit('<td><p><img src="i.png"></p>'), cell(1), F.lit("</table></body>"))
    return _fragments(spark, d, html).select("page_id", "words")


# -- bytes -------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id AS page_id, text AS html FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 4")
def q_decoded_pages(spark: SparkSession, d: str) -> DataFrame:
    """Bodies in the charset of the header, or of the page where that has none; failed ones go."""
    k = F.col("doc_id") % 5
    meta = F.concat(F.lit('<meta http-equiv="content-type" content="text/html; charset=utf-8">'), "text")
    x = table(spark, d, "documents").where("text IS NOT NULL").select(
        F.col("doc_id").cast("string").alias("uri"),
        F.when(k == 4, 404).otherwise(200).alias("status"),
        F.when(k == 1, "text/html; charset=UTF-8").when(k == 2, "text/html;charset=utf-16le").when(k == 3, "text/html").alias("content_type"),
        F.lit(None).cast("string").alias("content_encoding"),
        F.when(k == 1, F.encode("text", "UTF-8")).when(k == 2, F.encode("text", "UTF-16LE")).otherwise(F.encode(meta, "UTF-8")).alias("body"),
    )
    return fetched.pages(spread(x)).select(F.col("uri").cast("bigint").alias("page_id"), F.regexp_replace("html", r"\A<meta [^<>]*>", "").alias("html"))


@query("SELECT entry_id, CASE entry_id % 4 WHEN 0 THEN 'a b' || entry_id || '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '' ELSE entry_id || '.gif' END AS suffix FROM entries")
def q_file_suffix(spark: SparkSession, d: str) -> DataFrame:
    """The name of a file by its headers."""
    k, n = F.col("entry_id") % 4, F.col("entry_id").cast("string")
    disposition = F.when(k == 0, F.concat(F.lit('attachment; filename="a%20b'), n, F.lit('.jpg"'))).when(k == 3, F.concat(F.lit("inline; filename="), n, F.lit(".gif; size=1"))).otherwise("")
    x = table(spark, d, "entries").select("entry_id", disposition.alias("c"), F.when(k == 2, "").otherwise("image/png; q=1").alias("m"))
    return x.select("entry_id", fetched.file_suffix(F.col("c"), F.col("m")).alias("suffix"))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS key, CASE doc_id % 4 WHEN 0 THEN 'gif' WHEN 1 THEN 'png' WHEN 2 THEN 'jpeg' END AS mediatype, CASE WHEN doc_id % 4 < 3 THEN CAST(n_chars % 65536 AS INTEGER) END AS width,
  CASE WHEN doc_id % 4 < 3 THEN CAST(doc_id % 65536 AS INTEGER) END AS height, CAST(CASE doc_id % 4 WHEN 0 THEN 18 WHEN 1 THEN 24 WHEN 2 THEN 29 ELSE 8 END AS BIGINT) AS filelength FROM documents WHERE n_chars IS NOT NULL"""
)
def q_image_probe(spark: SparkSession, d: str) -> DataFrame:
    """Format and size by the first bytes."""
    big = lambda c, n: F.lpad(F.hex(c), n, "0")
    small = lambda c: F.concat(F.substring(big(c, 4), 3, 2), F.substring(big(c, 4), 1, 2))
    w, h, k = F.col("n_chars") % 65536, F.col("doc_id") % 65536, F.col("doc_id") % 4
    gif = F.concat(F.lit("474946383961"), small(w), small(h), F.repeat(F.lit("00"), 8))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 8), big(h, 8))
    jpeg = F.concat(F.lit("FFD8FFE000046162FFC0001108"), big(h, 4), big(w, 4), F.repeat(F.lit("00"), 12))
    x = table(spark, d, "documents").where("n_chars IS NOT NULL").select("doc_id", F.unhex(F.when(k == 0, gif).when(k == 1, png).when(k == 2, jpeg).otherwise(F.lit("0011223344556677"))).alias("body"))
    return fetched.probe_images(x, "doc_id", "body")


# -- payloads of feeds -------------------------------------------------------------------------------------------

_XML = r"regexp_replace(coalesce(C, ''), '[^\x{09}\x{0A}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]', '', 'g')"


def _xml_sql(c: str) -> str:
    return _XML.replace("C,", f"{c},")


@query(
    f"""WITH i AS (SELECT item_id, feed, {_xml_sql("title")} AS title, {_xml_sql("link")} AS link, {_xml_sql("guid")} AS guid, {_xml_sql("creator")} AS author, {_xml_sql("description")} AS a, {_xml_sql("content")} AS b, list_transform(coalesce(category, []), lambda x: {_xml_sql("x")}) AS c FROM rss_items)
SELECT title, link, CASE WHEN guid = '' THEN link ELSE guid END AS guid, author, feed, list_concat(c, ['all']) AS category, CASE WHEN octet_length(encode(a)) > octet_length(encode(b)) THEN a ELSE b END AS body FROM i"""
)
def q_rss_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Every item through an RSS document of its own."""
    cats = F.array_join(F.transform(F.coalesce("category", F.array().cast("array<string>")), lambda c: F.concat(F.lit("<category>"), _xml(c), F.lit("</category>"))), "")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), _xml(c), F.lit(f"</{name.split()[0]}>"))
    item = F.concat(tag("title", "title"), tag("link", "link"), tag("guid", "guid"), tag('dc:creator xmlns:dc="http://purl.org/dc/elements/1.1/"', "creator"), tag("description", "description"), tag('content:encoded xmlns:content="http://purl.org/rss/1.0/modules/content/"', "content"), cats)
    xml = F.concat(F.lit("<rss><channel><title>t</title><link>http://x/</link><category>all</category><item>"), item, F.lit("</item></channel></rss>"))
    got = S.to_entries(S.read_feeds(spread(table(spark, d, "rss_items").select(F.col("feed").alias("uri"), xml.alias("xml")))), now())
    return got.select("title", "link", "guid", "author", "feed", "category", "body")


@query(f"SELECT link, {_xml_sql('title')} AS title, CASE WHEN length(link) % 3 = 0 THEN CAST(CASE WHEN coalesce(ttl, 0) = 0 THEN 60 ELSE ttl END AS INTEGER) ELSE 60 END AS ttl, CASE WHEN length(link) % 3 = 0 THEN [] ELSE ['x'] END AS category FROM feeds WHERE length(link) % 3 < 2")
def q_feed_kinds(spark: SparkSession, d: str) -> DataFrame:
    """RSS, else Atom, else nothing."""
    k = F.length("link") % 3
    rss = F.concat(F.lit("<rss><channel><title>"), _xml("title"), F.lit("</title><link>http://x/</link><ttl>"), F.coalesce(F.col("ttl").cast("string"), F.lit("")), F.lit("</ttl></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>'), _xml("title"), F.lit('</title><link rel="alternate" href="http://x/"/><category term="x"/></feed>'))
    x = table(spark, d, "feeds").select(F.col("link").alias("uri"), F.when(k == 0, rss).when(k == 1, atom).otherwise("<html><title>no</title></html>").alias("xml"))
    return S.to_feeds(S.read_feeds(x), now()).select("link", "title", "ttl", "category")


@query("SELECT link, true AS disabled FROM feeds WHERE length(link) % 3 = 2")
def q_feed_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that are no feed."""
    k = F.length("link") % 3
    x = table(spark, d, "feeds").select(F.col("link").alias("uri"), F.when(k == 2, "<rss><channel></channel>").otherwise("<rss><channel><link>http://x/</link></channel></rss>").alias("xml"))
    return S.rejected(S.read_feeds(x))


@query(f"SELECT {_xml_sql('title')} AS title, link FROM feeds")
def q_payload_charset(spark: SparkSession, d: str) -> DataFrame:
    """Documents as bytes in the charset they declare."""
    utf16 = F.length("link") % 2 == 0
    body = F.concat(F.lit("<rss><channel><title>"), _xml("title"), F.lit("</title><link>http://x/</link></channel></rss>"))
    x = table(spark, d, "feeds").select(F.col("link").alias("uri"), F.when(utf16, F.encode(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>'), body), "UTF-8")).otherwise(F.encode(body, "UTF-8")).alias("xml"))
    return S.to_feeds(S.read_feeds(x), now()).select("title", "link")


@query("SELECT CAST(item_id AS BIGINT) AS key, feed, title, link, creator AS author, category AS categories FROM rss_items")
def q_loaded_entries(spark: SparkSession, d: str) -> DataFrame:
    """The entries of loaded feeds out of JSON."""
    e = F.struct("title", "link", F.col("creator").alias("author"), F.lit("c").alias("content"), F.col("category").alias("categories"))
    x = table(spark, d, "rss_items").select(F.col("item_id").alias("key"), F.to_json(F.struct(F.struct(F.struct(F.col("feed").alias("feedUrl"), F.array(e).alias("entries")).alias("feed")).alias("responseData"))).alias("json"))
    return fetched.loaded_entries(x, "json", "key").select("key", "feed", "title", "link", "author", "categories")


@query(f"SELECT entry_id, CASE WHEN updated IS NULL THEN {_NOW} ELSE date_trunc('second', updated) END AS updated FROM entries")
def q_any_time(spark: SparkSession, d: str) -> DataFrame:
    """Times of Atom entries; what is no time is now."""
    raw = F.when(F.col("entry_id") % 2 == 0, F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    return table(spark, d, "entries").select("entry_id", S.any_time(F.coalesce(raw, F.lit("no time")), now()).alias("updated"))


# -- flows -------------------------------------------------------------------------------------------------------


@query(f"SELECT link, ttl FROM feeds WHERE disabled = false AND refresh < {_NOW}")
def q_due(spark: SparkSession, d: str) -> DataFrame:
    """Feeds to fetch now."""
    return ingest.due(table(spark, d, "feeds"), now())


@query("SELECT entry_id, CASE WHEN batch_id % 2 = 0 THEN true ELSE NULL END AS ready, link FROM entries WHERE batch_id % 2 = 1")
def q_images_unready(spark: SparkSession, d: str) -> DataFrame:
    """L2."""
    x = table(spark, d, "entries").select("entry_id", F.when(F.col("batch_id") % 2 == 0, True).alias("ready"), "link")
    return store.images_unready(x)


_SOME = "http://kitchen.peliton.example/a/201001/archive?id=1078"


@query(f"SELECT entry_id, CASE WHEN link = '{_SOME}' THEN 2 ELSE status END AS status FROM entries")
def q_set_state(spark: SparkSession, d: str) -> DataFrame:
    """L7."""
    return store.set_state(table(spark, d, "entries"), _SOME, "").select("entry_id", "status")


@query(f"SELECT link, CASE WHEN feed IS NULL THEN refresh ELSE {_NOW} + to_minutes(coalesce(t, 0)) END AS refresh FROM feeds LEFT JOIN (SELECT feed, max(ttl) AS t FROM channels WHERE length(feed) % 2 = 0 GROUP BY feed) ON feed = link")
def q_touch_all(spark: SparkSession, d: str) -> DataFrame:
    """L6."""
    return store.touch_all(table(spark, d, "feeds"), table(spark, d, "channels").where("length(feed) % 2 = 0").select(F.col("feed").alias("link"), "ttl"), now()).select("link", "refresh")


@query(r"SELECT doc_id, length(regexp_replace(text, '[^。．？！，、；：“”﹃﹄‘’﹁﹂（）［］〔〕【】—…～《》〈〉﹏＿]', '', 'g')) AS stops FROM documents")
def q_stop_chars_cjk(spark: SparkSession, d: str) -> DataFrame:
    """The stop characters, which are tokens and no words."""
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", (X.tokens(c) - X.words(c)).alias("stops"))


SQL["q_opml_feeds"] = f"SELECT link, {_xml_sql('title')} AS title, 60 AS ttl FROM feeds"  # S10


@query(
    f"""WITH e AS (SELECT {_xml_sql("title")} AS title, {_xml_sql("id")} AS id, {_xml_sql("author.name")} AS author, {_xml_sql("summary.body")} AS body,
  coalesce(list_filter(link, lambda x: x.rel = 'self')[-1].href, '') AS s, coalesce(list_filter(link, lambda x: x.rel = 'alternate')[-1].href, '') AS a FROM atom_entries),
f AS (SELECT *, CASE WHEN s <> '' THEN s ELSE a END AS link FROM e) SELECT title, link, CASE WHEN id = '' THEN link ELSE id END AS guid, author, body FROM f"""
)
def q_atom_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Every entry through Atom documents."""
    return S.to_entries(S.read_feeds(spread(page_queries._atom(spark, d))), now()).select("title", "link", "guid", "author", "body")


def _rss_of(title: Column, link: Column) -> Column:
    return F.concat(F.lit("<rss><channel><title>"), title, F.lit("</title><link>http://x/</link><item><title>i</title><link>"), link, F.lit("</link></item></channel></rss>"))


@query(f"SELECT link, title FROM feeds WHERE length(link) % 2 = 0 UNION ALL SELECT link, {_xml_sql('title')} FROM feeds WHERE length(link) % 2 = 1")
def q_subscribe(spark: SparkSession, d: str) -> DataFrame:
    """V6: payloads of all feeds into a store that has half of them."""
    feeds = table(spark, d, "feeds")
    payloads = feeds.select(F.col("link").alias("uri"), _rss_of(_xml("title"), F.lit("http://x/1")).alias("xml"))
    return pipelines.subscribe(feeds.where("length(link) % 2 = 0"), payloads, now()).select("link", "title")


def _crawl(spark: SparkSession, d: str):
    items = table(spark, d, "rss_items")
    payloads = items.select(F.col("feed").alias("uri"), F.when(F.length("feed") % 4 == 0, "<no>").otherwise(_rss_of(_xml("title"), _xml("link"))).alias("xml"))
    return pipelines.crawl(table(spark, d, "feeds"), table(spark, d, "entries").where("batch_id % 2 = 0"), spread(payloads), now())


@query(f"SELECT DISTINCT {_xml_sql('link')} AS link FROM rss_items WHERE length(feed) % 4 <> 0 AND feed IN (SELECT link FROM feeds WHERE disabled = false) AND {_xml_sql('link')} NOT IN (SELECT coalesce(link, '') FROM entries WHERE batch_id % 2 = 0)")
def q_crawl_added(spark: SparkSession, d: str) -> DataFrame:
    """What a crawl of the items adds to a store that has half of the entries."""
    return _crawl(spark, d).added.select("link")


@query("SELECT link, CASE WHEN disabled = false AND length(link) % 4 = 0 AND link IN (SELECT feed FROM rss_items WHERE feed IS NOT NULL) THEN true ELSE disabled END AS disabled FROM feeds")
def q_crawl_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Feeds whose payload is none are disabled by the crawl."""
    return _crawl(spark, d).feeds.select("link", "disabled")


@query(SQL["q_built_extract"].replace("d.doc_id AS page_id", "CAST(d.doc_id AS VARCHAR) AS uri"))
def q_extract_flow(spark: SparkSession, d: str) -> DataFrame:
    """From fetched bytes to articles."""
    pages = _page(spark, d, _groups())
    fetched_pages = pages.select(F.col("page_id").cast("string").alias("uri"), F.lit(200).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"), F.lit(None).cast("string").alias("content_encoding"), F.encode("html", "UTF-8").alias("body"))
    return pipelines.extract(fetched_pages)


@query(_GROUPS + "SELECT i || '.png' AS link, min('http://h.test/' || doc_id) AS page FROM z WHERE imgs > 0 GROUP BY 1")
def q_page_images(spark: SparkSession, d: str) -> DataFrame:
    """V2: each image of the articles once."""
    return pipelines.images(article.extract(_nodes(spark, d)).withColumn("uri", F.concat(F.lit("http://h.test/"), "page_id")))


@query(
    """WITH f AS (SELECT link AS l, min(item_id) AS i FROM rss_items WHERE link IS NOT NULL GROUP BY link)
SELECT entry_id, CASE WHEN l IS NULL THEN status WHEN i % 2 = 0 AND i > 192 THEN 1 ELSE 2 END AS status, CASE WHEN l IS NULL THEN content.words ELSE CAST(i AS INTEGER) END AS words FROM entries LEFT JOIN f ON l = link"""
)
def q_fill_content(spark: SparkSession, d: str) -> DataFrame:
    """What was extracted becomes the content of entries; the first of several by its text and words."""
    x = table(spark, d, "rss_items").where("link IS NOT NULL").groupBy(F.col("link").alias("uri")).agg(F.min("item_id").alias("word_count"))
    x = x.select("uri", "word_count", F.when(F.col("word_count") % 2 == 0, "text").otherwise("").alias("text"), F.array().cast("array<string>").alias("images"))
    return pipelines.fill_content(table(spark, d, "entries"), x, "/cache").select("entry_id", "status", F.col("content.words").alias("words"))


@query("SELECT entry_id, length(h) < 5 AND (starts_with(h, 'kit') OR starts_with(h, 'te')) AS blocked FROM (SELECT entry_id, left(split_part(coalesce(link, ''), '/', 3), CAST(2 + entry_id % 5 AS INTEGER)) AS h FROM entries)")
def q_rule_short(spark: SparkSession, d: str) -> DataFrame:
    """J5e: rules of less than five bytes meet only texts of less than five bytes, from their start."""
    r = rules.load(spark.createDataFrame([(1, "||kit"), (2, "||te")], "line_no int, value string"))
    host = F.substring(F.coalesce(F.get(F.split("link", "/"), F.lit(2)), F.lit("")), F.lit(1), (2 + F.col("entry_id") % 5).cast("int"))
    return rules.blocked(table(spark, d, "entries").select("entry_id", F.concat(F.lit("http://"), host).alias("url")), r, "entry_id", "url").select("entry_id", "blocked")


@query("SELECT entry_id FROM entries WHERE regexp_matches(link, '/20(09|10)[0-9]+/') OR regexp_matches(link, 'id=[0-9]*7$')")
def q_rule_regex(spark: SparkSession, d: str) -> DataFrame:
    """J5f: regex rules, which are off unless asked for."""
    r = rules.load(spark.createDataFrame([(1, "//20(09|10)[0-9]+//"), (2, "/id=[0-9]*7$/")], "line_no int, value string"))
    return rules.matches_regex(table(spark, d, "entries").select("entry_id", "link"), r, "entry_id", "link")


@query("SELECT doc_id, n_chars > 0 AND (doc_id % 97) * 10 // greatest(n_chars, 1) >= 5 AS menu FROM documents WHERE n_chars IS NOT NULL")
def q_menu(spark: SparkSession, d: str) -> DataFrame:
    """A list most of whose items are links."""
    return table(spark, d, "documents").where("n_chars IS NOT NULL").select("doc_id", pipelines.is_menu(F.col("n_chars"), F.col("doc_id") % 97).alias("menu"))


@query("SELECT entry_id, link FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(link, '') ORDER BY batch_id % 3, entry_id) AS r FROM entries) WHERE r = 1")
def q_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Batches into a store in the shared folder, each of them twice, as after a failure."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4()}"
    work = ingest.insert_new(root, "entry_id")
    for k in (0, 1, 1, 2, 0):
        work(table(spark, d, "entries").where(f"batch_id % 3 = {k}"), k)
    ingest.compact(spark, root)
    return ingest.current(spark, root).select("entry_id", "link")
