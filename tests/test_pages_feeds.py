import gzip

from pyspark.sql import functions as F

from feedloom.operators import article, dom
from feedloom.sources import feeds, fetched

LONG = "word " * 90


def tags(html, url="http://h.test/a/"):
    return [n.tag for n in dom.Page(html, url).article.walk()]


def test_tree_builder():
    body = dom.parse("<p>a<p>b<ul><li>x<li>y</ul><script></p></script><table><tr><td>1<td>2</table>")
    found = [n.tag for n in body.walk() if n.tag != "#text"]
    assert found == ["#document", "html", "head", "body", "p", "p", "ul", "li", "li", "script", "table", "tbody", "tr", "td", "td"]
    again = [n.tag for n in dom.parse("<p><b>x</p><p>y</p>").walk() if n.tag in ("p", "b")]
    assert again == ["p", "b", "p", "b"]  # formatting is reopened


def test_cleaner_drops_and_renames():
    p = dom.Page('<div class="sidebar">no</div><div id="xextrax">no</div><nav>n</nav><!-- c --><p>a<br>b</p><p style="display:none">hid</p><a href="x"><img src=i width=100 height=100></a><a><img src=j width=100px height=9></a>', "http://h.test/a/")
    assert p.article.inner_text() == "abhid"
    assert [n.attrs.get("src") for n in p.article.walk() if n.tag == "img"] == [None, "j"]
    assert [n.attrs.get("href") for n in p.article.walk() if n.tag == "a"] == ["http://h.test/a/x", None]
    assert "input" in [n.tag for n in p.article.walk()] and p.counts["link_imgs"] == 2


def test_one_heading_narrows():
    one = f"<p>out</p><div><h1>T</h1><p>{LONG}</p></div>"
    assert "out" not in dom.Page(one, "").article.inner_text()
    assert "out" in dom.Page(one + "<h1>again</h1>", "").article.inner_text()
    assert "out" not in dom.Page(one.replace("h1", "h2"), "").article.inner_text()


def test_fragment():
    f = dom.fragment('<p>Hello <a href="x">link</a> tail</p><script>bad</script>', "http://h.test/a/")
    assert f == {"html": '<div><p>Hello<a href="http://h.test/a/x">link</a> tail</p></div>', "words": 3, "links": 1, "images": []}
    assert dom.fragment(None, None)["html"] is None and dom.fragment("", "")["words"] == 0


def test_extract(spark):
    html = f'<div><p>{LONG}</p><p>{LONG}<a href="/l">z</a></p><img src="i.png"></div><ul><li><a href=1>aaa</a><li><a href=2>bbb</a></ul>'
    d = spark.createDataFrame([(1, "http://h.test/", html), (2, None, None), (3, "", ""), (4, "u", "<p>short")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in article.extract(dom.nodes(d)).collect()}
    assert len(got) == 4 and got[2]["word_count"] == 0 and got[2]["images"] == []
    assert got[1]["images"] == ["i.png"] and got[1]["link_count"] == 1 and "aaa" not in got[1]["text"]
    assert got[1]["word_count"] == 2 * (len(dom._TOKEN.findall(LONG)) - 1)  # the blank at the end of each text goes
    assert article.extract(dom.nodes(d.limit(0))).count() == 0


RSS = """<?xml version="1.0"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:sy="http://purl.org/rss/1.0/modules/syndication/">
<channel><title>T</title><link>http://x/</link><atom:link rel="self" href="http://x/feed"/><sy:updatePeriod>daily</sy:updatePeriod><category>c</category>
<item><title>a</title><link>http://x/1</link><pubDate>Mon, 2 Jan 2006 15:04:05 -0700</pubDate><category>k</category><dc:creator>me</dc:creator><description>abcd</description><content:encoded>efgh</content:encoded></item>
<item><title>b</title><link>http://x/2</link><pubDate>Mon, 2 Jan 2006 15:04:05 GMT</pubDate><guid>g</guid></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><link rel="self" href="http://f/"/><category term="x"/><entry><title>E</title><link href="n"/><link rel="alternate" href="1"/><link rel="alternate" href="2"/><summary>a</summary></entry></feed>'


def test_feeds(spark):
    now = F.lit("2020-01-01").cast("timestamp")
    p = feeds.read_feeds(spark.createDataFrame([("u1", RSS), ("u2", ATOM), ("u3", "<rss><channel><title>no link</title></channel></rss>"), ("u4", "<broken"), ("u5", None)], "uri string, xml string"))
    got = {r["link"]: r for r in feeds.to_feeds(p, now).collect()}
    assert set(got) == {"http://x/feed", "http://f/"}
    assert got["http://x/feed"]["ttl"] == 60  # the period of another namespace does not count
    e = {r["link"]: r for r in feeds.with_summary(feeds.to_entries(p, now)).collect()}
    assert set(e) == {"http://x/1", "http://x/2", "2"}
    one = e["http://x/1"]
    assert one["guid"] == "http://x/1" and one["category"] == ["k", "c"] and one["summary"] == "<div><p>efgh</p></div>" and one["author"] == "me"
    assert str(one["updated"]) == "2006-01-02 22:04:05" and str(e["http://x/2"]["updated"]) == "2020-01-01 00:00:00"
    assert e["2"]["category"] == ["x"]
    assert sorted(r["link"] for r in feeds.rejected(p).collect()) == ["u3", "u4", "u5"]


OPML = '<opml><body><outline title="news"><outline title="A" xmlUrl="a"><outline title="in" xmlUrl="i"/></outline><outline title="deep"><outline title="B" xmlUrl="b"/></outline></outline><outline title="top" xmlUrl="t"/></body></opml>'


def test_opml():
    assert [(o["link"], o["category"]) for o in feeds.outlines(OPML)] == [("a", []), ("b", [])]
    assert feeds.outlines(OPML, True)[1]["category"] == ["news", "deep"]
    assert feeds.outlines("<x") == [] and feeds.outlines(None) == []


def test_bytes(spark):
    page = '<meta charset="gb2312">中文'
    assert fetched.to_text(page.encode("gbk"), None) == page
    assert fetched.to_text("é".encode(), "text/html; charset=UTF-8") == "é"
    assert fetched.to_text("中".encode("gbk"), None) == "中" and fetched.to_text(None, None) is None
    rows = [("a", 200, None, "gzip", gzip.compress(b"<p>x")), ("b", 404, None, None, b"no"), ("c", 200, None, "gzip", b"broken")]
    got = fetched.pages(spark.createDataFrame(rows, "uri string, status int, content_type string, content_encoding string, body binary")).collect()
    assert [tuple(r) for r in got] == [("a", "<p>x"), ("c", None)]
    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    gif = b"GIF89a" + (3).to_bytes(2, "little") + (4).to_bytes(2, "little") + b"\x00" * 8
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x06" + b"\x00" * 12
    assert [(fetched.probe(x)["mediatype"], fetched.probe(x)["width"], fetched.probe(x)["height"]) for x in (png, gif, jpg, b"x" * 20, b"", None)] == [("png", 640, 480), ("gif", 3, 4), ("jpeg", 6, 5), (None, None, None), (None, None, None), (None, None, None)]


def test_suffix(spark):
    df = spark.createDataFrame([('attachment; filename="a%20b.jpg"', "image/png"), ("", "image/png; q=1"), ("", "")], "d string, m string")
    assert [r[0] for r in df.select(fetched.file_suffix(F.col("d"), F.col("m"))).collect()] == ["a b.jpg", ".png", ""]


def test_pages_of_any_depth_and_width():
    import time

    hard = ["<div>" * 100000, "<div>x" * 30000, "<ul>" + "<li>x</li>" * 60000 + "</ul>", "<b>" * 50000 + "x", "<table><tr><td>" * 20000 + "x", "<a>x" * 30000, "<form>" * 50000, "<p></p>" * 50000 + "x", "<!--" * 50000, '<a "' * 50000, "<object>" * 50000]
    for page in hard:
        begun = time.process_time()
        rows = dom._rows(1, dom.Page(page, ""))
        dom.fragment(page, "")
        assert rows and time.process_time() - begun < 12, page[:20]
    assert dom.fragment("<div>" * 100000 + "deep", "")["html"] == "<div><p>deep</p></div>"


def test_sums_below_each_node():
    page = dom.Page("<div><p>one two<a href=x>three <a href=y>four</a></a><img src=i><object>five</object></p><form>six</form></div>", "")
    names = [f.name for f in dom._NODE]
    rows = [dict(zip(names, r, strict=True)) for r in dom._rows(7, page)]
    p = next(r for r in rows if r["tag"] == "p")
    assert (p["words"], p["anchor_words"], p["out_words"], p["links"], p["anchors"], p["imgs"], p["objects"]) == (5, 2, 3, 2, 2, 1, 1)  # links do not nest: the second closes the first
    assert p["role"] == "block" and p["block_text"] == "one twothreefour" and p["block_images"] == ["i"]
    assert all(r["end_id"] == max(x["node_id"] for x in rows if x["node_id"] == r["node_id"] or r["node_id"] in _above(rows, x["node_id"])) for r in rows)
    assert [r["points"] for r in rows if r["tag"] == "div"] == [2]


def test_outlines_of_any_depth():
    deep = "<opml><body>" + '<outline title="f">' * 20000 + '<outline title="A" xmlUrl="a"/>' + "</outline>" * 20000 + "</body></opml>"
    assert [(o["link"], o["category"]) for o in feeds.outlines(deep)] == [("a", [])]
    assert feeds.outlines(deep, True)[0]["category"] == ["f"] * 20000


def _above(rows, i):
    up = {r["node_id"]: r["parent_id"] for r in rows}
    out = set()
    while i >= 0:
        i = up[i]
        out.add(i)
    return out
