import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from feedloom.plans import page_queries, pipelines
from feedloom.session import table
from tests.test_pages_feeds import RSS

FEEDS = "link string, title string, refresh timestamp, ttl int, category array<string>, disabled boolean"
ENTRIES = "link string, guid string, title string, author string, summary string, feed string, updated timestamp, created timestamp, readed boolean, category array<string>, status int, content struct<local:string,words:int,imgs:int>, statis struct<words:int,imgs:int>, image array<string>"
T = dt.datetime(2020, 1, 1)


def test_crawl(spark):
    f = spark.createDataFrame([("http://x/feed", "T", T, 60, [], False), ("bad", "B", T, 60, [], False), ("off", "O", T, 60, [], True)], FEEDS)
    e = spark.createDataFrame([("http://x/1", "g", "old", None, None, "http://x/feed", T, T, True, [], 0, None, None, [])], ENTRIES)
    p = spark.createDataFrame([("http://x/feed", RSS), ("bad", "<x"), ("off", RSS), ("unknown", RSS)], "uri string, xml string")
    got = pipelines.crawl(f, e, p, F.lit(T))
    assert {r["link"]: r["disabled"] for r in got.feeds.collect()} == {"http://x/feed": False, "bad": True, "off": True}
    assert [r["link"] for r in got.added.collect()] == ["http://x/2"]
    assert {r["link"]: r["title"] for r in got.entries.collect()} == {"http://x/1": "old", "http://x/2": "b"}
    assert pipelines.subscribe(f, p.where("uri = 'unknown'"), F.lit(T)).count() == 3
    due = pipelines.due(f, F.lit(T + dt.timedelta(minutes=5)))
    assert {r["link"]: r["refresh"] for r in due.collect()}["bad"] == T + dt.timedelta(minutes=65)


def test_extract_and_fill(spark):
    html = ("<div><p>" + "word " * 90 + "</p><img src='i.png'></div>").encode()
    x = pipelines.extract(spark.createDataFrame([("u", 200, "text/html; charset=utf-8", None, html), ("v", 500, None, None, b"x")], "uri string, status int, content_type string, content_encoding string, body binary"))
    assert [(r["uri"], r["images"]) for r in x.collect()] == [("u", ["i.png"])]
    assert [tuple(r) for r in pipelines.images(x).collect()] == [("i.png", "u")]
    e = spark.createDataFrame([("u", None, None, None, None, None, None, T, False, [], 0, None, None, [])], ENTRIES)
    row = pipelines.fill_content(e, x, "/cache").first()
    assert row["status"] == 1 and row["content"]["words"] == 179 and row["image"] == ["i.png"]
    assert json.loads(pipelines.diagnostics(e).first()["json"])["link"] == "u"
    assert list(spark.range(1).select(pipelines.is_menu(F.lit(4), F.lit(2)), pipelines.is_menu(F.lit(4), F.lit(1)), pipelines.is_menu(F.lit(0), F.lit(0))).first()) == [True, False, False]


D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
def test_queries_read_whole_tables(spark, monkeypatch):
    monkeypatch.setattr(page_queries, "ITEMS", 7)
    have = {r[0] or "" for r in table(spark, D, "entries").select("link").collect()}
    off = {r[0] for r in table(spark, D, "feeds").where("disabled").select("link").collect()}
    items = {r["link"] or "" for r in table(spark, D, "rss_items").collect() if r["feed"] not in off}
    added = [r["link"] for r in page_queries.q_crawl(spark, D).collect()]
    assert items & have and sorted(added) == sorted(items - have - {""})
    docs = page_queries._rss(spark, D)
    assert max(r[0] for r in docs.selectExpr("size(split(xml, '<item>')) - 1").collect()) <= 7
    assert page_queries.q_atom_entries(spark, D).count() == table(spark, D, "atom_entries").count()
    got = sorted((r["link"], r["title"]) for r in page_queries.q_opml_feeds(spark, D).collect())
    assert got == sorted((r["link"], r["title"] or "") for r in table(spark, D, "feeds").collect())


def test_command_lines(spark, tmp_path, capsys):
    import json

    from feedloom import __main__ as cli

    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.html").write_text("<meta charset=utf-8><div><p>" + "word " * 80 + "</p></div>")
    cli.main(["extract", "--uri", str(tmp_path / "pages")])
    row = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert row["uri"].endswith("a.html") and row["html"].startswith("<!DOCTYPE html><html><body><article><p>word ")
    (tmp_path / "o.opml").write_text('<opml><body><outline title="f"><outline title="A" xmlUrl="a"/></outline></body></opml>')
    cli.main(["opml", "--uri", str(tmp_path / "o.opml"), "--out", str(tmp_path / "out")])
    assert [(r["link"], r["category"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", ["f"])]
    (tmp_path / "r.txt").write_text("||example.org\n! note\n")
    cli.main(["rules", "--uri", str(tmp_path / "r.txt")])
    assert "example.org" in capsys.readouterr().out


def test_documents_are_saved_where_entries_say(spark, tmp_path):
    from feedloom.plans import pipelines

    rows = [("http://a/", 200, "text/html; charset=utf-8", None, b"<p>" + b"word " * 80)]
    got = pipelines.extract(spark.createDataFrame(rows, "uri string, status int, content_type string, content_encoding string, body binary"), document=True)
    folder = str(tmp_path / "docs")
    pipelines.save_documents(got, folder)
    entries = spark.createDataFrame([("http://a/", 0, None, None)], "link string, status int, content struct<local:string,words:int,imgs:int>, image array<string>")
    local = pipelines.fill_content(entries, got, folder).first()["content"]["local"]
    saved = spark.read.parquet(folder).first()
    assert saved["local"] == local and saved["html"].count("<p>") == 1


def test_meta_elements_in_order():
    from feedloom.sources.fetched import sniff

    assert sniff(b'<meta content="text/html; charset=koi8-r" http-equiv="Content-Type" charset=utf-8>') == "koi8-r"
    assert sniff(b'<meta http-equiv=content-type content="text/html"><meta charset=utf-8>') == ""
    assert sniff(b"<meta name=x content='charset=no'><META CHARSET='gb2312'>") == "gb2312"
