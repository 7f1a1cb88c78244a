import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedloom.operators import rules, store

ENTRY = "link string, feed string, created timestamp, readed boolean, category array<string>, status int, content struct<local:string,words:int,imgs:int>, image array<string>"
AT = [dt.datetime(2020, 1, 1, h) for h in (10, 11, 12)]


def base(spark):
    rows = [("a", "f1", AT[0], False, ["x"], 0, None, None), ("b", "f1", AT[1], False, ["y"], 0, None, ["o"]), ("c", "f2", AT[2], True, None, 0, None, [])]
    return spark.createDataFrame(rows, ENTRY)


def links(df):
    return [r["link"] for r in df.collect()]


def test_reads(spark):
    e = base(spark)
    assert links(store.top_n(e, 0, 10)) == ["b", "a"]
    assert links(store.top_n(e, 1, 1)) == ["a"]
    assert links(store.top_n(e, 0, 0)) == ["b", "a"]
    assert links(store.top_n(e, 0, 10, feed="f2")) == []
    assert links(store.top_n(e, 0, 10, category="x")) == ["a"]


def test_inserts(spark):
    e = base(spark)
    new = spark.createDataFrame([(1, "b"), (2, "d"), (3, "d"), (4, None), (5, "")], "seq int, link string")
    batch = new.select("seq", "link", *[F.lit(None).cast(e.schema[c].dataType).alias(c) for c in e.columns if c != "link"])
    got = store.inserted(e, batch, "seq")
    assert sorted((r["seq"], r["link"]) for r in got.collect()) == [(2, "d"), (4, None)]
    assert sorted(x or "" for x in links(store.save(e, batch, "seq"))) == ["", "a", "b", "c", "d"]
    assert store.save(e, batch.limit(0), "seq").count() == 3


def test_updates(spark):
    e = base(spark)
    found = spark.createDataFrame([("a", "x", 65, ["p"]), ("b", "", 500, []), ("c", "x", 192, [])], "link string, local string, words int, images array<string>")
    got = {r["link"]: r for r in store.set_content(e, found).collect()}
    assert [got[k]["status"] for k in "abc"] == [1, 2, 2]
    assert got["a"]["image"] == ["p"] and got["b"]["image"] == ["o"] and got["a"]["content"]["words"] == 65
    assert {r["link"]: r["readed"] for r in store.mark_read(e, "a").collect()} == {"a": True, "b": False, "c": True}
    f = spark.createDataFrame([("u", "t", AT[0], 5, ["x"], False), ("v", "t", AT[2], 0, None, None)], "link string, title string, refresh timestamp, ttl int, category array<string>, disabled boolean")
    now = F.lit(AT[1])
    assert links(store.timeout_feeds(f, now)) == ["u"] and links(store.all_feeds(f)) == ["u"]
    assert links(store.timeout_feeds(f, F.lit(AT[0]))) == []  # strictly before
    up = store.update(f, spark.createDataFrame([("u", 9, ["x", "z", "z"])], "link string, ttl int, category array<string>"))
    assert {r["link"]: (r["ttl"], r["category"]) for r in up.collect()} == {"u": (9, ["x", "z"]), "v": (0, None)}
    touched = store.touch(f, spark.createDataFrame([("v", 30)], "link string, ttl int"), now)
    assert {r["link"]: r["refresh"] for r in touched.collect()}["v"] == AT[1] + dt.timedelta(minutes=30)
    off = store.disable(f, spark.createDataFrame([("v", True)], "link string, disabled boolean"))
    assert {r["link"]: r["disabled"] for r in off.collect()} == {"u": False, "v": True}
    assert links(store.remove(f, "u")) == ["v"]
    row = spark.range(1).select(store.summary_status(F.lit(128), F.lit(0)), store.summary_status(F.lit(1), F.lit(1))).first()
    assert list(row) == [0, 4]


LIST = ["[list 1.0]", "! comment", "||example.org", "||exa", "|http://ads.test/", "|https://sec.test/x*y", "@@||good.example.org", "tracker.test/pix*gif", "ab*c.test", "/^https?:\\/\\/re\\.test/", "", None]
URLS = [
    ("http://www.example.org/a", 1), ("https://example.org", 1), ("http://good.example.org/", 0), ("http://notexample.organic/", 1), ("http://ads.test/banner", 1), ("https://ads.test/banner", 0),
    ("https://sec.test/x1y", 1), ("http://sec.test/x1y", 0), ("http://cdn.tracker.test/pix/1.gif", 1), ("https://cdn.tracker.test/pix/1.gif", 0), ("tracker.test/pix.gif", 0), ("http://abxc.test/", 0),
    ("http://re.test/", 0), ("http://exa/", 1), ("http://exams.test/", 0), ("http://other.test/?u=example.org", 0), (None, 0), ("", 0),
]


def test_rules(spark):
    r = rules.load(spark.createDataFrame(list(enumerate(LIST)), "line_no int, value string"))
    u = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(URLS)], "id int, url string")
    for f in (rules.blocked, rules.blocked_by_key):
        got = {x["id"]: x["blocked"] for x in f(u, r, "id", "url").collect()}
        assert [URLS[i][0] for i in got if got[i] != bool(URLS[i][1])] == [] and len(got) == len(URLS)
    assert [x["id"] for x in rules.matches_regex(u, r, "id", "url").collect()] == [12]


def test_rules_of_few_characters_in_any_number(spark, monkeypatch):
    monkeypatch.setattr(rules, "BROADCAST", 1)
    lines = ["||新闻", "||论坛网", "|http://сайт", "天气*рек", "||новости", "@@||好新闻", "/a/", "/b/"]
    r = rules.load(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string"))
    want = [("http://www.新闻.test/", 1), ("http://x.论坛网/", 1), ("http://сайт.test/", 1), ("http://a.test/天气/рек", 1), ("http://a.test/рек/天气", 0), ("http://новости.test", 1), ("http://好新闻.test/", 0), ("http://a.сайт.test/", 0), ("http://新/", 0), ("新闻", 1)]
    u = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(want)], "id int, url string")
    got = {x["id"]: int(x["blocked"]) for x in rules.blocked(u, r, "id", "url").collect()}
    assert [got[i] for i in range(len(want))] == [b for _, b in want]
    monkeypatch.setattr(rules, "BROADCAST", 100)
    assert got == {x["id"]: int(x["blocked"]) for x in rules.blocked(u, r, "id", "url").collect()}
    monkeypatch.setattr(rules, "BROADCAST", 1)
    with pytest.raises(ValueError):
        rules.matches_regex(u, r, "id", "url")


def test_rules_of_few_characters_by_key(spark, monkeypatch):
    lines = ["||新闻", "||论坛网", "|http://сайт", "@@||好新闻"]
    r = rules.load(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string"))
    u = spark.createDataFrame([(0, "http://www.新闻.test/"), (1, "http://x.论坛网/"), (2, "http://сайт.test/"), (3, "http://好新闻.test/"), (4, "http://a.test/")], "id int, url string")
    for most in (0, 100):  # windows exchanged, rules sent to all tasks
        monkeypatch.setattr(rules, "BROADCAST", most)
        monkeypatch.setattr(rules, "FEW", 0)
        for f in (rules.blocked_by_key, rules.blocked):
            assert {x["id"] for x in f(u, r, "id", "url").where("blocked").collect()} == {0, 1, 2}
