import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from feedloom.llm import furniture, page_ops, pages, residue, site_lines

DAY = dt.datetime(2020, 1, 1)
KIND = "id int, feed string, summary string, updated timestamp, line string"


def table(spark, texts, feed="f"):
    return spark.createDataFrame([(i, feed, t, DAY, "clash") for i, t in enumerate(texts)], KIND)


def numbers(spark, texts, **limits):
    x = site_lines.with_repeated(table(spark, texts), "feed", "summary", "updated", "numbers", **limits)
    assert x.columns == [*KIND.replace(" int", "").replace(" string", "").replace(" timestamp", "").split(", "), "numbers"]
    return {r["id"]: r["numbers"] for r in x.collect()}


def test_repeated_lines(spark):
    texts = ["one\nRead 5 times", "two\n read  17 TIMES ", "three\n​READ 1 times\u00a0\r", "four\nread\u30001 times\nread 2 times", None, "", "five\n \nRead 9 times", " \n \n ", "six"]
    got = numbers(spark, texts)
    assert got == {0: [2], 1: [2], 2: [2], 3: [2, 3], 4: [], 5: [], 6: [3], 7: [], 8: []}
    assert numbers(spark, texts, min_rows=6)[0] == []
    assert numbers(spark, texts, min_share=0.6)[0] == []  # five rows of nine, nulls included


def test_copies_are_one_cluster(spark):
    texts = ["same text\nlegal"] * 6 + [f"other {chr(97 + i) * 3}" for i in range(4)]
    assert numbers(spark, texts)[0] == [1, 2]  # rows are counted
    assert numbers(spark, texts, min_clusters=2)[0] == []
    stats = site_lines.repeated(table(spark, texts), "feed", "summary", "updated").collect()
    assert {(r["rows"], r["clusters"], r["dates"]) for r in stats} == {(6, 1, 1)}


def test_days_are_counted_exactly(spark):
    rows = [(i, "f", f"text {chr(97 + i)}\nlegal", DAY + dt.timedelta(days=i // 2), "x") for i in range(10)] + [(99, None, "legal", None, "x")]
    x = spark.createDataFrame(rows, KIND)
    assert {(r["rows"], r["clusters"], r["dates"]) for r in site_lines.repeated(x, "feed", "summary", "updated").collect()} == {(10, 10, 5)}
    for days, n in ((5, 10), (6, 0)):
        got = site_lines.with_repeated(x, "feed", "summary", "updated", "numbers", min_dates=days)
        assert got.where("size(numbers) > 0").count() == n


def test_lines_beyond_the_broadcast(spark, monkeypatch):
    texts = [f"text {chr(97 + i)}\nlegal\nmore" for i in range(8)] + [None]
    want = numbers(spark, texts)
    monkeypatch.setattr(site_lines, "BROADCAST", 0)
    assert numbers(spark, texts) == want and want[0] == [2, 3]


def test_removal(spark):
    x = spark.createDataFrame([("a\nb\nc", [2]), ("a", [1]), ("a\r\nb", []), (None, [])], "t string, n array<bigint>")
    assert [r[0] for r in x.select(site_lines.without_lines(F.col("t"), F.col("n"))).collect()] == ["a\nc", "", "a\r\nb", None]


def test_hot_source_and_empty(spark):
    texts = [f"text {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}\nlegal notice" for i in range(3000)]
    got = numbers(spark, texts)
    assert Counter(map(tuple, got.values())) == {(2,): 3000}
    assert numbers(spark, []) == {}


FURNITURE = [
    "Skip to content", "Home | News | Contact", "Planet Reed » Help » News", "Help-Shop-Terms-Mobile", "(c) 1996 Letters", "© 2010 Notes. All rights reserved. Terms · Privacy", "Comments (32) | Permalink | Notes",
    "The post appeared first on Some Blog.", "Share this: Clatter | Mail", "We use cookies to make this work. By browsing on you accept our cookie policy.", "Cookies help us count visits. Fine by me / No thanks", "Alle Angaben ohne Gewähr. © 2007 Wire",
    "Tous droits réservés", "版权所有2010 NEVOHAM", "返回顶部", "Наверх", "Running on Normoro", "Read more »", "Viewed 227 times since 2012", "--- sent from the Daily newsroom ---", "﻿Subscribe to the print edition: 304 issues a year, delivered to your door",
]
ARTICLE = [
    "The feed lists 9 questions, but the page behind it shows only 3.", "Looking back at 1999 in Ashmoor", "Links and records", "Critics in Holt call the plan plain; the letters call it open.", "• How we tested the cache", "Archive of a small town, and how it was read",
    "Not every reader needs comments, and not all readers share a page.", "Older versions printed the privacy page before the readers could be counted.", "Über die Küche wurde 2006 zum ersten Mal ausführlich berichtet.",
]


def test_furniture():
    assert [x for x in FURNITURE if not furniture.is_furniture(x)] == []
    assert [x for x in ARTICLE if furniture.is_furniture(x)] == []


PROSE = "The crawler came back after 33 hours, found the school replaced, and told nobody about it at all."
PAGE = f"""<html><body>
<div class="top"><a href="/">News | Sport | Help</a></div>
<p>{PROSE}</p>
<h2>A heading</h2>
<li class="box">Most read</li>
<li class="box">Notes on a page</li>
<p>{PROSE} {PROSE}</p>
<li>own item</li>
<div class="end">© 2001 Notes</div>
<div class="end">Something else of the end</div>
</body>"""


def test_tree_scoring():
    keep, drop = pages.split(PAGE)
    assert (keep, drop) == ([3, 4, 7, 8], [2, 5, 6, 9, 10])
    plain = f"Home | News\n{PROSE}\nA heading\nMost read\nNotes on a page\nTwo writers, one page\n{PROSE}\n• own item\nBack to top"
    assert pages.split(plain) == ([2, 3, 7, 8], [1, 4, 5, 6, 9])
    assert pages.split(plain, [8])[1] == [1, 4, 5, 6, 8, 9]
    assert pages.split(None) == pages.split("") == pages.split(" \n\n") == ([], [])
    assert pages.split("x" * 200000) == ([1], [])
    assert pages.main_lines(plain, [2]) == PROSE and pages.main_lines(None, []) is None


def test_sidebars_and_furniture_of_any_length():
    titles = [f"Notes on page {x}" for x in "abcdefgh"]
    assert pages.split("\n".join([PROSE, "Most read", *titles, "Back to top"])) == ([1], list(range(2, 12)))
    assert pages.split("\n".join([PROSE, "Most read", *titles, PROSE, "A heading"])) == ([1, 11, 12], list(range(2, 11)))
    boxes = "\n".join(f'<li class="box">{x}</li>' for x in ["Most read", *titles])
    assert pages.split(f"<div><p>{PROSE}</p>\n{boxes}\n<p>{PROSE}</p></div>") == ([1, 11], list(range(2, 11)))
    legal = "The name, the marks and the pictures of these pages belong to those who made them. " * 4
    assert furniture.is_furniture(legal + "All rights reserved.") and not furniture.is_furniture(legal)
    assert furniture.is_furniture(" | ".join(["News", "Sport", "Help", "Contact"] * 10))
    assert not furniture.is_furniture("a" + " " * 100000 + "b")


def test_recurrent_headings_of_sidebars():
    plain = f"{PROSE}\nMost read\nNotes on a page\nTwo writers, one page\nBack to top"
    assert pages.split(plain, [2]) == pages.split(plain) == ([1], [2, 3, 4, 5])


def test_time_grows_with_the_page():
    import time

    for page in ("<div>\n" * 100000 + "x", "<div>x\n" * 50000, "</div>\n" * 100000, "<li>x</li>\n" * 100000, "<!-- -->" + "<!--" * 50000 + ">", '<a "' * 50000 + ">", '<i style="display:none">' * 30000):
        begun = time.process_time()
        pages.split(page)
        assert time.process_time() - begun < 5, page[:20]
    assert pages.split("<div>\n<!-- <p>a</p> -->\n<p>b</p></div>")[0] == [3]
    assert pages.split(f'<div><p>{PROSE}</p>\n<i style="display: none">x</i>\n<script>a\nb</script>\n<p>{PROSE}</p></div>') == ([1, 5], [])


def test_prose_outside_the_best_container():
    body = "\n".join(f"<p>{PROSE} {PROSE}</p>" for _ in range(6))
    page = f"<div>\n{body}\n</div>\n<div>\n<p>Ashmoor Press of Holt answers for all that stands here and elsewhere.</p>\n</div>"
    assert pages.split(page) == ([2, 3, 4, 5, 6, 7], [10])


BAD = [
    "{{ title }}", "Dear ${firstName}, your digest is ready.", "%(item.body)s", "%%POST_TITLE%%", "@@X_Y@@", "__CATEGORY__", "[INSERT TITLE HERE]", "{% block post %}", "Hello {0}, {1}!", "null", "NaN comments", "by undefined", "Published on [object Object]",
    "Lorem ipsum dolor sit amet consectetur.", "test test test", "TODO: add teaser", "No description available.", "(no content)", "foo bar baz foo bar baz", "404 Not Found", "HTTP Status 502 – Bad Gateway for /reader/618", "<h1>Error 403 (Forbidden)</h1><hr>", "ACCESS DENIED\nYou are not authorized to view this page.",
    "Traceback (most recent call last):\n  File \"x\"\nKeyError: 'body'", "Please enable JavaScript to view this page.\n© 2010 DAILY. REPRODUCTION WITHOUT PERMISSION IS NOT ALLOWED.", "This viewer relies on JS.", "请启用JavaScript后刷新页面。", "Страница не найдена. Ошибка 404.", "Seite nicht gefunden. Die angeforderte Seite existiert nicht (mehr).",
]
GOOD = [
    "Type {{ title }} in the theme file and the engine prints the headline of each post.", "Access denied was stamped across the gate, but the museum opened at noon all the same.", "A page that says Please enable JavaScript loses one reader in ten, our survey shows.",
    "How we cut our 404 Not Found errors by half in one week is a story about old links.", "Error 500 has been the name of the band since their first concert.", "The designers put lorem ipsum everywhere and forgot which column was real.", "{{Infobox reader\n| name = X\n}} '''Y'''", "See {{cite|1998}} and __bold__ text.",
    "\\frac{a}{b+1} and \\sum_{i=1}^{n} w_i", "```\nif (x) { return null }\n```\nProse.", None, "", "  ",
]


def test_residue():
    assert [x for x in BAD if not residue.kinds(x)] == []
    assert [x for x in GOOD if residue.kinds(x)] == []


ALONE = [
    "Please log in again.", "Please enable cookies.", "We will be back soon.", "The site is down", "This page could not be displayed", "Warning: include(header.php) failed to open stream", "blah blah blah", "jkl jkl", "missing", "Your text here", "foo bar baz foo bar baz",
    "Ut enim ad minim veniam, quis nostrud exercitation", "Excepteur sint occaecat cupidatat non proident", "Duis aute irure reprehenderit voluptate velit esse", "Are you a robot?", "Accès refusé", "En maintenance", "Bad gateway", "Cette page nécessite JS", "Diese Seite braucht JS", "at org.x.Reader(Reader.java:12)",
    "Fatal error: " + "Call to undefined method Reader::open() in /srv/www/reader.php " * 5, "Traceback (most recent call last): " + "File /srv/reader.py in read " * 10, "Your session has expired. " + "Go back to the form and send it once more. " * 6,
]


def test_arguments_by_number():
    for x in ("Dear {0}, {1}, your digest is ready.", "{1}", "{3} {4}\n", "Hello {0}!"):
        assert residue.kinds(x) == {"placeholder"}, x
    for x in ("Entered by hand were [3] or {4}, and x_i was left empty.", "The set {2} of numbers and the rule {3} are prose."):
        assert residue.kinds(x) == set(), x


def test_recurrent_lines_are_subtracted():
    legal = "All that stands between {open} and shut doors of this house belongs to its makers alone."
    assert residue.kinds(f"{PROSE}\n{legal}") == {"placeholder"} and residue.kinds(f"{PROSE}\n{legal}", [2]) == set()
    assert residue.kinds(f"{PROSE}\nby {{author}}", [2]) == {"placeholder"}  # an unfilled byline recurs as well
    assert residue.kinds("404 Not Found", [1]) == {"error, filler or scripts"}


def test_notices_for_scripts_of_any_length():
    asks = "This viewer needs JavaScript to show the page. Please enable JavaScript in your browser and load it again. Without scripts the viewer displays nothing at all here."
    assert len(asks) > 150 and residue.kinds(asks)
    assert not residue.kinds(f"{PROSE} Its viewer needs scripts to work. {PROSE}")
    assert residue.kinds("{% block " + "x" * 200 + " %}") == {"placeholder"}


def test_residue_of_every_line():
    assert [x for x in ALONE if not residue.kinds(x)] == []
    assert [x for x in ALONE if not residue.kinds(f"{x}\n© 2010 Notes. All rights reserved.")] == []
    assert residue.kinds("x" * 5000 + "y") == set()  # no pattern may need time that grows by powers


def test_tables(spark):
    texts = [PAGE, *BAD[:4], None, "", PROSE]
    x = page_ops.with_main(table(spark, texts), "feed", "summary", "updated", "page")
    got = {r["id"]: r["page"] for r in x.collect()}
    assert got[0]["furniture"] == [2, 5, 6, 9, 10] and got[1]["residue"] and got[5]["main"] is None and got[7]["main"] == PROSE
    y = page_ops.with_residue(table(spark, texts), "feed", "summary", "updated", "kinds")
    assert {r["id"] for r in y.collect() if r["kinds"]} == {1, 2, 3, 4} and y.count() == len(texts)
    assert page_ops.with_main(table(spark, []), "feed", "summary", "updated", "page").count() == 0
