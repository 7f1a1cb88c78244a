import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.functions import text as X
from feedloom.operators import blocks

COUNTS = [("Hello, world", 4, 4, 1), ("für", 3, 3, 0), ("a_1 b-2", 5, 5, 2), ("price: $5 + tax", 9, 9, 1), ("中国，你好。", 6, 4, 2), ("“引文”——x", 7, 3, 4), ("", 0, 0, 0), ("  \n", 3, 3, 0), ("x·y~z", 5, 5, 1)]


def test_counts(spark):
    df = spark.createDataFrame([(t,) for t, *_ in COUNTS], "t string")
    c = F.col("t")
    got = [tuple(r) for r in df.select(X.tokens(c), X.words(c), X.commas(c)).collect()]
    assert got == [(a, b, d) for _, a, b, d in COUNTS]
    assert [len(r[0]) for r in df.select(X.token_list(c)).collect()] == [a for _, a, _, _ in COUNTS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"], max_codepoint=0xFFFF), max_size=40), min_size=30, max_size=60))
def test_counts_like_a_plain_model(spark, texts):
    texts = [t.replace("\x00", "") for t in texts]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.tokens(F.col("t")), X.words(F.col("t"))).collect()]
    for t, (tokens, words) in zip(texts, got, strict=True):
        found = re.findall(r"(?s)[0-9A-Za-z_]+|[^0-9A-Za-z_]", t)
        assert tokens == len(found) and words == sum(x not in X.STOP for x in found)


def test_small_functions(spark):
    row = spark.range(1).select(
        X.lines(F.lit(66)), X.lines(F.lit(0)), X.wrapped_words(F.lit(70)), X.link_density(F.lit(8), F.lit(2), F.lit(1), F.lit(1)), X.link_density(F.lit(0), F.lit(0), F.lit(2), F.lit(0)), X.link_density(F.lit(0), F.lit(0), F.lit(0), F.lit(0)), X.table_score(F.lit(50), F.lit(10), F.lit(2), F.lit(1)), X.sibling_threshold(F.lit(71)), X.name_weight(F.lit("content")), X.name_weight(F.lit("Widget post")), X.tag_score(F.lit("h2")), X.merge_tail_spaces(F.lit("a \r\n\t b  ")), X.longer(F.lit("é"), F.lit("ab")), X.longer(F.lit(None).cast("string"), F.lit(None).cast("string"))
    ).first()
    assert list(row) == [2, 0, 65, 50, 100, 0, 53, 14, -25, 0, -5, "a\nb", "ab", ""]


# (words, anchor_words, imgs, anchor_imgs, forms, anchors), classified, final
PAGES = {
    "A": ([(30, 28, 0, 0, 0, 6), (9, 0, 0, 0, 0, 0), (200, 4, 0, 0, 0, 1), (150, 0, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0), (40, 40, 0, 0, 0, 8)], "FTTTFF", "FTTTFF"),
    "B": ([(90, 0, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0), (90, 0, 0, 0, 0, 0)], "TTT", "TTT"),
    "C": ([(90, 0, 0, 0, 0, 0), (0, 0, 1, 1, 0, 1), (90, 0, 0, 0, 0, 0)], "TFT", "TFT"),
    "D": ([(100, 0, 0, 0, 0, 0), (10, 0, 0, 0, 0, 0), (0, 0, 0, 0, 1, 0), (100, 0, 0, 0, 0, 0)], "TTFT", "TFFT"),
    "E": ([(5, 0, 0, 0, 0, 0)], "T", "T"),
    "F": ([(100, 33, 0, 0, 0, 1), (100, 34, 0, 0, 0, 1)], "TF", "TF"),
    "G": ([(8, 2, 1, 1, 0, 1), (120, 0, 0, 0, 0, 0)], "FT", "FT"),
}


def test_classifier(spark):
    rows = [(p, i, *b) for p, (bs, _, _) in PAGES.items() for i, b in enumerate(bs)]
    df = spark.createDataFrame(rows, "page_id string, block_idx int, words long, anchor_words long, imgs long, anchor_imgs long, forms long, anchors long")
    got = {(r.page_id, r.block_idx): (r.is_content, r.final) for r in blocks.form_prefix(blocks.classify(df)).collect()}
    for p, (bs, a, b) in PAGES.items():
        assert "".join("FT"[got[p, i][0]] for i in range(len(bs))) == a, p
        assert "".join("FT"[got[p, i][1]] for i in range(len(bs))) == b, p


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")], [(1, "\n \r\n")]])
def test_no_blocks(spark, rows):
    assert blocks.line_blocks(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id", "text").count() == 0
