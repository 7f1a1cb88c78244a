"""Counting and trimming of text in native columns; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The punctuation beyond Latin-1 that is no word.
STOP = "。．？！，、；：“”﹃﹄‘’﹁﹂（）［］〔〕【】—…～《》〈〉﹏＿"
#: Words of a line; columns of layout tables count a linked image as so many words.
LINE_WORDS, IMAGE_WORDS = 65, 4


def tokens(c: Column) -> Column:
    """Each run of ASCII letters, digits and underscores is a token, and so is any other character."""
    return F.length(F.regexp_replace(c, "[0-9A-Za-z_]+", "w")).cast("bigint")


def token_list(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)[0-9A-Za-z_]+|[^0-9A-Za-z_]"), F.lit(0))


def words(c: Column) -> Column:
    """The tokens that are not stop characters."""
    return tokens(c) - (F.length(c) - F.length(F.translate(c, STOP, ""))).cast("bigint")


def commas(c: Column) -> Column:
    """Characters of punctuation in any script."""
    return F.length(F.regexp_replace(c, r"\P{P}", "")).cast("bigint")


def link_density(w: Column, anchor_words: Column, anchors: Column, anchor_images: Column) -> Column:
    """Per cent of the words that are linked, whole numbers cut towards zero."""
    linked = anchor_images * IMAGE_WORDS
    ratio = F.call_function("div", (anchor_words + linked) * 100, F.greatest(w + linked, F.lit(1)))
    return F.when(w == 0, F.when(anchors > 0, F.lit(100)).otherwise(0)).otherwise(ratio).cast("bigint")


def lines(w: Column) -> Column:
    """Lines of LINE_WORDS words."""
    return F.call_function("div", w + (LINE_WORDS - 1), F.lit(LINE_WORDS)).cast("bigint")


def wrapped_words(w: Column) -> Column:
    return w - w % LINE_WORDS


def table_score(w: Column, density: Column, images: Column, anchor_images: Column) -> Column:
    """The worth of a table cell as the body of a page."""
    return (F.call_function("div", w * (100 - density), F.lit(100)) + (images - anchor_images) * 8).cast("bigint")


def merge_tail_spaces(c: Column) -> Column:
    """No blanks at the end, one line feed for blanks around line breaks."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+\z", ""), r"[ \t]*[\r\n]+[ \t]*", "\n")


def sibling_threshold(score: Column) -> Column:
    """The score above which a sibling of the best container is kept."""
    return F.greatest(F.lit(10), F.call_function("div", score, F.lit(5)))


def longer(a: Column, b: Column) -> Column:
    """The longer in bytes; b if they are equal. Nulls count as empty."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when(F.octet_length(a) > F.octet_length(b), a).otherwise(b)


# Names that weigh for and against a container, as the scoring has them (content names count against).
AGAINST = "article|body|content|entry|hentry|main|page|pagination|post|text|blog|story"
IN_FAVOUR = "(?i)combx|comment|com-|contact|foot|footer|footnote|masthead|media|meta|outbrain|promo|related|scroll|shoutbox|sidebar|sponsor|shopping|tags|tool|widget"


def name_weight(c: Column) -> Column:
    """25 points for or against a class or id; both may apply."""
    return F.when(c.rlike(IN_FAVOUR), 25).otherwise(0) - F.when(c.rlike(AGAINST), 25).otherwise(0)


def tag_score(tag: Column) -> Column:
    """Points of an element by its tag."""
    return (
        F.when(tag.isin("div", "p"), 5)
        .when(tag.isin("pre", "td", "blockquote"), 3)
        .when(tag.isin("address", "ol", "ul", "dl", "dd", "dt", "li"), -3)
        .when(tag == "form", -10)
        .when(tag.isin("h1", "h2", "h3", "h4", "h5", "h6"), -5)
        .otherwise(0)
    )
