"""Blocks of text, and which of them are content by their neighbours.

A block has words, anchor_words, imgs, anchor_imgs, forms and anchors; the rules read the block before and after it.
All are one window over (page, block), hence one exchange by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.functions import text as X

FEATURES = ("words", "anchor_words", "imgs", "anchor_imgs", "forms", "anchors")


def line_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_idx, text, tokens, words, commas): each line that is not blank is a block; null texts have none."""
    x = df.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_idx", "line"))
    x = x.where(F.col("line").rlike(r"[^ \t\r\n\f]")).withColumn("block_idx", (F.row_number().over(Window.partitionBy(key).orderBy("line_idx")) - 1).cast("bigint"))
    c = F.col("line")
    return x.select(key, "block_idx", c.alias("text"), X.tokens(c).alias("tokens"), X.words(c).alias("words"), X.commas(c).alias("commas"))


def density(df: DataFrame) -> Column:
    return X.link_density(F.col("words"), F.col("anchor_words"), F.col("anchors"), F.col("anchor_imgs"))


def classify(df: DataFrame, page: str | list[str] = "page_id", order: str = "block_idx") -> DataFrame:
    """Add density and is_content. Beyond the ends of a page stands an empty block.

    1. A block with more than a third of its words linked is none. Else it is one if (a) the block before is not
    mostly links and this, the next or that one is long enough, or (b) it is mostly links and this or the next is
    longer still, or (c) it is an unlinked image between blocks of text, or (d) it is short among blocks without links.
    2. A very short block before links is none. 3. A form without words is none.
    """
    w = Window.partitionBy(page).orderBy(order)
    x = df.withColumn("density", density(df))
    before = lambda c: F.lag(c, 1, 0).over(w)
    after = lambda c: F.lead(c, 1, 0).over(w)
    x = x.withColumns({"__pd": before("density"), "__pw": before("words"), "__nd": after("density"), "__nw": after("words")})
    pd, pw, nd, nw, d, c = F.col("__pd"), F.col("__pw"), F.col("__nd"), F.col("__nw"), F.col("density"), F.col("words")
    a = (pd <= 55) & ((c > 20) | (nw > 15) | (pw > 8))
    b = (pd > 55) & ((c > 40) | (nw > 17))
    image = (pd <= 33) & (nd <= 33) & (c == 0) & (F.col("imgs") > 0) & (F.col("anchor_imgs") == 0)
    short = (pd < 13) & (nd < 13) & (d < 13) & (c < 40)
    good = F.when((F.col("forms") > 0) & (c == 0), False).when((c < 8) & (nd > 55), False).when(d > 33, False).otherwise(a | b | image | short)
    return x.withColumn("is_content", good).drop("__pd", "__pw", "__nd", "__nw")


def form_prefix(df: DataFrame, page: str | list[str] = "page_id", order: str = "block_idx") -> DataFrame:
    """A content block of less than 16 words right before a form is its heading; add `final`.

    The next block is that of the original list, whether or not it is content.
    """
    next_forms = F.lead("forms", 1, 0).over(Window.partitionBy(page).orderBy(order))
    return df.withColumn("final", F.col("is_content") & ~((next_forms > 0) & (F.col("words") < 16)))


def content(df: DataFrame) -> DataFrame:
    """the blocks that are content."""
    return df.where("is_content")
