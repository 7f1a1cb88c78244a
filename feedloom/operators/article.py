"""From the table of nodes to the article of each page, in native operators.

The table of nodes has, for each node, what is counted below it, so nothing here reads leaves. All steps are windows and
aggregations over the page: rows are exchanged once, by page, and neither text of leaves nor paths of ancestors is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.functions import text as X
from feedloom.operators import blocks

SUMS = ("words", "tokens", "anchor_words", "imgs", "anchor_imgs", "objects", "anchors", "out_words", "links")


def features(nodes: DataFrame) -> DataFrame:
    """A1: (page_id, node_id, words, tokens, anchor_words, imgs, anchor_imgs, objects, anchors, out_words, links) of each
    node, over all below it. Words in nested links count once for each; out_words are those outside links."""
    return nodes.select("page_id", "node_id", *SUMS)


def _scored(nodes: DataFrame) -> DataFrame:
    """A3: add `score`: of each container the points of the paragraphs in it, its tag and names, less the part of its
    words that is linked; null where a node holds no paragraph."""
    base = X.tag_score(F.col("tag")) + X.name_weight(F.col("class")) + X.name_weight(F.col("id"))
    score = F.call_function("div", (F.col("points") + base) * (100 - blocks.density(nodes)), F.lit(100))
    return nodes.withColumn("score", score.cast("bigint"))


def candidates(nodes: DataFrame) -> DataFrame:
    """A3: (page_id, node_id, parent_id, class, score): containers by the paragraphs in them."""
    return _scored(nodes).where("score IS NOT NULL").select("page_id", "node_id", "parent_id", "class", "score")


def top(cands: DataFrame) -> DataFrame:
    """A4: the best candidate of each page; of equal ones the first in document order."""
    best = F.max_by(F.struct("node_id", "parent_id", "class", "score"), F.struct("score", -F.col("node_id")))
    return cands.groupBy("page_id").agg(best.alias("t")).select("page_id", "t.*")


def _kept(scored: DataFrame) -> DataFrame:
    """Add `kept`: whether a node is the best candidate or one of its siblings that belong to the article."""
    rank = F.when(F.col("score").isNotNull(), F.struct("score", -F.col("node_id")))
    best = F.max_by(F.struct("node_id", "parent_id", "class", "score"), rank).over(Window.partitionBy("page_id"))
    x = scored.withColumn("__t", best)
    same = F.col("score").isNotNull() & (F.length("class") > 0) & (F.col("class") == F.col("__t.class"))
    strong = F.col("score") > X.sibling_threshold(F.col("__t.score"))
    long = F.col("score").isNull() & (F.col("tag") == "p") & (F.col("words") > 65) & (blocks.density(x) < 22)
    hit = (F.col("node_id") == F.col("__t.node_id")) | ((F.col("parent_id") == F.col("__t.parent_id")) & (same | strong | long))
    return x.withColumn("kept", F.coalesce(hit, F.lit(False))).drop("__t")


def kept_siblings(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id): the best candidate and those of its siblings that belong to the article: candidates of
    the same class or with enough points, and long paragraphs with few links."""
    return _kept(_scored(nodes)).where("kept").select("page_id", "node_id")


def _blocks(nodes: DataFrame) -> DataFrame:
    """The blocks of `article_blocks`, and the root of each page with `real` off, so that no page is lost."""
    order = Window.partitionBy("page_id").orderBy("node_id")
    x = _kept(_scored(nodes.where("tag <> '#text'")))
    x = x.withColumn("__end", F.max(F.when(F.col("kept"), F.col("end_id"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("real", F.coalesce((F.col("role") != "") & (F.col("node_id") <= F.col("__end")), F.lit(False))).where("real OR parent_id < 0")
    x = x.withColumn("block_idx", (F.row_number().over(Window.partitionBy("page_id", "real").orderBy("node_id")) - 1).cast("bigint"))
    forms = F.when(F.col("role") == "shell", 1).otherwise(0).cast("bigint")
    return x.select("page_id", "real", "block_idx", "node_id", F.col("block_text").alias("text"), F.col("block_html").alias("html"), F.col("block_images").alias("images"), forms.alias("forms"), *SUMS)


def article_blocks(nodes: DataFrame) -> DataFrame:
    """(page_id, block_idx, node_id, text, html, images, forms, sums): paragraphs and shells in the kept nodes, in order.

    Kept nodes are siblings, so a block stands in one of them if the last of those that begin before it ends behind it.
    """
    return _blocks(nodes).where("real").drop("real")


#: What stands around the paragraphs of a document.
BEFORE, BEHIND = "<!DOCTYPE html><html><body><article>", "</article></body></html>"


def extract(nodes: DataFrame, document: bool = False) -> DataFrame:
    """(page_id, word_count, link_count, images, text) of the article of each page, after the block classifier.

    With `document` also `html`, the article as a document of its own (S6). Every page has a row; a page without
    candidates has an empty article. The plan has one exchange, by page.
    """
    by = ["page_id", "real"]
    x = blocks.form_prefix(blocks.classify(_blocks(nodes), by), by)
    own = F.col("real") & F.col("final")
    total = lambda c: F.sum(F.when(own, F.col(c)).otherwise(0))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("block_idx", c)))), lambda s: s[c])
    html = [F.concat(F.lit(BEFORE), F.array_join(listed("html"), ""), F.lit(BEHIND)).alias("html")] if document else []
    return x.groupBy("page_id").agg(total("out_words").alias("word_count"), total("links").alias("link_count"), F.flatten(listed("images")).alias("images"), F.array_join(listed("text"), "\n").alias("text"), *html)
