"""Joins along the document tree.  All of them carry the document as an equi-key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import under


def contained(outer: DataFrame, inner: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs (o, i) with i inside o, as structs; ``outer`` and ``inner`` are block tables."""
    o, i = outer.select(F.struct("*").alias("o")), inner.select(F.struct("*").alias("i"))
    return o.join(i, (F.col("o.document_id") == F.col("i.document_id")) & under("i.pre", "i.post", "o.pre", "o.post"), how)


def contained_bucketed(outer: DataFrame, inner: DataFrame, width: int = 4096) -> DataFrame:
    """As ``contained``, for documents with very many blocks.

    An interval is cut into buckets of ``width`` pre numbers, so the blocks of one
    huge document spread over (document, bucket) keys; the range is the residual.
    """
    o = outer.select(F.struct("*").alias("o"), F.explode(F.sequence(F.expr(f"pre div {width}"), F.expr(f"post div {width}"))).alias("_bo"))
    i = inner.select(F.struct("*").alias("i"), F.expr(f"pre div {width}").alias("_bi"))
    on = (F.col("o.document_id") == F.col("i.document_id")) & (F.col("_bo") == F.col("_bi")) & under("i.pre", "i.post", "o.pre", "o.post")
    return o.join(i, on).select("o", "i")


def first_child(blocks: DataFrame, parents: DataFrame) -> DataFrame:
    """Pairs (p, c): the block right below each parent (its pre number plus one)."""
    p, c = parents.select(F.struct("*").alias("p")), blocks.select(F.struct("*").alias("c"))
    return p.join(c, (F.col("p.document_id") == F.col("c.document_id")) & (F.col("c.pre") == F.col("p.pre") + 1) & (F.col("c.post") < F.col("p.post")))


def next_sibling(blocks: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (b, s): the block that follows each one's interval directly."""
    b, s = of.select(F.struct("*").alias("b")), blocks.select(F.struct("*").alias("s"))
    return b.join(s, (F.col("b.document_id") == F.col("s.document_id")) & (F.col("s.pre") == F.col("b.post") + 1))


def descendants_of(blocks: DataFrame, document_id: int, pre: int, post: int) -> DataFrame:
    return blocks.where((F.col("document_id") == document_id) & under("pre", "post", F.lit(pre), F.lit(post)))


def breadcrumbs(blocks: DataFrame, separator: str = " > ") -> DataFrame:
    """``blocks`` with ``breadcrumb``: the contents of the enclosing headings and of the block if it is a heading.

    Needs ``path`` from the numbering; headings are looked up by equi-join, never
    by range.
    """
    heads = blocks.where("depth > 0").select(F.col("document_id").alias("_d"), F.col("ord").alias("_o"), F.col("content").alias("_c"))
    own = F.when(F.col("depth") > 0, F.array("ord")).otherwise(F.array().cast("array<int>"))
    steps = blocks.select("document_id", "ord", F.posexplode(F.concat(F.col("path").cast("array<int>"), own)).alias("_p", "_o2"))
    named = steps.join(heads, (steps["document_id"] == heads["_d"]) & (steps["_o2"] == heads["_o"]))
    crumbs = named.groupBy("document_id", "ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_c"))), lambda s: s["_c"]), separator).alias("breadcrumb"))
    return blocks.join(crumbs, ["document_id", "ord"], "left").withColumn("breadcrumb", F.coalesce("breadcrumb", F.lit("")))


def section_sizes(blocks: DataFrame) -> DataFrame:
    """Headings with the number of blocks inside, read off the interval."""
    return blocks.where("depth > 0").withColumn("blocks_inside", F.expr("(post - pre - 1) div 2"))


def lint_heading_followed_by(blocks: DataFrame, depth: int = 2, forbidden: tuple[str, ...] = ("list",)) -> DataFrame:
    """Headings of a depth whose first block is of a forbidden type."""
    pairs = first_child(blocks, blocks.where((F.col("block_type") == "heading") & (F.col("depth") == depth)))
    bad = pairs.where(F.col("c.block_type").isin(*forbidden))
    return bad.select(
        F.col("p.document_id").alias("document_id"),
        F.col("p.pre").alias("heading_pre"),
        F.col("p.content").alias("heading"),
        F.col("c.block_type").alias("offending_type"),
        F.col("c.content").alias("offending_content"),
    )


def first_heading(blocks: DataFrame, text: str, depth: int | None = None) -> DataFrame:
    """document_id, anchor_pre, anchor_post of the first heading with this text in each document."""
    hit = (F.col("block_type") == "heading") & (F.col("content") == text)
    if depth is not None:
        hit &= F.col("depth") == depth
    return blocks.where(hit).groupBy("document_id").agg(F.min_by(F.struct("pre", "post"), "pre").alias("a")).select("document_id", F.col("a.pre").alias("anchor_pre"), F.col("a.post").alias("anchor_post"))


def path_to_root(blocks: DataFrame, of: Column) -> DataFrame:
    """Pairs (b, a): each selected block with its enclosing headings, by the heading's ``ord``."""
    b = blocks.where(of).select(F.struct("*").alias("b"), F.explode("path").alias("_a"))
    a = blocks.where("depth > 0").select(F.struct("*").alias("a"))
    return b.join(a, (F.col("b.document_id") == F.col("a.document_id")) & (F.col("_a") == F.col("a.ord"))).select("b", "a")


def sibling_positions(blocks: DataFrame) -> DataFrame:
    """``blocks`` with their place among the children of their parent."""
    w = Window.partitionBy("document_id", F.coalesce("parent_ord", F.lit(0))).orderBy("ord")
    return blocks.withColumn("child_no", F.row_number().over(w))
