"""Queries over block trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import navigation as nav
from ..operators import zonemaps
from ..operators.intervals import with_block_ids
from ..sources.corpora import blocks, blocks_sql
from .base import register

for _corpus in ("conv", "doc", "geo", "page"):
    register(
        f"intervals_{_corpus}",
        blocks_sql(_corpus) + f" SELECT document_id, ord, block_type, depth, pre, post, parent_ord FROM {_corpus}_blocks",
    )(lambda spark, d, c=_corpus: blocks(spark, d, c).select("document_id", "ord", "block_type", "depth", "pre", "post", "parent_ord"))


@register(
    "section_under_conv",
    blocks_sql("conv")
    + """ SELECT h.document_id, h.ord AS heading_ord, p.ord, p.content FROM conv_blocks h JOIN conv_blocks p
    ON h.document_id = p.document_id AND h.pre < p.pre AND p.post < h.post WHERE h.depth = 2 AND p.block_type = 'paragraph'""",
)
def section_under_conv(spark, d):
    b = blocks(spark, d, "conv")
    pairs = nav.contained(b.where("depth = 2").select("document_id", "ord", "pre", "post"), b.where("block_type = 'paragraph'").select("document_id", "ord", "pre", "post", "content"))
    return pairs.select("o.document_id", F.col("o.ord").alias("heading_ord"), F.col("i.ord").alias("ord"), "i.content")


@register(
    "section_under_bucketed_geo",
    blocks_sql("geo")
    + """ SELECT h.document_id, h.content AS nation, count(*) AS n_blocks FROM geo_blocks h JOIN geo_blocks p
    ON h.document_id = p.document_id AND h.pre < p.pre AND p.post < h.post WHERE h.depth = 2 GROUP BY 1, 2""",
)
def section_under_bucketed_geo(spark, d):
    b = blocks(spark, d, "geo")
    pairs = nav.contained_bucketed(b.where("depth = 2").select("document_id", "content", "pre", "post"), b.select("document_id", "pre", "post"), 1024)
    return pairs.groupBy("o.document_id", F.col("o.content").alias("nation")).agg(F.count(F.lit(1)).alias("n_blocks"))


@register(
    "ancestors_conv",
    blocks_sql("conv")
    + """ SELECT b.document_id, b.ord, a.ord AS ancestor_ord, a.depth AS ancestor_depth FROM conv_blocks b JOIN conv_blocks a
    ON a.document_id = b.document_id AND a.pre < b.pre AND b.post < a.post WHERE b.block_type = 'paragraph'""",
)
def ancestors_conv(spark, d):
    pairs = nav.path_to_root(blocks(spark, d, "conv"), F.col("block_type") == "paragraph")
    return pairs.select("b.document_id", "b.ord", F.col("a.ord").alias("ancestor_ord"), F.col("a.depth").alias("ancestor_depth"))


@register(
    "children_first_conv",
    blocks_sql("conv")
    + """ SELECT p.document_id, p.ord, c.ord AS child_ord, c.block_type AS child_type FROM conv_blocks p JOIN conv_blocks c
    ON p.document_id = c.document_id AND c.pre = p.pre + 1 AND c.post < p.post WHERE p.depth > 0""",
)
def children_first_conv(spark, d):
    b = blocks(spark, d, "conv").select("document_id", "ord", "block_type", "depth", "pre", "post")
    return nav.first_child(b, b.where("depth > 0")).select("p.document_id", "p.ord", F.col("c.ord").alias("child_ord"), F.col("c.block_type").alias("child_type"))


@register(
    "next_sibling_conv",
    blocks_sql("conv")
    + """ SELECT b.document_id, b.ord, s.ord AS sibling_ord FROM conv_blocks b JOIN conv_blocks s ON b.document_id = s.document_id AND s.pre = b.post + 1 WHERE b.depth = 2""",
)
def next_sibling_conv(spark, d):
    b = blocks(spark, d, "conv").select("document_id", "ord", "depth", "pre", "post")
    return nav.next_sibling(b, b.where("depth = 2")).select("b.document_id", "b.ord", F.col("s.ord").alias("sibling_ord"))


@register(
    "breadcrumb_geo",
    blocks_sql("geo")
    + """ SELECT b.document_id, b.ord, string_agg(a.content, ' > ' ORDER BY a.ord) AS breadcrumb FROM geo_blocks b JOIN geo_blocks a
    ON a.document_id = b.document_id AND a.depth > 0 AND (a.ord = b.ord OR (a.pre < b.pre AND b.post < a.post)) WHERE b.depth > 0 GROUP BY 1, 2""",
)
def breadcrumb_geo(spark, d):
    return nav.breadcrumbs(blocks(spark, d, "geo").where("depth > 0 AND document_id IS NOT NULL")).select("document_id", "ord", "breadcrumb")


@register("section_sizes_geo", blocks_sql("geo") + " SELECT document_id, content, depth, (post - pre - 1) // 2 AS blocks_inside FROM geo_blocks WHERE depth > 0")
def section_sizes_geo(spark, d):
    return nav.section_sizes(blocks(spark, d, "geo")).select("document_id", "content", "depth", "blocks_inside")


@register(
    "lint_heading_followed_by",
    blocks_sql("conv")
    + """ SELECT p.document_id, p.pre AS heading_pre, p.content AS heading, c.block_type AS offending_type, c.content AS offending_content FROM conv_blocks p JOIN conv_blocks c
    ON p.document_id = c.document_id AND c.pre = p.pre + 1 AND c.post < p.post WHERE p.block_type = 'heading' AND p.depth = 2 AND c.block_type IN ('paragraph', 'list')""",
)
def lint_heading(spark, d):
    return nav.lint_heading_followed_by(blocks(spark, d, "conv"), depth=2, forbidden=("paragraph", "list"))


@register(
    "under_heading_conv",
    blocks_sql("conv")
    + """, a AS (SELECT document_id, min(pre) AS pre FROM conv_blocks WHERE depth = 2 AND content ILIKE '%the%' GROUP BY 1),
    f AS (SELECT c.document_id, c.pre, c.post FROM conv_blocks c JOIN a ON a.document_id = c.document_id AND a.pre = c.pre)
    SELECT b.document_id, b.ord, b.lang FROM conv_blocks b JOIN f ON b.document_id = f.document_id AND f.pre < b.pre AND b.post < f.post""",
)
def under_heading_conv(spark, d):
    b = blocks(spark, d, "conv")
    first = b.where((F.col("depth") == 2) & F.lower("content").contains("the")).groupBy("document_id").agg(F.min_by(F.struct("pre", "post"), "pre").alias("a"))
    hit = b.join(first, "document_id").where((F.col("a.pre") < F.col("pre")) & (F.col("post") < F.col("a.post")))
    return hit.select("document_id", "ord", "lang")


@register(
    "sibling_positions_geo",
    blocks_sql("geo") + " SELECT document_id, ord, row_number() OVER (PARTITION BY document_id, coalesce(parent_ord, 0) ORDER BY ord) AS child_no FROM geo_blocks WHERE depth > 0",
)
def sibling_positions_geo(spark, d):
    return nav.sibling_positions(blocks(spark, d, "geo").where("depth > 0")).select("document_id", "ord", "child_no")


@register(
    "block_ids_conv",
    blocks_sql("conv") + " SELECT row_number() OVER (ORDER BY document_id, ord) - 1 AS id, document_id, ord FROM conv_blocks",
)
def block_ids_conv(spark, d):
    return with_block_ids(blocks(spark, d, "conv").select("document_id", "ord")).select("id", "document_id", "ord")


@register(
    "zone_maps_conv",
    blocks_sql("conv")
    + """ SELECT document_id, max(depth) AS max_heading_depth, max(content) FILTER (depth = 1) AS title,
    count(DISTINCT content) FILTER (depth > 0) AS n_headings, count(DISTINCT regexp_replace(trim(regexp_replace(lower(content), '[^\\p{L}\\p{N} ]', '-', 'g')), '\\s+', '-', 'g')) FILTER (depth > 0) AS n_slugs
    FROM conv_blocks GROUP BY 1""",
)
def zone_maps_conv(spark, d):
    b = blocks(spark, d, "conv").withColumn("properties", F.lit("{}"))
    return zonemaps.zone_maps(b).select("document_id", "max_heading_depth", "title", F.size("heading_contents").cast("long").alias("n_headings"), F.size("heading_slugs").cast("long").alias("n_slugs"))


@register(
    "zone_prune_heading",
    blocks_sql("doc") + " SELECT document_id, ord FROM doc_blocks WHERE depth = 0 AND document_id IN (SELECT document_id FROM doc_blocks WHERE depth > 0 AND lower(content) = 'fr')",
)
def zone_prune(spark, d):
    b = blocks(spark, d, "doc").withColumn("properties", F.lit("{}"))
    return zonemaps.prune(b, zonemaps.zone_maps(b), depth=2, heading="FR").where("depth = 0").select("document_id", "ord")


@register(
    "stats_block_types",
    blocks_sql("page") + " SELECT 'type' AS kind, block_type AS name, count(*) AS n FROM page_blocks GROUP BY 2",
)
def stats_block_types(spark, d):
    return zonemaps.block_statistics(blocks(spark, d, "page"))


@register("doc_titles", blocks_sql("page") + " SELECT document_id, min_by(content, ord) AS title FROM page_blocks WHERE depth = 1 GROUP BY 1")
def doc_titles(spark, d):
    return zonemaps.zone_maps(blocks(spark, d, "page").withColumn("properties", F.lit("{}"))).where("title <> ''").select("document_id", "title")
