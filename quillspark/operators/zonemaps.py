"""Per-document statistics and document skipping by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LIST = T.ArrayType(T.StringType())
SCHEMA = T.StructType(
    [
        T.StructField("document_id", T.LongType()),
        T.StructField("max_heading_depth", T.IntegerType()),
        *[T.StructField(n, _LIST) for n in ("heading_slugs", "heading_contents", "code_languages", "frontmatter_keys")],
        T.StructField("title", T.StringType()),
        T.StructField("tags", _LIST),
    ]
)


def slug(c: Column) -> Column:
    """Lower case; characters that are neither letter, digit nor blank become '-'; words joined by '-'."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N} ]", "-")
    return F.regexp_replace(F.trim(kept), r"\s+", "-")


def zone_maps(blocks: DataFrame) -> DataFrame:
    """One row per document; lists are sorted and free of repetitions."""
    head, code = F.col("block_type") == "heading", F.col("block_type") == "code"
    keys = F.when(F.col("block_type") == "yaml", F.json_object_keys("properties"))
    distinct = lambda c: F.array_sort(F.collect_set(c))
    return blocks.groupBy("document_id").agg(
        F.coalesce(F.max(F.when(head, F.col("depth"))), F.lit(0)).alias("max_heading_depth"),
        distinct(F.when(head, slug(F.col("content")))).alias("heading_slugs"),
        distinct(F.when(head, F.col("content"))).alias("heading_contents"),
        distinct(F.when(code & (F.col("lang") != ""), F.col("lang"))).alias("code_languages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(keys)))).alias("frontmatter_keys"),
        F.coalesce(
            F.max_by(F.get_json_object("properties", "$.title"), F.when((F.col("block_type") == "yaml") & F.get_json_object("properties", "$.title").isNotNull(), F.col("ord"))),
            F.min_by("content", F.when(head & (F.col("depth") == 1), F.col("ord"))),
            F.lit(""),
        ).alias("title"),
        F.max_by(F.get_json_object("properties", "$.tags"), F.when((F.col("block_type") == "yaml") & F.get_json_object("properties", "$.tags").isNotNull(), F.col("ord"))).alias("_tags"),
    ).withColumn("tags", F.coalesce(F.from_json("_tags", "array<string>"), F.array().cast("array<string>"))).drop("_tags")


def prune(blocks: DataFrame, zones: DataFrame, lang: str | None = None, depth: int | None = None, heading: str | None = None) -> DataFrame:
    """Blocks of the documents that can hold a match: skips by code language, heading depth or heading text (case ignored)."""
    may = F.lit(True)
    if lang is not None:
        may &= F.array_contains("code_languages", lang)
    if depth is not None:
        may &= F.col("max_heading_depth") >= depth
    if heading is not None:
        may &= F.exists("heading_contents", lambda h: F.lower(h) == heading.lower())
    return blocks.join(zones.where(may).select("document_id"), "document_id", "left_semi")


def block_statistics(blocks: DataFrame) -> DataFrame:
    """kind ('type' or 'language'), name, n; most frequent first."""
    types = blocks.groupBy(F.lit("type").alias("kind"), F.col("block_type").alias("name")).count()
    langs = blocks.where((F.col("block_type") == "code") & (F.col("lang") != "")).groupBy(F.lit("language").alias("kind"), F.col("lang").alias("name")).count()
    return types.union(langs).withColumnRenamed("count", "n").orderBy("kind", F.col("n").desc(), "name")
