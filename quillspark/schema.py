"""Schemas of the block model.

``pre``/``post`` are a nested-set interval inside one document: a block lies in a
section when ``section.pre < pre AND post < section.post`` and both have the same
``document_id``.  ``depth`` is 0 and ``lang`` empty where they do not apply.
"""

from __future__ import annotations

from pyspark.sql import types as T

BLOCK_TYPES = (
    "heading",
    "paragraph",
    "code",
    "list",
    "table_cell",
    "table_row",
    "table_align",
    "blockquote",
    "horizontal_rule",
    "html",
    "yaml",
    "toml",
    "math",
    "definition",
    "footnote",
)

SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start_line", "start_col", "end_line", "end_col")])

NODES = T.StructType(
    [
        T.StructField("document_id", T.LongType(), False),
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("block_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("lang", T.StringType(), False),
        T.StructField("properties", T.StringType()),
        T.StructField("span", SPAN),
    ]
)

BLOCKS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("block_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("pre", T.IntegerType()),
        T.StructField("post", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("lang", T.StringType()),
        T.StructField("properties", T.StringType()),
        T.StructField("span", SPAN),
        T.StructField("ord", T.IntegerType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("tags", T.StringType()),
    ]
)
