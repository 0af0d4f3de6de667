"""Queries that go through a store, files, the parser or the SQL front end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import store as st
from ..operators.shared import shared_dir, written
from ..sources import files as sources
from ..sources.corpora import blocks, blocks_sql
from ..sources.markdown import nodes, parse_blocks
from . import selector
from .base import register, table


def _conversation_markdown(spark, d):
    """A Markdown text per conversation: its title, user turns as level-2 headings, other turns as paragraphs."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")))).alias("t"))
    line = lambda t: F.when(t["role"] == "user", F.concat(F.lit("## "), t["text"])).otherwise(t["text"])
    body = F.array_join(F.transform("t", line), "\n\n")
    return turns.select(F.col("conv_id").cast("int").alias("id"), F.concat(F.lit("conv/"), "conv_id", F.lit(".md")).alias("path"), F.concat(F.lit("# Conversation "), "conv_id", F.lit("\n\n"), body, F.lit("\n")).alias("text"))


_CONV_TEXT = blocks_sql("conv")


@register(
    "markdown_parse_conv",
    _CONV_TEXT + " SELECT document_id, ord, block_type, trim(replace(content, chr(10), ' ')) AS content, depth, pre, post FROM conv_blocks",
)
def markdown_parse_conv(spark, d):
    return parse_blocks(_conversation_markdown(spark, d)).select("document_id", "ord", "block_type", "content", "depth", "pre", "post")


@register("markdown_spans_conv", _CONV_TEXT + " SELECT document_id, ord, 2 * ord - 1 AS start_line FROM conv_blocks")
def markdown_spans_conv(spark, d):
    return nodes(_conversation_markdown(spark, d)).select("document_id", "ord", "span.start_line")


@register("selector_headings", _CONV_TEXT + " SELECT document_id, ord, '## ' || content AS output FROM conv_blocks WHERE depth = 2")
def selector_headings(spark, d):
    return selector.run(blocks(spark, d, "conv"), ".h | select(.depth == 2)")


@register("selector_text_lang", _CONV_TEXT + " SELECT document_id, ord, content AS output FROM conv_blocks WHERE lang = 'assistant'")
def selector_text_lang(spark, d):
    return selector.run(blocks(spark, d, "conv"), 'select(.lang == "assistant") | to_text')


@register(
    "reindex_diff",
    """WITH o AS (SELECT 'd/' || doc_id AS path, text FROM documents), n AS (SELECT 'd/' || doc_id AS path, CASE WHEN lang = 'fr' THEN text || ' x' ELSE text END AS text FROM documents WHERE source <> 'src3' UNION ALL SELECT 'b/' || item_id, text FROM benchmark)
    SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'missing' WHEN o.text = n.text THEN 'unchanged' ELSE 'updated' END AS status FROM o FULL JOIN n ON o.path = n.path""",
)
def reindex_diff(spark, d):
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    old = docs.select(F.concat(F.lit("d/"), "doc_id").alias("path"), "text")
    new = docs.where("source <> 'src3'").select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.when(F.col("lang") == "fr", F.concat("text", F.lit(" x"))).otherwise(F.col("text")).alias("text"))
    return st.reindex_diff(old, new.unionByName(bench.select(F.concat(F.lit("b/"), "item_id").alias("path"), "text")))


@register("read_csv_roundtrip", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def read_csv_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
    return sources.read_csv(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand", "p_size", "p_retailprice")


@register(
    "read_csv_quoted",
    """SELECT c_custkey, 'He said "' || c_name || '",' || chr(10) || 'then left' AS said, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer""",
)
def read_csv_quoted(spark, d):
    """Quotes, separators and newlines inside fields; short rows."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    c = table(spark, d, "customer")
    said = F.concat(F.lit('"He said ""'), "c_name", F.lit('"",\nthen left"'))
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(","), said, F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(","), "c_mktsegment")))
    header = spark.createDataFrame([(-1, "c_custkey,said,segment")], "k long, value string")
    c.select(F.col("c_custkey").cast("long").alias("k"), line.alias("value")).unionByName(header).repartition(1).sortWithinPartitions("k").select("value").write.text(path)
    return sources.read_csv(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "said", "segment")


@register("csv_function_sql", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def csv_function_sql(spark, d):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, d, "nation").write.csv(path, header=True, quote='"', escape='"')
    s = st.DocumentStore(spark)
    return s.sql(f"SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, count(*) AS n FROM read_csv('{path}') GROUP BY n_regionkey")


@register("read_json_roundtrip", "SELECT event_id, event_type, value, props FROM events")
def read_json_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    table(spark, d, "events").select("event_id", "event_type", "value", "props").write.mode("overwrite").json(path)
    return sources.read_json(spark, path).select("event_id", "event_type", "value", "props")


def _store(spark, d):
    s = st.DocumentStore(spark)
    s.add_table(_conversation_markdown(spark, d).select("path", "text"))
    return s


def _here(spark, df):
    """The result in the caller's session."""
    _, path = written(df, "result")
    return spark.read.schema(df.schema).parquet(path)


@register(
    "store_sql_sections",
    _CONV_TEXT + " SELECT c.content AS title, count(*) AS n_blocks, sum((b.depth = 2)::INT)::BIGINT AS n_heads FROM conv_blocks c JOIN conv_blocks b ON b.document_id = c.document_id AND c.pre < b.pre AND b.post < c.post WHERE c.depth = 1 GROUP BY 1",
)
def store_sql_sections(spark, d):
    return _here(
        spark,
        _store(spark, d).sql(
            "SELECT c.content AS title, count(*) AS n_blocks, sum(CASE WHEN b.depth = 2 THEN 1 ELSE 0 END) AS n_heads FROM blocks c JOIN blocks b ON b.document_id = c.document_id AND under(b.pre, b.post, c.pre, c.post) WHERE c.depth = 1 GROUP BY c.content"
        ),
    )


@register("store_documents", "SELECT 'conv/' || conv_id || '.md' AS path, 'Conversation ' || conv_id AS title, '[]' AS tags FROM (SELECT DISTINCT conv_id FROM conversations)")
def store_documents(spark, d):
    return _here(spark, _store(spark, d).sql("SELECT path, title, tags FROM documents"))


@register(
    "ctas_view_insert",
    "SELECT lang, count(*) AS n FROM (SELECT CASE WHEN role = 'user' THEN 'heading' ELSE 'paragraph' END AS lang FROM conversations UNION ALL SELECT 'heading' FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT 'extra') GROUP BY 1",
)
def ctas_view_insert(spark, d):
    s = _store(spark, d)
    s.sql("CREATE TABLE kinds AS SELECT block_type FROM blocks")
    s.sql("CREATE VIEW per AS SELECT block_type AS lang, count(*) AS n FROM kinds GROUP BY block_type")
    s.sql("INSERT INTO kinds VALUES ('extra')")
    return _here(spark, s.sql("SELECT lang, n FROM per"))


@register(
    "attached_join",
    _CONV_TEXT + " SELECT a.content AS title, count(*) AS n FROM conv_blocks a JOIN conv_blocks b ON a.document_id = b.document_id WHERE a.depth = 1 AND b.depth = 2 GROUP BY 1",
)
def attached_join(spark, d):
    s = _store(spark, d)
    s.attach("other", s)
    return _here(spark, s.sql("SELECT a.content AS title, count(*) AS n FROM blocks a JOIN other.blocks b ON a.document_id = b.document_id WHERE a.depth = 1 AND b.depth = 2 GROUP BY a.content"))


@register("store_save_open", "SELECT 'paragraph' AS block_type, count(*) AS n FROM conversations WHERE role <> 'user' UNION ALL SELECT 'heading', (SELECT count(*) FROM conversations WHERE role = 'user') + (SELECT count(DISTINCT conv_id) FROM conversations)")
def store_save_open(spark, d):
    s = _store(spark, d)
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    s.save(path)
    return _here(spark, st.DocumentStore.open(spark, path).stats().where("kind = 'type'").select(F.col("name").alias("block_type"), "n"))


@register("under_heading_store", _CONV_TEXT + ", h AS (SELECT document_id, ord, pre, post FROM conv_blocks WHERE depth = 1) SELECT b.document_id AS conv, b.ord FROM conv_blocks b JOIN h ON b.document_id = h.document_id AND h.pre < b.pre AND b.post < h.post WHERE b.document_id % 2 = 0 AND b.block_type = 'paragraph'")
def under_heading_store(spark, d):
    """The builder, a heading text that every document has: the title, made the same in all."""
    s = st.DocumentStore(spark)
    texts = _conversation_markdown(spark, d).select("path", F.regexp_replace("text", "^# Conversation [0-9]+", "# Talk").alias("text"))
    s.add_table(texts)
    found = s.query().documents("title = 'Talk'").under_heading("Talk", 1).block_type("paragraph").blocks()
    conv = s.texts().select(F.col("id").alias("document_id"), F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("conv"))
    return _here(spark, found.join(conv, "document_id").where("conv % 2 = 0").select("conv", "ord"))


@register("writeback_plan", _CONV_TEXT + " SELECT document_id, 'conv/' || document_id || '.md' AS path, 2 * ord - 1 AS start_line, 2 * ord - 1 AS end_line, '## New ' || trim(replace(content, chr(10), ' ')) AS new_source FROM conv_blocks WHERE depth = 2")
def writeback_plan(spark, d):
    """The line edits that UPDATE blocks SET content = concat('New ', content) WHERE depth = 2 would make."""
    texts = _conversation_markdown(spark, d)
    b = parse_blocks(texts).where("depth = 2")
    return b.join(texts.select(F.col("id").alias("document_id"), "path"), "document_id").select(
        "document_id", "path", "span.start_line", "span.end_line", F.concat(F.repeat(F.lit("#"), F.col("depth")), F.lit(" New "), F.col("content")).alias("new_source")
    )
