"""Block corpora derived from relational tables, and the same nodes as SQL.

Every corpus is a node table (document_id, ord, block_type, content, depth, lang);
``ord`` counts from 1 in each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import number_chunked, number_intervals, with_ord

COLUMNS = ("document_id", "ord", "block_type", "content", "depth", "lang")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title per conversation, a level-2 heading per user turn, a paragraph per other turn."""
    turns = _read(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    title = turns.select("conv_id").distinct().select(
        F.col("conv_id").alias("document_id"), F.lit(-1).cast("long").alias("turn"), F.lit("heading").alias("block_type"), F.concat(F.lit("Conversation "), F.col("conv_id")).alias("content"), F.lit(1).alias("depth"), F.lit("").alias("lang")
    )
    body = turns.select(
        F.col("conv_id").alias("document_id"), "turn", F.when(user, "heading").otherwise("paragraph").alias("block_type"), F.col("text").alias("content"), F.when(user, 2).otherwise(0).alias("depth"), F.when(user, "").otherwise(F.col("role")).alias("lang")
    )
    order = Window.partitionBy("document_id").orderBy("turn")
    return title.unionByName(body).withColumn("ord", F.row_number().over(order)).select(*COLUMNS)


CONV_NODES = """
conv_nodes AS (
  SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY turn) AS ord, block_type, content, depth, lang FROM (
    SELECT DISTINCT conv_id AS document_id, -1 AS turn, 'heading' AS block_type, 'Conversation ' || conv_id AS content, 1 AS depth, '' AS lang FROM conversations
    UNION ALL
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'heading' ELSE 'paragraph' END, text, CASE WHEN role = 'user' THEN 2 ELSE 0 END, CASE WHEN role = 'user' THEN '' ELSE role END FROM conversations)
)"""


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source (level 1) and language (level 2) as headings, each line of the text as a paragraph."""
    docs = _read(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda t: F.struct(F.lit("paragraph").alias("block_type"), t.alias("content"), F.lit(0).alias("depth")))
    heads = F.array(
        F.struct(F.lit("heading").alias("block_type"), F.col("source").alias("content"), F.lit(1).alias("depth")),
        F.struct(F.lit("heading").alias("block_type"), F.col("lang").alias("content"), F.lit(2).alias("depth")),
    )
    nodes = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.concat(heads, lines)).alias("p", "n"))
    return nodes.select("document_id", (F.col("p") + 1).alias("ord"), "n.block_type", "n.content", "n.depth", F.lit("").alias("lang"))


DOC_NODES = """
doc_nodes AS (
  SELECT document_id, ord, CASE WHEN depth > 0 THEN 'heading' ELSE 'paragraph' END AS block_type, content, depth, '' AS lang FROM (
    SELECT doc_id AS document_id, 1 AS ord, source AS content, 1 AS depth FROM documents
    UNION ALL SELECT doc_id, 2, lang, 2 FROM documents
    UNION ALL SELECT doc_id, 2 + i, parts[i], 0 FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))
)"""


def geography_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per region: nations (2), customers (3), orders as paragraphs."""
    region, nation = _read(spark, sf_dir, "region"), _read(spark, sf_dir, "nation")
    customer, orders = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders")
    n = nation.select(F.col("n_regionkey").alias("document_id"), F.col("n_nationkey").alias("a"), "n_name")
    c = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("document_id"), F.col("n_nationkey").alias("a"), F.col("c_custkey").alias("b"), "c_name")
    o = orders.join(c, F.col("o_custkey") == F.col("b")).select("document_id", "a", "b", F.col("o_orderkey").alias("k"), "o_orderpriority")
    none = F.lit(-1).cast("long")
    every = (
        region.select(F.col("r_regionkey").alias("document_id"), none.alias("a"), none.alias("b"), none.alias("k"), F.col("r_name").alias("content"), F.lit(1).alias("depth"))
        .unionByName(n.select("document_id", F.col("a").cast("long").alias("a"), none.alias("b"), none.alias("k"), F.col("n_name").alias("content"), F.lit(2).alias("depth")))
        .unionByName(c.select("document_id", F.col("a").cast("long").alias("a"), "b", none.alias("k"), F.col("c_name").alias("content"), F.lit(3).alias("depth")))
        .unionByName(o.select("document_id", F.col("a").cast("long").alias("a"), "b", "k", F.col("o_orderpriority").alias("content"), F.lit(0).alias("depth")))
    )
    return with_ord(every, ["a", "b", "k"]).select("document_id", "ord", F.when(F.col("depth") > 0, "heading").otherwise("paragraph").alias("block_type"), "content", "depth", F.lit("").alias("lang"))


GEO_NODES = """
geo_nodes AS (
  SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY a, b, k) AS ord, CASE WHEN depth > 0 THEN 'heading' ELSE 'paragraph' END AS block_type, content, depth, '' AS lang FROM (
    SELECT r_regionkey AS document_id, -1 AS a, -1 AS b, -1 AS k, r_name AS content, 1 AS depth FROM region
    UNION ALL SELECT n_regionkey, n_nationkey, -1, -1, n_name, 2 FROM nation
    UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, -1, c_name, 3 FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, o_orderkey, o_orderpriority, 0 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
)"""


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title (level 1), headings (their level plus one, up to 6), and p, li, pre as blocks, in page order."""
    pages = _read(spark, sf_dir, "pages")
    found = F.regexp_extract_all(F.col("html"), F.lit(PAGE_PATTERN), 0)
    rows = pages.select(F.col("page_id").alias("document_id"), F.posexplode(found).alias("p", "t"))
    tag = F.regexp_extract("t", "^<([a-z0-9]+)", 1)
    text = F.regexp_replace(F.regexp_replace("t", "<[^>]*>", ""), r"^\s+|\s+$", "")
    level = F.when(tag == "title", 1).when(tag.rlike("^h[1-6]$"), F.least(F.substring(tag, 2, 1).cast("int") + 1, F.lit(6))).otherwise(0)
    kind = F.when(level > 0, "heading").when(tag == "li", "list").when(tag == "pre", "code").otherwise("paragraph")
    return rows.select("document_id", (F.col("p") + 1).alias("ord"), kind.alias("block_type"), text.alias("content"), level.alias("depth"), F.lit("").alias("lang"))


#: One alternative per element, for engines whose expressions have no back references.
PAGE_PATTERN = "|".join(f"<{t}(?: [^>]*)?>[^<]*</{t}>" for t in ("title", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre"))

PAGE_NODES = f"""
page_nodes AS (
  SELECT document_id, ord, CASE WHEN depth > 0 THEN 'heading' WHEN tag = 'li' THEN 'list' WHEN tag = 'pre' THEN 'code' ELSE 'paragraph' END AS block_type, content, depth, '' AS lang FROM (
    SELECT document_id, i AS ord, tag, regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS content,
           CASE WHEN tag = 'title' THEN 1 WHEN regexp_matches(tag, '^h[1-6]$') THEN least(substr(tag, 2, 1)::INT + 1, 6) ELSE 0 END AS depth FROM (
      SELECT document_id, i, f[i] AS t, regexp_extract(f[i], '^<([a-z0-9]+)', 1) AS tag FROM (
        SELECT document_id, f, unnest(range(1, len(f) + 1)) AS i FROM (
          SELECT page_id AS document_id, regexp_extract_all(html, '{PAGE_PATTERN}') AS f FROM pages))))
)"""


def _numbered(name: str) -> str:
    """``NAME_blocks`` from ``NAME_nodes`` in SQL: the closed form over running maxima and minima."""
    last = ", ".join(f"coalesce(max(CASE WHEN depth = {k} THEN ord END) OVER b, 0) AS l{k}" for k in range(1, 7))
    nxt = ", ".join(f"min(CASE WHEN depth = {k} THEN ord END) OVER f AS n{k}" for k in range(1, 7))
    opened = []
    for k in range(1, 7):
        above = "greatest(0" + "".join(f", l{j}" for j in range(1, k)) + ")" if k > 1 else "0"
        opened.append(f"CASE WHEN l{k} > {above} AND (depth = 0 OR depth > {k}) THEN l{k} ELSE 0 END AS o{k}")
    anc = " + ".join(f"(o{k} > 0)::INT" for k in range(1, 7))
    end = "least(total + 1" + "".join(f", CASE WHEN depth >= {k} THEN coalesce(n{k}, total + 1) ELSE total + 1 END" for k in range(1, 7)) + ")"
    return f"""
{name}_s AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS total, {last}, {nxt} FROM {name}_nodes
  WINDOW b AS (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY document_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
{name}_o AS (SELECT *, {', '.join(opened)}, CASE WHEN depth > 0 THEN {end} - ord - 1 ELSE 0 END AS inside FROM {name}_s),
{name}_blocks AS (SELECT document_id, ord, block_type, content, depth, lang, 2 * ord - 1 - ({anc}) AS pre, 2 * ord - ({anc}) + 2 * inside AS post,
  nullif(greatest({', '.join(f'o{k}' for k in range(1, 7))}), 0) AS parent_ord, list_filter([{', '.join(f'o{k}' for k in range(1, 7))}], lambda x: x > 0) AS path FROM {name}_o)"""


_NODES = {"conv": (conversation_nodes, CONV_NODES), "doc": (document_nodes, DOC_NODES), "geo": (geography_nodes, GEO_NODES), "page": (page_nodes, PAGE_NODES)}


def blocks(spark: SparkSession, sf_dir: str, corpus: str) -> DataFrame:
    nodes = _NODES[corpus][0](spark, sf_dir)
    return number_chunked(nodes, 1 << 16) if corpus == "geo" else number_intervals(nodes)  # a region is one document, however many orders it has


def blocks_sql(corpus: str) -> str:
    """CTEs that define ``CORPUS_blocks``."""
    return "WITH " + _NODES[corpus][1].strip() + "," + _numbered(corpus)
