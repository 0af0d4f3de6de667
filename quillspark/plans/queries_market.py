"""Queries over a Markdown document per nation: every kind of block, statements, write-back, the builder, files and sinks."""

from __future__ import annotations

import io
import os
import uuid

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import navigation as nav
from ..operators.recursive import RecursionLimit, fixed_point
from ..operators.shared import shared_dir
from ..operators.store import DocumentStore
from ..plans.query import Query
from ..sources import files as sources
from ..sources import render
from . import selector
from .base import engine, register, table


def market_markdown(spark, d):
    """path, text: front matter, the nation's customers as a list, its suppliers as a table, and one block of each other kind."""
    listed = lambda df, key, *by: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*by))).alias("all"))
    c = listed(table(spark, d, "customer"), "c_nationkey", "c_custkey", "c_name").withColumnRenamed("all", "cs")
    s = listed(table(spark, d, "supplier"), "s_nationkey", "s_suppkey", "s_name").withColumnRenamed("all", "ss")
    n = table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    k, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    lines = lambda col, one: F.coalesce(F.array_join(F.transform(col, one), "\n"), F.lit(""))
    text = F.concat(
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("---\ntitle: "), name, F.lit("\n---\n\n"))).otherwise(F.concat(F.lit('+++\ntitle = "'), name, F.lit('"\n+++\n\n'))),
        F.lit("# "), name, F.lit("\n\n## Customers\n\n"),
        lines("cs", lambda x: F.concat(F.lit("- "), x["c_name"])),
        F.lit("\n\n## Suppliers\n\n| name | key |\n| --- | --- |\n"),
        lines("ss", lambda x: F.concat(F.lit("| "), x["s_name"], F.lit(" | "), x["s_suppkey"].cast("string"), F.lit(" |"))),
        F.lit("\n\n> "), name, F.lit(" in brief\n\n```sql\nSELECT '"), name, F.lit("'\n```\n\n$$\nx = "), k, F.lit('\n$$\n\n<hr class="'), k,
        F.lit('">\n\n[ref]: http://example.org/'), k, F.lit("\n\n[^1]: note on "), name, F.lit("\n\n***\n\nThe end.\n"),
    )
    return n.select(F.concat(F.lit("n/"), k, F.lit(".md")).alias("path"), text.alias("text"))


#: (k, ord, block_type, content, depth, lang) of the same documents
MARKET = """WITH RECURSIVE n AS (SELECT n_nationkey AS k, n_name AS nm FROM nation), pieces AS (
  SELECT k, 0 AS s, 0::BIGINT AS i, 0 AS j, CASE WHEN k % 2 = 0 THEN 'yaml' ELSE 'toml' END AS block_type, CASE WHEN k % 2 = 0 THEN 'title: ' || nm ELSE 'title = "' || nm || '"' END AS content, 0 AS depth, '' AS lang FROM n
  UNION ALL SELECT k, 1, 0, 0, 'heading', nm, 1, '' FROM n
  UNION ALL SELECT k, 2, 0, 0, 'heading', 'Customers', 2, '' FROM n
  UNION ALL SELECT c_nationkey, 3, c_custkey, 0, 'list', c_name, 0, '' FROM customer
  UNION ALL SELECT k, 4, 0, 0, 'heading', 'Suppliers', 2, '' FROM n
  UNION ALL SELECT k, 5, -2, j, CASE WHEN j = 0 THEN 'table_row' ELSE 'table_cell' END, ['name | key', 'name', 'key'][j + 1], 0, '' FROM n, (SELECT unnest([0, 1, 2]) AS j)
  UNION ALL SELECT k, 5, -1, 0, 'table_align', '', 0, '' FROM n
  UNION ALL SELECT s_nationkey, 5, s_suppkey, j, CASE WHEN j = 0 THEN 'table_row' ELSE 'table_cell' END, [s_name || ' | ' || s_suppkey, s_name, s_suppkey::VARCHAR][j + 1], 0, '' FROM supplier, (SELECT unnest([0, 1, 2]) AS j)
  UNION ALL SELECT k, 6, 0, 0, 'blockquote', nm || ' in brief', 0, '' FROM n
  UNION ALL SELECT k, 7, 0, 0, 'code', 'SELECT ''' || nm || '''', 0, 'sql' FROM n
  UNION ALL SELECT k, 8, 0, 0, 'math', 'x = ' || k, 0, '' FROM n
  UNION ALL SELECT k, 9, 0, 0, 'html', '<hr class="' || k || '">', 0, '' FROM n
  UNION ALL SELECT k, 10, 0, 0, 'definition', 'ref', 0, '' FROM n
  UNION ALL SELECT k, 11, 0, 0, 'footnote', 'note on ' || nm, 0, '' FROM n
  UNION ALL SELECT k, 12, 0, 0, 'horizontal_rule', '', 0, '' FROM n
  UNION ALL SELECT k, 13, 0, 0, 'paragraph', 'The end.', 0, '' FROM n
), m AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY s, i, j) AS ord, s, block_type, content, depth, lang FROM pieces)"""


def _market(spark, d) -> DocumentStore:
    s = DocumentStore(spark)
    s.add_table(market_markdown(s.spark, d))
    return s


def _by_path(s: DocumentStore, blocks):
    """``blocks`` with the number of the nation, off the path."""
    keys = s.texts().select(F.col("id").alias("document_id"), F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("k"))
    return blocks.join(keys, "document_id")


@register("md_all_blocks", MARKET + " SELECT k, ord, block_type, content, depth, lang FROM m")
def md_all_blocks(spark, d):
    s = _market(spark, d)
    return _by_path(s, s.blocks()).select("k", "ord", "block_type", "content", "depth", "lang")


@register("zone_maps_market", MARKET + " SELECT k, max(depth) AS max_depth, CASE WHEN k % 2 = 0 THEN 'title' ELSE '' END AS matter, max(CASE WHEN s = 1 THEN content END) AS title, 'sql' AS languages FROM m GROUP BY k")
def zone_maps_market(spark, d):
    s = _market(spark, d)
    return _by_path(s, s.zone_maps()).select("k", F.col("max_heading_depth").alias("max_depth"), F.array_join("frontmatter_keys", ",").alias("matter"), "title", F.array_join("code_languages", ",").alias("languages"))


# -- the builder


def _builder(name: str, sql: str):
    def add(build):
        def run(spark, d):
            s = _market(spark, d)
            return _by_path(s, build(s.query()).blocks()).select("k", "ord", "content")

        register(name, MARKET + sql)(run)

    return add


_builder("builder_under_heading", " SELECT k, ord, content FROM m WHERE s = 3")(lambda q: q.under_heading("Customers", 2).block_type("list"))
_builder("builder_zone_predicate", " SELECT k, ord, content FROM m WHERE k % 2 = 0 AND depth = 2")(lambda q: q.documents("false").documents("array_contains(frontmatter_keys, 'title')").heading_depth(2))
_builder("builder_contains", " SELECT k, ord, content FROM m WHERE s = 3 AND contains(content, '7') AND contains(lower(content), 'customer#')")(lambda q: q.content_contains("7").content_contains_ci("cUSTOMER#").block_type("list"))
_builder("builder_code", " SELECT k, ord, content FROM m WHERE s = 7")(lambda q: q.code_lang("sql"))
_builder("builder_interval", " SELECT k, ord, content FROM m WHERE ord > 2 AND block_type = 'footnote'")(lambda q: q.under_interval(3, 1 << 30).filter("block_type = 'footnote'").filter(F.col("content").startswith("note")))


@register("builder_limit_count", MARKET + ", d AS (SELECT k, min(ord) AS ord FROM m WHERE depth = 2 GROUP BY k ORDER BY k::VARCHAR LIMIT 1) SELECT count(*) AS n, 2 AS first_rows FROM m WHERE depth = 2")
def builder_limit_count(spark, d):
    s = _market(spark, d)
    q: Query = s.query().heading_depth(2)
    return s.spark.createDataFrame([(q.count(), len(q.limit(2).collect()))], "n long, first_rows int")


@register("nav_descendants", MARKET + " SELECT k, ord FROM m WHERE k = 3 AND s = 3")
def nav_descendants(spark, d):
    s = _market(spark, d)
    head = _by_path(s, s.blocks()).where("k = 3 AND content = 'Customers'").first()
    return _by_path(s, nav.descendants_of(s.blocks(), head["document_id"], head["pre"], head["post"])).select("k", "ord")


@register("nav_is_under", MARKET + " SELECT k, CASE WHEN s = 3 THEN 'Customers' ELSE 'Suppliers' END AS section, count(*) AS n, count(*) FILTER (lang = 'sql') AS with_language FROM m WHERE s = 3 OR s > 4 GROUP BY 1, 2")
def nav_is_under(spark, d):
    """Blocks under each level-2 heading, by the column helpers."""
    s = _market(spark, d)
    b = _by_path(s, s.blocks())
    heads = b.where(iv.heading_depth() == 2).alias("h")
    pairs = heads.join(b.withColumn("language", iv.code_lang()).alias("x"), iv.is_under("x.", "h."))
    return pairs.groupBy(F.col("h.k").alias("k"), F.col("h.content").alias("section")).agg(F.count(F.lit(1)).alias("n"), F.count("x.language").alias("with_language"))


# -- statements


@register("stmt_show_drop", "SELECT * FROM (VALUES ('blocks', 'built-in'), ('documents', 'built-in'), ('c', 'custom'), ('nation', 'custom'), ('w', 'view')) t(\"table\", kind)")
def stmt_show_drop(spark, d):
    s = engine(spark, d, "nation")
    for text in ("CREATE TABLE a (x INT)", "CREATE TABLE b AS SELECT 1 AS x", "CREATE TABLE c (x INT, y TEXT)", "CREATE VIEW v AS SELECT x FROM c", "CREATE OR REPLACE VIEW v AS SELECT y FROM c", "CREATE VIEW w AS SELECT n_name FROM nation"):
        s.sql(text)
    s.sql("DROP TABLE IF EXISTS a, b, nowhere")
    s.sql("DROP VIEW v")
    return s.sql("SHOW TABLES")


@register("stmt_describe", "SELECT * FROM (VALUES ('id', 'integer'), ('document_id', 'integer'), ('block_type', 'text'), ('content', 'text'), ('pre', 'integer'), ('post', 'integer'), ('depth', 'integer'), ('lang', 'text'), ('properties', 'text')) t(\"column\", type)")
def stmt_describe(spark, d):
    return _market(spark, d).sql("DESCRIBE blocks")


@register("stmt_insert_select", "SELECT n_name, n_regionkey, NULL::VARCHAR AS note FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 'Nowhere', NULL, 'made up'")
def stmt_insert_select(spark, d):
    s = engine(spark, d, "nation")
    s.sql("CREATE TABLE t (n_name TEXT, n_regionkey INT, note TEXT)")
    s.sql("INSERT INTO t (n_regionkey, n_name) SELECT n_regionkey, n_name FROM nation WHERE n_nationkey < 10")
    s.sql("INSERT INTO t VALUES ('Nowhere', NULL, 'made up')")
    return s.sql("SELECT * FROM t")


@register("stmt_attach_detach", MARKET + ", q AS (SELECT count(*) AS n FROM m WHERE depth = 2) SELECT nm AS title, n, 1 AS refused FROM n, q")
def stmt_attach_detach(spark, d):
    other = _market(spark, d)
    path = f"{shared_dir(spark)}/attached-{uuid.uuid4().hex}"
    other.save(path)
    s = _market(spark, d)
    s.sql(f"ATTACH DATABASE '{path}' AS other")
    out = s.sql("SELECT a.content AS title, (SELECT count(*) FROM other.blocks WHERE depth = 2) AS n, 1 AS refused FROM blocks a JOIN other.documents b ON a.content = b.title WHERE a.depth = 1 AND b.path <> ''")
    again = s.sql("SELECT content AS title FROM other.blocks WHERE depth = 1 AND content IN (SELECT n_title FROM (SELECT content AS n_title FROM blocks))")
    out = out.join(again, "title")
    s.sql("DETACH DATABASE other")
    try:
        s.sql("SELECT * FROM other.blocks").collect()
    except Exception:
        return out
    return out.withColumn("refused", F.lit(0))


@register(
    "sql_zone_skip_heading",
    MARKET + " SELECT k, ord, content, (SELECT count(*) - 1 FROM n) AS skipped FROM m WHERE block_type = 'heading' AND content = 'NATION_7'",
)
def sql_zone_skip_heading(spark, d):
    return _skipping(spark, d, "block_type = 'heading' AND content = 'NATION_7'")


@register("sql_zone_skip_language", MARKET + " SELECT k, ord, content, 0::BIGINT AS skipped FROM m WHERE lang = 'sql'")
def sql_zone_skip_language(spark, d):
    return _skipping(spark, d, "lang = 'sql'")


@register("sql_zone_skip_depth", MARKET + " SELECT k, ord, content, (SELECT count(*) FROM n) AS skipped FROM m WHERE depth = 5")
def sql_zone_skip_depth(spark, d):
    return _skipping(spark, d, "depth = 5")


@register("sql_zone_no_skip_or", MARKET + " SELECT k, ord, content, NULL::BIGINT AS skipped FROM m WHERE lang = 'sql' OR depth = 1")
def sql_zone_no_skip_or(spark, d):
    return _skipping(spark, d, "lang = 'sql' OR depth = 1")


def _skipping(spark, d, where: str):
    """The rows, and how many documents EXPLAIN ANALYZE says were skipped."""
    s = _market(spark, d)
    told = dict(tuple(r) for r in s.sql(f"EXPLAIN ANALYZE SELECT document_id, content FROM blocks WHERE {where}").collect())
    skipped = told.get("documents skipped")
    rows = s.sql(f"SELECT document_id, pre, content FROM blocks WHERE {where}")
    found = rows.join(s.blocks().select("document_id", "pre", "ord"), ["document_id", "pre"])
    return _by_path(s, found).select("k", "ord", "content", F.lit(skipped).cast("long").alias("skipped"))


@register("stmt_explain", MARKET + " SELECT (SELECT count(*) FROM m WHERE content = 'NATION_7')::VARCHAR AS rows_out, (SELECT count(*) FROM m WHERE k = (SELECT k FROM n WHERE nm = 'NATION_7'))::VARCHAR AS candidates, true AS semi_join, 1::BIGINT AS skips")
def stmt_explain(spark, d):
    s = _market(spark, d)
    rows = [tuple(r) for r in s.sql("EXPLAIN ANALYZE SELECT content FROM blocks WHERE block_type = 'heading' AND content = 'NATION_7'").collect()]
    told = dict(rows)
    return s.spark.createDataFrame([(told["rows"], told["candidate rows"], any("LeftSemi" in t for k, t in rows if k == "plan"), sum(k == "skip" for k, _ in rows))], "rows_out string, candidates string, semi_join boolean, skips long")


@register("stmt_vacuum_refused", "SELECT true AS refused")
def stmt_vacuum_refused(spark, d):
    s = DocumentStore(spark)
    try:
        s.sql("VACUUM")
    except ValueError as e:
        return s.spark.createDataFrame([("store.vacuum()" in str(e),)], "refused boolean")
    return s.spark.createDataFrame([(False,)], "refused boolean")


_REFUSED = {
    "column outside the grouping": "SELECT n_name, count(*) FROM nation",
    "unknown function": "SELECT no_such_function(n_name) FROM nation",
    "unknown column": "SELECT nothing FROM nation",
    "unknown table": "SELECT * FROM nowhere",
    "anchor that refers to itself": "WITH RECURSIVE r(i) AS (SELECT i FROM r UNION SELECT 1) SELECT i FROM r",
    "columns of the recursive part": "WITH RECURSIVE r(i) AS (SELECT 1 UNION SELECT i, i FROM r) SELECT i FROM r",
    "table that exists": "CREATE TABLE nation (x INT)",
    "built-in table": "DROP TABLE blocks",
    "view of itself": "CREATE VIEW v AS SELECT * FROM v",
    "values too few": "INSERT INTO t VALUES (1)",
    "statement": "GRANT ALL ON nation",
    "attached alias": "DETACH nobody",
}


@register("stmt_refusals", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', true)" for k in _REFUSED) + ") t(what, refused)")
def stmt_refusals(spark, d):
    s = engine(spark, d, "nation")
    s.sql("CREATE TABLE t (x INT, y INT)")

    def refused(text: str) -> bool:
        try:
            s.sql(text).collect()
        except Exception:
            return True
        return False

    return s.spark.createDataFrame([(k, refused(text)) for k, text in _REFUSED.items()], "what string, refused boolean")


@register("recursion_cap", "SELECT 'recursive query exceeded 4 iterations' AS said")
def recursion_cap(spark, d):
    start = table(spark, d, "nation").selectExpr("n_nationkey AS n")
    try:
        said = str(fixed_point(start, lambda new: new.selectExpr("n + 100 AS n"), limit=4).count())
    except RecursionLimit as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "said string")


@register("repl_session", MARKET + " SELECT 'n' || chr(10) || count(*) || chr(10) || 'output' || chr(10) || '# NATION_7' || chr(10) AS told FROM m")
def repl_session(spark, d):
    from ..cli import repl

    out = io.StringIO()
    repl(_market(spark, d), "table", False, [".mode csv", "SELECT count(*) AS n FROM blocks", '.h1 | select(.content == "NATION_7")', ".quit", "SELECT 1"], out)
    return spark.createDataFrame([(out.getvalue(),)], "told string")


@register("sink_blocks_html", r"""SELECT '<h1>NATION_7</h1>' || chr(10) || '<h2>Customers</h2>' || chr(10) || '<h2>Suppliers</h2>' AS html""")
def sink_blocks_html(spark, d):
    s = _market(spark, d)
    found = _by_path(s, s.query().documents("array_contains(heading_contents, 'NATION_7')").block_type("heading").blocks())
    return s.spark.createDataFrame([(render.blocks_to_html(found.orderBy("ord").collect()),)], "html string")


@register("mq_function", MARKET + " SELECT 'n/' || k || '.md' AS path, 'Customers' || chr(10) || 'Suppliers' AS heads, '```sql' || chr(10) || 'SELECT ''' || nm || '''' || chr(10) || '```' AS code, NULL::VARCHAR AS nothing FROM n")
def mq_function(spark, d):
    s = DocumentStore(spark)
    s.register_table("notes", market_markdown(s.spark, d))
    return s.sql("SELECT path, mq('.h2 | to_text', text) AS heads, mq('select(.code_lang == \"sql\")', text) AS code, mq('.h6', text) AS nothing FROM notes")


@register(
    "selector_kinds",
    MARKET
    + """ SELECT k, ord, 'list' AS program, '- ' || content AS output FROM m WHERE block_type = 'list' UNION ALL SELECT k, ord, 'math', '$$' || chr(10) || content || chr(10) || '$$' FROM m WHERE block_type = 'math'
    UNION ALL SELECT k, ord, 'quote', '> ' || content FROM m WHERE block_type = 'blockquote' UNION ALL SELECT k, ord, 'either', content FROM m WHERE depth = 1 OR block_type = 'footnote'""",
)
def selector_kinds(spark, d):
    s = _market(spark, d)
    programs = {"list": ".list", "math": ".math", "quote": 'select(.block_type == "blockquote")', "either": 'select(.depth == 1 or .block_type == "footnote") | to_text'}
    out = None
    for name, program in programs.items():
        one = _by_path(s, selector.run(s.blocks(), program)).select("k", "ord", F.lit(name).alias("program"), "output")
        out = one if out is None else out.unionByName(one)
    return out


# -- write-back, through files


def _files(spark, d) -> tuple[DocumentStore, str]:
    """A store of the documents as files in a local folder."""
    folder = f"{shared_dir(spark).removeprefix('file://')}/files-{uuid.uuid4().hex}"
    os.makedirs(folder)
    s = DocumentStore(spark)
    for r in sorted(market_markdown(s.spark, d).toLocalIterator(), key=lambda r: r["path"]):
        with open(f"{folder}/{r['path'].replace('/', '-')}", "w", encoding="utf-8") as f:
            f.write(r["text"])
    s.add_paths([folder])
    return s, folder


def _back(spark, folder: str):
    """k, ord, block_type, content as parsed from the files, by a store of their own."""
    s = DocumentStore(spark)
    s.add_paths([folder])
    return _by_path_file(s, s.blocks()).select("k", "ord", "block_type", "content")


def _by_path_file(s: DocumentStore, blocks):
    keys = s.texts().select(F.col("id").alias("document_id"), F.regexp_extract("path", r"n-(\d+)\.md$", 1).cast("long").alias("k"))
    return blocks.join(keys, "document_id")


@register("writeback_update", MARKET + " SELECT k, ord, block_type, CASE WHEN depth = 2 THEN 'New ' || content WHEN s = 13 THEN 'Fin ' || k ELSE content END AS content FROM m")
def writeback_update(spark, d):
    s, folder = _files(spark, d)
    s.sql("UPDATE blocks SET content = concat('New ', content) WHERE depth = 2", allow_write_back=True)
    s.sql("UPDATE blocks b SET content = concat('Fin ', (SELECT max(regexp_extract(path, 'n-([0-9]+)', 1)) FROM documents d WHERE d.id = b.document_id)) WHERE b.block_type = 'paragraph'", allow_write_back=True)
    return _back(spark, folder)


@register("writeback_delete", MARKET + " SELECT k, row_number() OVER (PARTITION BY k ORDER BY ord) AS ord, block_type, content FROM m WHERE s NOT IN (6, 13)")
def writeback_delete(spark, d):
    s, folder = _files(spark, d)
    s.sql("DELETE FROM blocks WHERE block_type IN ('blockquote', 'paragraph')", allow_write_back=True)
    return _back(spark, folder)


@register(
    "writeback_insert",
    MARKET
    + """, a AS (SELECT k, s * 10 AS s, ord, block_type, content FROM m UNION ALL SELECT k, 15, 0, 'heading', 'Inserted' FROM n UNION ALL SELECT k, 16, 0, 'paragraph', 'Below it' FROM n UNION ALL SELECT k, 999, 0, 'paragraph', 'At the end' FROM n)
    SELECT k, row_number() OVER (PARTITION BY k ORDER BY s, ord) AS ord, block_type, content FROM a""",
)
def writeback_insert(spark, d):
    s, folder = _files(spark, d)
    ids = [(r["document_id"], r["pre"]) for r in s.blocks().where("depth = 1").select("document_id", "pre").collect()]
    values = ", ".join(f"({i}, 'heading', 'Inserted', 3, {p}), ({i}, 'paragraph', 'Below it', NULL, {p}), ({i}, 'paragraph', 'At the end', NULL, NULL)" for i, p in ids)
    s.sql(f"INSERT INTO blocks (document_id, block_type, content, depth, after_pre) VALUES {values}", allow_write_back=True)
    return _back(spark, folder)


@register("writeback_gate", MARKET + " SELECT k, ord, block_type, content, 3 AS refused FROM m")
def writeback_gate(spark, d):
    s, folder = _files(spark, d)
    refused = 0
    for text in ("UPDATE blocks SET content = 'x'", "DELETE FROM blocks", "INSERT INTO blocks (document_id, block_type, content) VALUES (0, 'paragraph', 'x')"):
        try:
            s.sql(text)
        except ValueError as e:
            refused += "allow_write_back" in str(e)
    return _back(spark, folder).withColumn("refused", F.lit(refused))


# -- the store


@register("file_discovery", MARKET + " SELECT k, count(*) AS n FROM m GROUP BY k")
def file_discovery(spark, d):
    s, folder = _files(spark, d)
    with open(f"{folder}/skipped.txt", "w") as f:
        f.write("# no Markdown")
    found, missing = sources.markdown_files(s.spark, [folder, f"{folder}/none.md"])
    assert len(missing) == 1
    t = DocumentStore(spark)
    t.add_table(found)
    return _by_path_file(t, t.blocks()).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@register(
    "store_ids",
    """WITH p AS (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN '' ELSE source END AS path FROM documents)
    SELECT path, count(*) AS n, count(*) AS ids, coalesce((SELECT count(*) FROM p q WHERE (q.path IS NULL AND p.path IS NOT NULL) OR q.path < p.path), 0) AS first_id FROM p GROUP BY path""",
)
def store_ids(spark, d):
    """Rows without path and rows of equal path have ids of their own, which go by path."""
    s = DocumentStore(spark)
    path = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source"))
    s.add_table(table(s.spark, d, "documents").select(path.cast("string").alias("path"), "text"))
    return s.texts().groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"))


@register(
    "reindex_store",
    MARKET
    + """ SELECT k, CASE WHEN k % 5 = 1 THEN 'updated' WHEN k % 5 = 2 THEN 'missing' WHEN k % 5 = 3 THEN 'added' ELSE 'unchanged' END AS status, count(*) + (k % 5 = 1)::INT AS n,
    (SELECT count(*) + count(*) FILTER (nk % 5 = 1) FROM (SELECT k AS nk FROM n)) AS parsed FROM m GROUP BY k""",
)
def reindex_store(spark, d):
    """The store after a first state (without k = 3 mod 5) was brought to a second one (k = 1 mod 5 changed, k = 2 mod 5 gone but kept): blocks per document, and how many documents were parsed in all."""
    s = DocumentStore(spark)
    texts = market_markdown(s.spark, d).withColumn("k", F.regexp_extract("path", r"(\d+)", 1).cast("long"))
    s.add_table(texts.where("k % 5 <> 3").select("path", "text"))
    before = s.texts().select("id", "path").join(s.blocks().groupBy(F.col("document_id").alias("id")).agg(F.min("id").alias("first")), "id")
    s.reindex_table(texts.where("k % 5 <> 2").select("path", F.when(F.col("k") % 5 == 1, F.concat("text", F.lit("\nOne more.\n"))).otherwise(F.col("text")).alias("text")))
    after = s.texts().select("id", "path").join(s.blocks().groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("now")), "id")
    k = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    both = after.withColumn("k", k).join(before.select("id", "first"), "id", "left")
    status = F.when(F.col("first").isNull(), "added").when(F.col("first") != F.col("now"), "updated").when(F.col("k") % 5 == 2, "missing").otherwise("unchanged")
    return both.select("k", status.alias("status"), "n", F.lit(s.parsed).cast("long").alias("parsed"))


@register("append_saves_a_part", MARKET + " SELECT (SELECT count(*) FROM n) + 2 AS documents, (SELECT count(*) FROM m) + 2 AS blocks, 2 AS parsed_again, true AS parts_kept")
def append_saves_a_part(spark, d):
    path = f"{shared_dir(spark)}/appended-{uuid.uuid4().hex}"
    _market(spark, d).save(path)
    s = DocumentStore.open(spark, path)
    first = [vars(p).copy() for p in s._parts]
    s.append_str("# One\n")
    s.append_str("# Two\n", "two.md")
    again = DocumentStore.open(spark, path)
    kept = [vars(p) for p in again._parts[: len(first)]] == first
    return again.totals().select("documents", "blocks", F.lit(s.parsed).alias("parsed_again"), F.lit(kept).alias("parts_kept"))


@register("replace_vacuum_migrate", MARKET + " SELECT k, CASE WHEN k = 4 THEN 1 ELSE count(*) END AS n, 2 AS version, true AS shrunk FROM m GROUP BY k")
def replace_vacuum_migrate(spark, d):
    path = f"{shared_dir(spark)}/vacuumed-{uuid.uuid4().hex}"
    s = _market(spark, d)
    s.save(path)
    doc = s.texts().where("path = 'n/4.md'").first()["id"]
    s.replace_document(doc, "# Anew\n")
    s.save()
    done = s.vacuum()
    before, after = DocumentStore.migrate(spark, path)
    t = DocumentStore.load(spark, path)
    counted = _by_path(t, t.blocks()).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("k", "n", F.lit(after).alias("version"), F.lit(done["bytes_after"] < done["bytes_before"] and before == after).alias("shrunk"))


@register("register_tables", "SELECT n_name FROM nation WHERE n_regionkey = 1")
def register_tables(spark, d):
    s = engine(spark, d, "nation")
    s.sql("CREATE VIEW one AS SELECT n_name FROM nation WHERE n_regionkey = 1")
    s.register_table("gone", table(s.spark, d, "region"))
    assert s.unregister_table("gone") and not s.unregister_table("gone")
    return s.sql("SELECT n_name FROM one")


# -- sinks


@register(
    "sink_texts",
    r"""WITH r AS (SELECT * FROM region) SELECT 'csv' AS form, 'r_regionkey,r_name' || chr(10) || string_agg(r_regionkey || ',' || r_name || chr(10), '' ORDER BY r_regionkey) AS body FROM r
    UNION ALL SELECT 'tsv', 'r_regionkey' || chr(9) || 'r_name' || chr(10) || string_agg(r_regionkey || chr(9) || r_name || chr(10), '' ORDER BY r_regionkey) FROM r
    UNION ALL SELECT 'json', '[' || string_agg('{"r_regionkey": ' || r_regionkey || ', "r_name": "' || r_name || '"}', ', ' ORDER BY r_regionkey) || ']' FROM r""",
)
def sink_texts(spark, d):
    s = engine(spark, d, "region")
    found = s.sql("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey")
    return s.spark.createDataFrame([(form, render.render(found, form).rstrip("\n") if form == "json" else render.render(found, form)) for form in ("csv", "tsv", "json")], "form string, body string")
