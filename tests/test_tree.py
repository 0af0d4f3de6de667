import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import fulltext as ft
from quillspark.operators import navigation as nav
from quillspark.operators.intervals import number_chunked, number_intervals, with_block_ids, with_ord
from quillspark.plans.dialect import translate
from quillspark.sources.markdown import front_matter, inline_text, scan


def stack_numbers(depths):
    """pre, post by walking the tree with one counter."""
    children, parent, stack = {0: []}, {}, [(0, 0)]
    for i, d in enumerate(depths, 1):
        if d:
            while len(stack) > 1 and stack[-1][1] >= d:
                stack.pop()
        children.setdefault(i, [])
        children[stack[-1][0]].append(i)
        parent[i] = stack[-1][0]
        if d:
            stack.append((i, d))
    out, tick, todo = {}, 0, [(0, False)]
    pre = {}
    while todo:
        i, done = todo.pop()
        if done:
            out[i] = (pre[i], tick)
        else:
            pre[i] = tick
            todo.append((i, True))
            todo += [(c, False) for c in reversed(children[i])]
        tick += 1
    return [(*out[i], parent[i] or None) for i in range(1, len(depths) + 1)]


def test_closed_form_is_the_walk(spark):
    rng = random.Random(2)
    docs = [[rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6]) for _ in range(rng.randrange(1, 40))] for _ in range(400)]
    rows = [(d, i, k) for d, depths in enumerate(docs) for i, k in enumerate(depths, 1)]
    df = spark.createDataFrame(rows, "document_id int, ord int, depth int").repartition(7)
    got = {}
    for r in number_intervals(df).collect():
        got.setdefault(r["document_id"], {})[r["ord"]] = (r["pre"], r["post"], r["parent_ord"])
    for d, depths in enumerate(docs):
        assert [got[d][i] for i in range(1, len(depths) + 1)] == stack_numbers(depths)
    for chunk in (1, 3, 8, 1000):
        cut = number_chunked(df, chunk)
        assert cut.columns == number_intervals(df).columns
        assert sorted(map(tuple, cut.select("document_id", "ord", "pre", "post", "parent_ord", "path").collect())) == sorted(
            map(tuple, number_intervals(df).select("document_id", "ord", "pre", "post", "parent_ord", "path").collect())
        )
    ids = {(r["document_id"], r["ord"]): r["id"] for r in with_block_ids(df).collect()}
    assert [ids[d, i] for d, i, _ in rows] == list(range(len(rows)))


def test_plan_has_one_exchange_and_no_product(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 2, 0)], "document_id int, ord int, depth int")
    plan = number_intervals(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    b = number_intervals(df)
    joined = nav.contained(b, b)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in joined and "NestedLoop" not in joined


def test_bucketed_containment_is_containment(spark):
    rng = random.Random(3)
    rows = [(0, i, rng.choice([0, 0, 1, 2, 3])) for i in range(1, 300)]
    b = number_intervals(spark.createDataFrame(rows, "document_id int, ord int, depth int"))
    pairs = lambda df: sorted((r["o"]["ord"], r["i"]["ord"]) for r in df.collect())
    assert pairs(nav.contained_bucketed(b, b, 16)) == pairs(nav.contained(b, b))


def test_tokens(spark):
    df = spark.createDataFrame([("fn main() {}",), ("v1.2.3",), ("",), ("CamelCase HTML_tag é",)], "t string")
    assert [r[0] for r in df.select(ft.tokenize("t")).collect()] == [["fn", "main"], ["v1", "2", "3"], [], ["camelcase", "html", "tag", "é"]]
    index = ft.postings(df.withColumn("document_id", F.lit(1)).withColumn("ord", F.lit(1)), "t")
    assert index.where("term = 'main'").first()["tf"] == 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="#-*_>`|~[]():$ \n\tab1.é<", max_size=200))
def test_scanner_covers_lines_in_order(text):
    last = 0
    for x in scan(text):
        assert x["start"] >= last and x["start"] <= x["end"] <= max(1, len(text.split("\n")))
        last = x["start"]
        assert 0 <= x["depth"] <= 6


def test_front_matter_and_inline():
    assert front_matter("a: 1\nb: 2.5\nc: true\nd: [x, 'y z']\ne:\n  - p\n  - q\nf:\n  g: h\nt: My Doc # note") == {"a": 1, "b": 2.5, "c": True, "d": ["x", "y z"], "e": ["p", "q"], "f": "  g: h", "t": "My Doc"}
    assert inline_text("a **b** _c_ `d` [e](f) ![g](h) snake_case_x 2 * 3 * 4") == "a b c d e g snake_case_x 2 * 3 * 4"


def test_dialect_leaves_strings_and_comments_alone():
    assert translate("SELECT 'log(1) like' -- log(2)\n, log(x) FROM t WHERE a LIKE 'b'") == "SELECT 'log(1) like' -- log(2)\n, q_log(x) FROM t WHERE a ILIKE 'b'"
    assert translate("SELECT substring(trim(a), 0, instr(b, 'x')) FROM t") == "SELECT q_substring3(q_trim(a), 0, q_instr(b, 'x')) FROM t"
    assert translate("SELECT trim(LEADING 'x' FROM a), substring(a FROM 2 FOR 3)") == "SELECT q_ltrim2(a, 'x'), q_substring3(a, 2, 3)"


def test_term_statistics_are_those_of_the_postings_without_pairs(spark):
    rows = [(1, "a b\na"), (2, "B c"), (2, "b d b"), (3, ""), (4, None), (None, "a e"), (5, "É é x1"), (2, None)]
    texts = spark.createDataFrame(rows, "document_id int, content string")
    got = sorted(map(tuple, ft.term_statistics(texts).collect()))
    assert got == [("a", 1, 3), ("b", 2, 4), ("c", 1, 1), ("d", 1, 1), ("e", 0, 1), ("x1", 1, 1), ("é", 1, 2)]
    once = texts.where("document_id in (1, 5)")
    assert sorted(map(tuple, ft.term_statistics(once).collect())) == sorted(map(tuple, ft.document_frequency(ft.postings(once, keys=("document_id",))).collect()))
    plan = ft.term_statistics(once)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(term#") == 1 and "_id#" not in plan.split("Exchange hashpartitioning(")[1].split(")")[0]


def test_term_df_keeps_no_entry_for_each_term_of_each_document(spark):
    from quillspark.plans.registry import QUERIES

    df = QUERIES["term_df"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("Aggregate [")[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert keys and all("term#" in k and "," not in k for k in keys)


def test_places_are_counted_in_runs_and_chunks(spark):
    rng = random.Random(4)
    some = lambda top: rng.choice([None, -1, *range(-3, top)])
    rows = list({(rng.randrange(3), some(3), some(40), some(60)) for _ in range(3000)}) + [(7, 0, 5, k) for k in range(500)]
    df = spark.createDataFrame(rows, "document_id int, a long, b int, k long").repartition(5)
    place = lambda r: tuple((v is None, v or 0) for v in r)
    want = [(*r, n) for d in {r[0] for r in rows} for n, r in enumerate(sorted((r for r in rows if r[0] == d), key=place), 1)]
    for chunk, run in ((1, 1), (4, 7), (4096, 1 << 20)):
        got = with_ord(df, ["a", "b", "k"], chunk=chunk, run=run)
        assert got.columns == ["document_id", "a", "b", "k", "ord"]
        assert sorted(map(tuple, got.collect()), key=place) == sorted(want, key=place)


def test_no_window_sees_all_nodes_of_a_region(spark):
    from quillspark.sources.corpora import blocks

    plan = blocks(spark, "/root/testdata/sf0.001", "geo")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    numbering = [line for line in windows if "row_number()" in line]
    assert len(numbering) == 2 and all("_run#" in line.split("windowspecdefinition(")[1].split("ASC")[0] for line in numbering)
    # by document alone, only rows of chunks are summed up or carried
    assert all("_chunk#" in line or "_hi#" in line for line in windows if line not in numbering)


def test_nodes_of_no_document_are_numbered_too(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, None, 0, 1]), a, b, k, 2 if k == 0 else 0) for a in range(3) for b in range(20) for k in range(7)]
    nodes = spark.createDataFrame(rows, "document_id int, a int, b long, k long, depth int").repartition(5)
    placed = with_ord(nodes, ["a", "b", "k"], chunk=4, run=3)
    assert placed.count() == len(rows)
    shown = lambda df: sorted(map(str, df.select("document_id", "ord", "depth", "pre", "post", "parent_ord", "path").collect()))
    whole = shown(number_intervals(placed))
    assert len(whole) == len(rows) and all(shown(number_chunked(placed, chunk)) == whole for chunk in (1, 16, 1000))


def test_geo_queries_with_nations_of_no_region(spark, tmp_path):
    import duckdb

    from quillspark.plans.registry import ORACLES, QUERIES

    db = duckdb.connect()
    for t in ("region", "nation", "customer", "orders"):
        db.execute(f"CREATE TABLE {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    db.execute("UPDATE nation SET n_regionkey = NULL WHERE n_nationkey IN (3, 7)")
    db.execute("UPDATE orders SET o_orderkey = NULL WHERE o_orderkey = 17")
    for t in ("region", "nation", "customer", "orders"):
        db.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    for name in ("section_sizes_geo", "intervals_geo", "sibling_positions_geo", "breadcrumb_geo", "section_under_bucketed_geo"):
        df, want = QUERIES[name](spark, str(tmp_path)), db.sql(f"SELECT * FROM ({ORACLES[name]})")
        assert sorted(str(tuple(r[c] for c in want.columns)) for r in df.collect()) == sorted(map(str, want.fetchall())), name


def windows_by_document_alone(df):
    """Windows of the plan that see a document's nodes: those that neither number the nodes of a run nor run over chunks or in them."""
    windows = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    numbering = [line for line in windows if "row_number()" in line]
    assert numbering
    in_run = lambda line: "_run#" in line.split("windowspecdefinition(")[1].split("ASC")[0]
    return [line for line in windows if not (in_run(line) if line in numbering else "_chunk#" in line or "_hi#" in line)]


def test_no_window_of_section_sizes_sees_a_region(spark):
    from quillspark.plans.registry import QUERIES

    assert windows_by_document_alone(QUERIES["section_sizes_geo"](spark, "/root/testdata/sf0.001")) == []


def test_no_window_of_bucketed_sections_sees_a_region_and_its_join_is_by_bucket(spark):
    from quillspark.plans.registry import QUERIES

    df = QUERIES["section_under_bucketed_geo"](spark, "/root/testdata/sf0.001")
    assert windows_by_document_alone(df) == []
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert "_bo#" in joins[0] and "_bi#" in joins[0]


def test_numbers_are_known_not_to_be_null(spark):
    from quillspark.sources.corpora import blocks

    # or joins by range filter for it first, and the numbers are made twice in a method too long for the JVM's compiler
    schema = blocks(spark, "/root/testdata/sf0.001", "geo").schema
    assert not schema["pre"].nullable and not schema["post"].nullable
