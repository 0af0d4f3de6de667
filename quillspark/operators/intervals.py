"""Interval numbering of headings and leaves by window functions.

Of node i (1-based position in its document) with ``anc`` open headings above it
and ``desc`` nodes in its section: ``pre = 2i - 1 - anc``, ``post = pre + 2 desc + 1``.
Open headings come from running maxima per level, section ends from running
minima in reverse order, so one exchange by document and two sorts number
everything, and no frame looks further than its running value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = range(1, 7)


def _greatest(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def number_intervals(nodes: DataFrame, doc: str = "document_id", ord_: str = "ord", depth: str = "depth") -> DataFrame:
    """``nodes`` with pre, post, parent_ord (null at the top) and path (the ``ord`` of all enclosing headings, outermost first).

    ``ord`` counts from 1 without gaps in each document; ``depth`` is 1 to 6 for
    headings and 0 otherwise.
    """
    before = Window.partitionBy(doc).orderBy(F.col(ord_).asc()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(doc).orderBy(F.col(ord_).desc()).rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy(doc).orderBy(F.col(ord_).desc()).rowsBetween(Window.unboundedPreceding, 0)
    d, o = F.col(depth), F.col(ord_)
    staged = nodes.select(
        "*",
        *[F.coalesce(F.max(F.when(d == k, o)).over(before), F.lit(0)).alias(f"_last{k}") for k in LEVELS],
        *[F.min(F.when(d == k, o)).over(after).alias(f"_next{k}") for k in LEVELS],
        F.max(o).over(up_to).alias("_n"),
    )
    return _closed_form(staged, nodes.columns, d, o)


def _closed_form(staged: DataFrame, columns: list[str], d: Column, o: Column) -> DataFrame:
    """Numbers from the last and next heading of each level (``_last``, ``_next``) and the number of nodes (``_n``)."""
    opened = []
    for k in LEVELS:
        shallower = _greatest([F.lit(0), *[F.col(f"_last{j}") for j in range(1, k)]])
        opened.append(F.when((F.col(f"_last{k}") > shallower) & ((d == 0) | (d > k)), F.col(f"_last{k}")))
    anc = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in opened])
    end = F.coalesce(F.least(*[F.when(d >= k, F.col(f"_next{k}")) for k in LEVELS]), F.coalesce("_n", o) + 1)  # _n is never null, which Catalyst does not know; filters for null would make all numbers twice
    pre = 2 * o - 1 - anc
    desc = F.when(d > 0, end - o - 1).otherwise(0)
    return staged.select(
        *columns,
        pre.cast("int").alias("pre"),
        (pre + 2 * desc + 1).cast("int").alias("post"),
        F.greatest(*opened).alias("parent_ord"),
        F.array_compact(F.array(*opened)).alias("path"),
    )


def _key(doc: str) -> Column:
    """The document in a struct, which equals itself in joins where the document is null."""
    return F.struct(doc)


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in as many tasks as the session has shuffle partitions: numbers pack so well that adaptive execution would join far too many rows in one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_ord(nodes: DataFrame, keys: list[str], doc: str = "document_id", chunk: int = 4096, run: int = 1 << 20) -> DataFrame:
    """``nodes`` with ``ord``: the place in their document by the integer ``keys`` (two at least), nulls last, for documents of any size.

    A run is the nodes that agree in all keys but the last, and in that but for its
    rest by ``run``; a chunk is the runs that agree in all keys but the last two, and in the
    one before the last but for its rest by ``chunk``.  Whole division keeps the order, so
    a place is that in the run, after the earlier runs of its chunk, after the earlier
    chunks; no window sees more than a run's nodes, a chunk's runs or a document's chunks.
    """
    *high, mid = [f"_k{n}" for n in range(len(keys) - 1)]
    last = F.lit((1 << 63) - 1)
    cut = nodes.withColumns({f"_k{n}": F.coalesce(F.col(k).cast("long"), last) for n, k in enumerate(keys[:-1])} | {"_low": F.coalesce(F.col(keys[-1]).cast("long"), last)})
    cut = cut.withColumns({"_doc": _key(doc), "_run": F.expr(f"_low div {run}"), "_chunk": F.expr(f"{mid} div {chunk}")})
    earlier = lambda part, by: Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    of_run, of_chunk = [mid, "_run", *high, "_doc"], ["_chunk", *high, "_doc"]  # what differs most comes first, for sorts
    runs = cut.groupBy(*of_run, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    bases = runs.groupBy(*of_chunk).agg(F.sum("_n").alias("_n")).select(*of_chunk, F.coalesce(F.sum("_n").over(earlier(["_doc"], [*high, "_chunk"])), F.lit(0)).alias("_base"))
    inner = runs.select(*of_run, "_chunk", F.coalesce(F.sum("_n").over(earlier(of_chunk, [mid, "_run"])), F.lit(0)).alias("_in"))
    starts = inner.join(bases, of_chunk).select(*of_run, (F.col("_base") + F.col("_in")).alias("_start"))
    placed = _spread(cut, *of_run).withColumn("_at", F.row_number().over(Window.partitionBy(*of_run).orderBy("_low")))
    return placed.join(starts, of_run).select(*nodes.columns, (F.col("_start") + F.col("_at")).cast("int").alias("ord"))


def with_block_ids(blocks: DataFrame) -> DataFrame:
    """Store-wide running ``id`` from 0, in (document_id, ord) order; ``ord`` counts from 1 without gaps in each document.

    Block counts per document are summed up (one row per document), so no window
    ever sees blocks.
    """
    counts = blocks.groupBy("document_id").agg(F.count(F.lit(1)).alias("_c"))
    # documents are range-partitioned into buckets; only bucket totals meet in one window
    bucketed = counts.withColumn("_b", F.expr("document_id div 65536"))
    in_bucket = Window.partitionBy("_b").orderBy("document_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy("_b").agg(F.sum("_c").alias("_t"))
    over_buckets = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_b", F.coalesce(F.sum("_t").over(over_buckets), F.lit(0)).alias("_base"))
    starts = bucketed.select("_b", "document_id", F.coalesce(F.sum("_c").over(in_bucket), F.lit(0)).alias("_in")).join(bases, "_b")
    starts = starts.select("document_id", (F.col("_base") + F.col("_in")).alias("_start"))
    return blocks.join(starts, "document_id").withColumn("id", (F.col("_start") + F.col("ord") - 1).cast("long")).drop("_start")


def number_chunked(nodes: DataFrame, chunk: int, doc: str = "document_id", ord_: str = "ord", depth: str = "depth") -> DataFrame:
    """``number_intervals`` for documents of any size: its windows see ``chunk`` nodes each.

    Of a chunk, the last and first heading of each level are carried to the chunks
    after and before it, in windows over one row per chunk; so one huge document
    spreads over the cluster.
    """
    cut = nodes.withColumns({"_doc": _key(doc), "_chunk": F.expr(f"({ord_} - 1) div {chunk}")})
    d, o = F.col(depth), F.col(ord_)
    ends = cut.groupBy("_chunk", "_doc").agg(
        *[F.max(F.when(d == k, o)).alias(f"_hi{k}") for k in LEVELS], *[F.min(F.when(d == k, o)).alias(f"_lo{k}") for k in LEVELS], F.max(o).alias("_hi")
    )
    earlier = Window.partitionBy("_doc").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("_doc").orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "_chunk",
        "_doc",
        *[F.max(f"_hi{k}").over(earlier).alias(f"_before{k}") for k in LEVELS],
        *[F.min(f"_lo{k}").over(later).alias(f"_after{k}") for k in LEVELS],
        F.max("_hi").over(Window.partitionBy("_doc")).alias("_n"),
    )
    here = Window.partitionBy("_chunk", "_doc")
    before = here.orderBy(F.col(ord_).asc()).rowsBetween(Window.unboundedPreceding, -1)
    after = here.orderBy(F.col(ord_).desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = _spread(cut, "_chunk", "_doc").select(
        "*", *[F.max(F.when(d == k, o)).over(before).alias(f"_last{k}") for k in LEVELS], *[F.min(F.when(d == k, o)).over(after).alias(f"_next{k}") for k in LEVELS]
    )
    joined = placed.join(carried, ["_chunk", "_doc"])
    staged = joined.withColumns(
        {f"_last{k}": F.coalesce(f"_last{k}", f"_before{k}", F.lit(0)) for k in LEVELS} | {f"_next{k}": F.coalesce(f"_next{k}", f"_after{k}") for k in LEVELS}
    )
    return _closed_form(staged, nodes.columns, d, o)


def under(pre: str | Column, post: str | Column, anchor_pre: str | Column, anchor_post: str | Column) -> Column:
    """Whether (pre, post) lies inside the anchor's interval; the document must be compared besides."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (c(anchor_pre) < c(pre)) & (c(post) < c(anchor_post))


def is_under(prefix: str, ancestor: str) -> Column:
    """Whether the block whose columns start with ``prefix`` lies in the section of ``ancestor``, documents compared."""
    return (F.col(f"{prefix}document_id") == F.col(f"{ancestor}document_id")) & under(f"{prefix}pre", f"{prefix}post", f"{ancestor}pre", f"{ancestor}post")


def contains(prefix: str, descendant: str) -> Column:
    """Whether ``descendant`` lies in the section of the block whose columns start with ``prefix``."""
    return is_under(descendant, prefix)


def is_under_interval(pre: int, post: int) -> Column:
    """Whether a block lies in the interval, of whatever document."""
    return under("pre", "post", F.lit(pre), F.lit(post))


def heading_depth() -> Column:
    """1 to 6 for headings, else null."""
    return F.when(F.col("block_type") == "heading", F.col("depth"))


def code_lang() -> Column:
    """The language of a code block that has one, else null."""
    return F.when((F.col("block_type") == "code") & (F.col("lang") != ""), F.col("lang"))
