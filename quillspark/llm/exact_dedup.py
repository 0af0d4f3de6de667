"""Exact dedup: 128-bit content hash, stable survivor, byte comparison in the group.

Plan.  Texts stay where they are: rows of (id, hash, SHA-256) are grouped by hash,
and only texts whose hash occurs twice, picked out of a second reading by a Bloom
filter of bounded size, are moved for the byte comparison.  That is an aggregation
on (hash, whole text): the hash leads the key, the text in the key makes the
aggregator compare bytes, so two texts that share a hash form two groups.  It is
combined on the map side: of a text that fills a third of a split one row leaves
the split.  Verdicts travel back to the rows by hash and SHA-256, never by text.

Defined cases: a null text is the empty text.  Texts are compared unchanged.
A row without id can't be a survivor while a row with an id shares its text;
where no row of a group has an id, ``keep_id`` is null and every row of it is
kept.  A repeated row (same id, same text) counts in ``group_size`` and has the
verdict of the row it repeats; ``survivors`` returns it once.  An empty table
gives an empty result.  Columns other than the two named are ignored by
``exact_dedup`` and returned untouched by ``survivors``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, materialize, table, text_or_empty
from .sieve import split


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col).cast("binary")
    return docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(text)).alias("_h"), F.unhex(F.sha2(text, 256)).alias("_s"))


def _first_half(h: str = "_h"):
    """The first 64 bits of the hash as a number."""
    return F.conv(F.hex(F.substring(h, 1, 8)), 16, -10).cast("long")


def _groups(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """One row per distinct text that occurs twice or whose hash does: _h, _s, keep_id, group_size."""
    pick = {"min": F.min, "max": F.max}[keep]
    twice = materialize(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h", _first_half().alias("k")), "hashes")
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    texts = texts.select("_id", "_t", F.unhex(F.md5(F.col("_t").cast("binary"))).alias("_h")).withColumn("k", _first_half())
    maybe, _ = split(texts, "k", twice.select("k"))
    groups = maybe.groupBy("_h", "_t").agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.select("_h", F.unhex(F.sha2(F.col("_t").cast("binary"), 256)).alias("_s"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` says whether the smallest or the largest id of equal texts stays.
    """
    rows = materialize(_hashed(docs, id_col, text_col), "hashed")
    joined = rows.join(_groups(docs, rows, id_col, text_col, keep), ["_h", "_s"], "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("_id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("_s")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged.

    Only rows that must go or that repeat another are joined; the others pass a
    Bloom filter of bounded size on their way, and no text is moved for them.
    """
    h = free_prefix(docs.columns) + "hash"
    found = exact_dedup(docs, id_col, text_col, keep).groupBy(F.col(id_col).alias("id"), F.unhex("text_sha256").alias("sha")).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    look = materialize(found.where("not stays or n > 1"), "verdicts")
    maybe, fine = split(docs, id_col, look.select("id"))
    nulls = F.col(id_col).isNull()
    rows = maybe.unionByName(fine.where(nulls)).withColumn(h, F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)))
    gone = look.where("not stays").select(F.col("id").alias(h + "_id"), F.col("sha").alias(h + "_sha")).hint("merge")
    rows = rows.join(gone, F.col(id_col).eqNullSafe(F.col(h + "_id")) & (F.col(h) == F.col(h + "_sha")), "left_anti")
    return fine.where(~nulls).unionByName(rows.dropDuplicates([id_col, h]).drop(h))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
