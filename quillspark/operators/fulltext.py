"""Full text: tokens, match, score, and a postings table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def tokenize(c: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.col(c) if isinstance(c, str) else c), F.lit(WORD), 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(query: str) -> list[str]:
    return re.findall(r"\w+", query.lower().replace("_", " "))


def _query(query: Column | str) -> Column:
    """Tokens of a query; of a literal they are taken here, once."""
    if isinstance(query, str):
        words = _words(query)
        return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    return tokenize(query)


def match(content: Column | str, query: Column | str) -> Column:
    """Whether every query token is among the content's; an empty query matches nothing."""
    q = _query(query)
    exact = (F.size(q) > 0) & (F.size(F.array_except(q, tokenize(content))) == 0)
    if not isinstance(query, str):
        return exact
    # what lacks a token even as a substring is not split into tokens
    low = F.lower(F.col(content) if isinstance(content, str) else content)
    may = F.lit(True)
    for w in sorted(set(_words(query)), key=len, reverse=True):
        may = may & low.contains(w)
    return may & exact


def score(content: Column | str, query: Column | str) -> Column:
    """Occurrences of the query's tokens (a repeated one counts again) by the content's number of tokens."""
    q = _query(query)

    def of(t: Column) -> Column:
        hits = F.aggregate(q, F.lit(0), lambda acc, w: acc + F.size(F.filter(t, lambda x: x == w)))
        return F.when((F.size(t) > 0) & (F.size(q) > 0), hits / F.size(t)).otherwise(F.lit(0.0))

    return let(tokenize(content), of)


def postings(blocks: DataFrame, content: str = "content", keys: tuple[str, ...] = ("document_id", "ord")) -> DataFrame:
    """term, keys, tf: the inverted index as a table.

    Repetitions inside a block are summed on the map side, as a block's words are
    next to each other there.
    """
    words = blocks.select(*keys, F.explode(tokenize(content)).alias("term"))
    return words.groupBy("term", *keys).agg(F.count(F.lit(1)).cast("int").alias("tf"))


def postings_match(index: DataFrame, terms: list[str], keys: tuple[str, ...] = ("document_id", "ord")) -> DataFrame:
    """keys of the rows that have all terms, with the sum of their frequencies."""
    hit = index.where(F.col("term").isin(*terms)).groupBy(*keys).agg(F.count_distinct("term").alias("_n"), F.sum("tf").alias("tf"))
    return hit.where(F.col("_n") == len(set(terms))).drop("_n")


def document_frequency(index: DataFrame) -> DataFrame:
    """term, df (documents that have it), tf; partial sums per document on the map side."""
    by_doc = index.groupBy("term", "document_id").agg(F.sum("tf").alias("tf"))
    return by_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def term_statistics(texts: DataFrame, content: str = "content", document: str = "document_id") -> DataFrame:
    """term, df, tf of a table with a row per document: ``document_frequency`` of its postings without the postings.

    A row gives its distinct terms for df and all its tokens for tf, so only sums by
    term are kept and moved.  Ids are looked at first: documents of several rows
    (an id that comes again) are counted by (term, document).  A null id is no document,
    but its tokens count.
    """
    sums = [F.sum("df").alias("df"), F.sum("tf").alias("tf")]
    rows = texts.select(F.col(document).alias("_id"), F.col(content).alias("_text"))
    several = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & F.col("_id").isNotNull()).select("_id")
    if several.isEmpty():
        return _by_row(rows).groupBy("term").agg(*sums)
    words = rows.join(several, "_id", "left_semi").select("_id", F.explode(tokenize("_text")).alias("term"))
    again = words.groupBy("term", "_id").agg(F.lit(1).cast("long").alias("df"), F.count(F.lit(1)).alias("tf")).select("term", "df", "tf")
    return _by_row(rows.join(several, "_id", "left_anti")).unionByName(again).groupBy("term").agg(*sums)


def _by_row(rows: DataFrame) -> DataFrame:
    """term, df, tf: a term once for each row (_id, _text) that has it, and once for each time it occurs."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    tokens = rows.select(F.col("_id").isNotNull().cast("long").alias("_doc"), tokenize("_text").alias("_t"))
    lists = F.array(F.struct(F.col("_doc").alias("df"), zero.alias("tf"), F.array_distinct("_t").alias("t")), F.struct(zero.alias("df"), one.alias("tf"), F.col("_t").alias("t")))
    return tokens.select(F.explode(lists).alias("l")).select(F.explode("l.t").alias("term"), "l.df", "l.tf")
