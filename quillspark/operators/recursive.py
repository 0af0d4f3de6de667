"""Recursive queries with set semantics (UNION), as a fixed point of frontiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .shared import written

LIMIT = 10_000


class RecursionLimit(RuntimeError):
    pass


def fixed_point(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = LIMIT) -> DataFrame:
    """All rows reachable from ``anchor`` by ``step``, each once.

    ``step`` gets the rows that were new in the round before; new rows are what it
    yields and no earlier round had.  Each round is written to the shared folder,
    so plans stay as long as one round and a lost executor costs one round.
    """
    spark, schema = anchor.sparkSession, anchor.schema
    frontier, path = written(anchor.distinct(), "recursion")
    paths = [path]
    while not frontier.isEmpty():
        if len(paths) > limit:
            raise RecursionLimit(f"recursive query exceeded {limit} iterations")
        made = step(frontier)
        if len(made.columns) != len(anchor.columns):
            raise ValueError("anchor and recursive part differ in their number of columns")
        seen = spark.read.schema(schema).parquet(*paths)
        made = made.select(*[made[c].cast(f.dataType).alias(f.name) for c, f in zip(made.columns, schema)])
        frontier, path = written(made.subtract(seen), "recursion")
        paths.append(path)
    return spark.read.schema(schema).parquet(*paths)
