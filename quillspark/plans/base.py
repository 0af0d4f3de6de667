"""Registration of queries with their DuckDB oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query; ``sql`` is the oracle, or None where SQL cannot express it."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def register_sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query of the dialect; tables are written ``{name}``.  It goes through a store's SQL front end.  The oracle is the same text unless another is given."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    plain = re.sub(r"\{(\w+)\}", r"\1", text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, *names).sql(plain)

    register(name, oracle or plain)(run)


def engine(spark: SparkSession, sf_dir: str, *names: str):
    """A store with these tables registered."""
    from ..operators.store import DocumentStore

    store = DocumentStore(spark)
    for n in names:
        store.register_table(n, table(store.spark, sf_dir, n))
    return store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
