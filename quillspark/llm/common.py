"""What the operators of this package share: table access and cut lineage."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that every executor reaches: ``spark.checkpoint.dir``.

    Where the setting is empty a local session gets a folder of its own, removed
    at exit; a cluster session without the setting is an error, because a
    machine-local folder would be lost with its executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quillspark-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column) -> F.Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def free_prefix(columns: list[str]) -> str:
    """A prefix that no column name starts with."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def released(run):
    """``run`` for ``mapInArrow``, which gives free memory back to the system at its end: workers live on between stages."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library; nothing depends on it

    return trimmed
