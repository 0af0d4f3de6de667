"""Incremental indexing of arriving Markdown files.

A file stream is parsed in micro-batches; each batch is compared with the store by
content hash, so only added and changed files are parsed and written, as one more
part of the store.  A batch that is run again after a failure finds its files
unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import DocumentStore
from ..sources.files import GLOB


def file_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """path, text, modified of Markdown files as they arrive."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", GLOB).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(folder)
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))


def latest(batch: DataFrame) -> DataFrame:
    """The newest text of each path; combined on the map side."""
    return batch.groupBy("path").agg(F.max_by("text", "modified").alias("text"))


def keep_indexed(spark: SparkSession, folder: str, store_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start indexing ``folder`` into the store at ``store_path`` (made if absent)."""

    def apply(batch: DataFrame, _epoch: int) -> None:
        session = batch.sparkSession
        # only a store that is not there is made; one that cannot be read is an error, never replaced
        store = DocumentStore.open(session, store_path) if DocumentStore.exists(session, store_path) else DocumentStore(session, location=store_path)
        new = latest(batch.select("path", "text", "modified"))
        from ..operators.shared import written

        _, path = written(new, "arrived")
        report = store.reindex_table(store.spark.read.schema("path string, text string").parquet(path))
        if report["added"] or report["updated"]:
            store.save(store_path)

    stream = file_stream(spark, folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events a window and type, late rows up to the watermark; the same plan for batch and stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )
