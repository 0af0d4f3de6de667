"""Finding and reading Markdown files, CSV and JSON Lines."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import written

GLOB = "*.{md,markdown}"


def warn(path: str) -> None:
    warnings.warn(f"no such path: {path}" if not os.path.exists(path) else f"not readable as UTF-8: {path}", stacklevel=3)


def markdown_files(spark: SparkSession, paths: list[str], recursive: bool = True) -> tuple[DataFrame, list[str]]:
    """(path, text) of the Markdown files under the paths, and the local paths that do not exist; other files are passed over."""
    frames, missing = [], []
    for p in paths:
        if "://" not in p and not os.path.exists(p) and not any(c in p for c in "*?[{"):
            missing.append(p)
            continue
        how = {}
        if "://" not in p and os.path.isfile(p):
            if not p.endswith((".md", ".markdown")):
                continue
        else:
            how = {"pathGlobFilter": GLOB, "recursiveFileLookup": recursive}
        frames.append(spark.read.text(p, wholetext=True, **how).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), F.col("value").alias("text")))
    if not frames:
        return spark.createDataFrame([], "path string, text string"), missing
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out, missing


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """RFC 4180 with a header; short rows are padded with nulls, types inferred.

    A file is one task's only if a field spans lines (a line has an odd number of
    quotes then, which a splittable pass finds out); else its lines are spread.
    """
    odd = F.regexp_count("value", F.lit('"')) % 2 == 1
    spans = not spark.read.text(path).where(odd).isEmpty()
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=spans, quote='"', escape='"', mode="PERMISSIVE")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines; columns in the order they first appear, nested values as text, a bad line is an error that names it."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = lines.where(F.json_object_keys("value").isNull())
    if not bad.isEmpty():
        numbered = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
        first = numbered.where((F.trim("line") != "") & F.json_object_keys("line").isNull()).agg(F.min("n")).first()[0]
        raise ValueError(f"{path}: line {first + 1} is not a JSON object")
    placed = lines.select(F.monotonically_increasing_id().alias("r"), F.posexplode(F.json_object_keys("value")).alias("p", "k"))
    order = [r["k"] for r in placed.groupBy("k").agg(F.min(F.struct("r", "p")).alias("at")).orderBy("at").collect()]
    df = spark.read.json(path)
    kinds = dict(df.dtypes)
    if not order:
        return df
    return df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if kinds[c].startswith(("struct", "array", "map")) else F.col(f"`{c}`") for c in order])


def with_ids(files: DataFrame, start: int = 0) -> tuple[DataFrame, int]:
    """(id, path, text) and the number of rows: ids run from ``start`` in path order, one for each row.

    Rows without path come first; rows of equal path go by a hash of their text.
    Rows are sorted into ranges once and written with their place in the range; only
    the sizes of the ranges, one a partition, meet in a window.
    """
    files = files.select("path", "text").withColumn("_h", F.xxhash64("text"))
    placed = files.repartitionByRange("path", "_h").sortWithinPartitions("path", "_h").withColumn("_m", F.monotonically_increasing_id())
    placed, _ = written(placed, "placed")
    # monotonically_increasing_id: the partition above bit 33, the row's place in it below
    placed = placed.withColumn("_p", F.shiftright("_m", 33))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(bases), "_p").select((F.col("_base") + place + start).cast("long").alias("id"), "path", "text")
    return numbered, sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
