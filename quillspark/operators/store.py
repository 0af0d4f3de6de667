"""A document store: texts, blocks, zone maps, custom tables, views, attached stores.

A store is a Spark session of its own (so its names are its own) over DataFrames;
it holds no rows but those just added one by one.  What it holds lies in *parts*:
each change writes one part (texts, and when asked for the blocks parsed from them and
their zone maps) and, for documents that it replaces or drops, a list of dead ids.
Reading is one scan over all parts, less (by an anti-join with the short lists) rows
of dead documents from older parts.  So a change costs what it changes, unchanged
documents are never parsed or written again, and ``vacuum`` merges the parts.

Ids of blocks run over the store in the order in which documents were parsed and
never change; documents that are replaced get new ones.  A saved store is these
Parquet parts under one folder and a catalog of which are current, read lazily.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.query import Query
from ..schema import BLOCKS
from ..sources import files as sources
from ..sources.markdown import parse_blocks
from . import zonemaps
from .shared import shared_dir, written

VERSION = 2
TEXTS = "id long, path string, text string"
STORED_TEXTS = TEXTS + ", hash long, seq long"
DEAD = "id long, seq long"
STORED_BLOCKS = T.StructType([*BLOCKS.fields, T.StructField("seq", T.LongType())])


class StoreError(ValueError):
    pass


def content_hash(column: str = "text"):
    return F.xxhash64(column)


def reindex_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (added, updated, unchanged, missing) of two tables (path, text); only hashes are joined."""
    return _diff(old.select("path", content_hash().alias("hash")), new.select("path", content_hash().alias("hash")))


def _diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``reindex_diff`` of tables (path, hash); further columns of ``old`` are kept."""
    a, b = old.withColumnRenamed("hash", "h_old"), new.select("path", F.col("hash").alias("h_new"))
    status = (
        F.when(F.col("h_old").isNull(), "added").when(F.col("h_new").isNull(), "missing").when(F.col("h_old") == F.col("h_new"), "unchanged").otherwise("updated")
    )
    return a.join(b, "path", "full").withColumn("status", status).drop("h_old", "h_new")


@dataclass
class Part:
    """What one change wrote: folders of Parquet files, None for what is not there (yet)."""

    seq: int
    texts: str | None = None
    blocks: str | None = None
    zones: str | None = None
    dead: str | None = None


class DocumentStore:
    def __init__(self, spark: SparkSession, spans: bool = True, location: str | None = None):
        self.spark = spark.newSession()
        for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            self.spark.conf.set(name, spark.conf.get(name))
        self.spark.conf.set("spark.sql.cteRecursionLevelLimit", "10000")
        self.spark.conf.set("spark.sql.ansi.enabled", "false")  # x / 0, a bad cast or index is NULL, not an error
        self.spans = spans
        self.location = location
        self._parts: list[Part] = []
        self._new: dict[int, tuple[int, str, str]] = {}  # added one by one and not written yet
        self._dead: set[int] = set()
        self._next_id = self._next_block = self._next_seq = 0
        self._kept: dict[str, DataFrame] = {}
        self._table_paths: dict[str, tuple[DataFrame, str]] = {}
        self.parsed = 0  # documents parsed by this object
        self.tables: dict[str, DataFrame] = {}
        self.views: dict[str, str] = {}
        self.attached: dict[str, DocumentStore] = {}

    # -- parts

    def _write(self, df: DataFrame, kind: str) -> str:
        path = f"{shared_dir(self.spark)}/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _flush(self) -> None:
        """Write what was added or replaced one by one as a part."""
        if self._new or self._dead:
            texts = self.spark.createDataFrame(list(self._new.values()), TEXTS) if self._new else None
            dead = self.spark.createDataFrame([(i,) for i in sorted(self._dead)], "id long") if self._dead else None
            self._new, self._dead = {}, set()
            self._add_part(texts, dead)

    def _add_part(self, texts: DataFrame | None, dead: DataFrame | None) -> None:
        seq = F.lit(self._next_seq).cast("long").alias("seq")
        part = Part(self._next_seq)
        if texts is not None:
            part.texts = self._write(texts.select(F.col("id").cast("long").alias("id"), "path", "text", content_hash().alias("hash"), seq), "texts")
        if dead is not None:
            part.dead = self._write(dead.select(F.col("id").cast("long").alias("id"), seq), "dead")
        self._parts.append(part)
        self._next_seq += 1
        self._kept = {}

    def _live(self, kind: str, schema, key: str, parts: list[Part] | None = None) -> DataFrame:
        """One scan of ``kind`` over the parts without the rows of dead documents."""
        paths = [getattr(p, kind) for p in (self._parts if parts is None else parts) if getattr(p, kind)]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        dead = [p.dead for p in self._parts if p.dead]
        if not dead or not paths:
            return rows
        gone = self.spark.read.schema(DEAD).parquet(*dead).groupBy(F.col("id").alias("_gone")).agg(F.max("seq").alias("_gone_at"))
        return rows.join(gone, (F.col(key) == F.col("_gone")) & (F.col("seq") < F.col("_gone_at")), "left_anti")

    def _stored_texts(self) -> DataFrame:
        self._flush()
        return self._live("texts", STORED_TEXTS, "id")

    def _parse(self) -> None:
        """Parse the parts that have no blocks yet."""
        self._flush()
        for part in self._parts:
            if part.texts is None or part.blocks is not None:
                continue
            texts = self._live("texts", STORED_TEXTS, "id", [part])
            blocks = parse_blocks(texts.select("id", "text"), self.spans).withColumn("id", F.col("id") + F.lit(self._next_block))
            part.blocks = self._write(blocks.withColumn("seq", F.lit(part.seq).cast("long")), "blocks")
            made = self.spark.read.schema(STORED_BLOCKS).parquet(part.blocks)
            part.zones = self._write(zonemaps.zone_maps(made).withColumn("seq", F.lit(part.seq).cast("long")), "zones")
            self._next_block += made.count()
            self.parsed += texts.count()

    # -- documents

    def add_str(self, text: str, path: str = "") -> int:
        doc = self._next_id
        self._new[doc] = (doc, path, text)
        self._next_id += 1
        self._kept = {}
        return doc

    def add_file(self, path: str) -> int:
        with open(path, encoding="utf-8") as f:
            return self.add_str(f.read(), str(path))

    def add_table(self, texts: DataFrame) -> None:
        """Add many documents (path, text); ids go by path, rows without path and rows of equal path are documents of their own."""
        self._flush()
        numbered, n = sources.with_ids(texts, self._next_id)
        self._add_part(numbered, None)
        self._next_id += n

    def add_paths(self, paths: list[str], recursive: bool = True) -> None:
        found, failed = self._files(paths, recursive)
        for p in failed:
            sources.warn(p)
        self.add_table(found)

    def append_str(self, text: str, path: str = "") -> int:
        """Add and, in a saved store, save: one more part."""
        doc = self.add_str(text, path)
        if self.location:
            self.save()
        return doc

    def append_file(self, path: str) -> int:
        with open(path, encoding="utf-8") as f:
            return self.append_str(f.read(), str(path))

    def replace_document(self, doc: int, text: str, path: str | None = None) -> None:
        if doc in self._new:
            self._new[doc] = (doc, self._new[doc][1] if path is None else path, text)
        else:
            old = self._live("texts", STORED_TEXTS, "id").where(F.col("id") == doc).select("path").first()
            if old is None:
                raise StoreError(f"no such document: {doc}")
            self._new[doc] = (doc, old["path"] if path is None else path, text)
            self._dead.add(doc)
        self._kept = {}

    def reindex_table(self, new: DataFrame, prune: bool = False) -> dict[str, int]:
        """Bring documents to the state of (path, text): only added and changed ones are written and parsed.

        Rows with an empty or null path, here or there, have no counterpart: here
        they stay, there they are passed over.
        """
        new = new.where("path <> ''")
        old = self._stored_texts().where("path <> ''").select("path", "id", "hash")
        diff, _ = written(_diff(old, new.select("path", content_hash().alias("hash"))), "diff")
        twice = diff.groupBy("path").count().where("count > 1").first()
        if twice is not None:
            raise StoreError(f"{twice['path']} stands for several documents")
        report = {"added": 0, "updated": 0, "unchanged": 0, "missing": 0} | {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}
        report["pruned"] = report["missing"] if prune else 0
        if report["added"] or report["updated"] or report["pruned"]:
            updated = new.join(diff.where("status = 'updated'").select("path", "id"), "path").select("id", "path", "text")
            added, _ = sources.with_ids(new.join(diff.where("status = 'added'").select("path"), "path", "left_semi"), self._next_id)
            gone = diff.where(F.col("status").isin("updated", *(["missing"] if prune else []))).select("id")
            self._add_part(updated.unionByName(added), gone)
            self._next_id += report["added"]
        return report

    def _files(self, paths: list[str], recursive: bool) -> tuple[DataFrame, list[str]]:
        """(path, text) of the readable Markdown files, and the paths that are not there or no UTF-8."""
        found, missing = sources.markdown_files(self.spark, paths, recursive)
        found, _ = written(found.withColumn("ok", F.is_valid_utf8("text")), "files")
        bad = [r["path"] for r in found.where("not ok").select("path").collect()]
        return found.where("ok").select("path", "text"), missing + bad

    def reindex_paths(self, paths: list[str], recursive: bool = True, prune: bool = False) -> dict:
        """``reindex_table`` of files; ``failed`` counts and ``failed_paths`` names those that could not be read, whose documents stay."""
        found, failed = self._files(paths, recursive)
        if failed and prune:
            stay = self._stored_texts().where(F.col("path").isin([*failed, *map(os.path.abspath, failed)])).select("path", "text")
            found = found.unionByName(stay)
        report = self.reindex_table(found, prune)
        return report | {"failed": len(failed), "failed_paths": failed}

    # -- tables

    def texts(self) -> DataFrame:
        return self._kept.get("texts") or self._stored_texts().select("id", "path", "text")

    def blocks(self) -> DataFrame:
        if "blocks" in self._kept:
            return self._kept["blocks"]
        self._parse()
        return self._live("blocks", STORED_BLOCKS, "document_id").drop("seq")

    def zone_maps(self) -> DataFrame:
        self._parse()
        schema = T.StructType([*zonemaps.SCHEMA.fields, T.StructField("seq", T.LongType())])
        return self._live("zones", schema, "document_id").drop("seq")

    def documents(self) -> DataFrame:
        zones = self.zone_maps().select("document_id", "title", F.to_json("tags").alias("tags"))
        d = self._stored_texts().select("id", "path").join(zones, F.col("id") == F.col("document_id"), "left")
        return d.select("id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("tags", F.lit("[]")).alias("tags"))

    def stats(self) -> DataFrame:
        return zonemaps.block_statistics(self.blocks())

    def totals(self) -> DataFrame:
        """documents, blocks: one row."""
        return self._stored_texts().agg(F.count(F.lit(1)).alias("documents")).crossJoin(self.blocks().agg(F.count(F.lit(1)).alias("blocks")))

    def query(self) -> Query:
        return Query(self.blocks(), self.zone_maps())

    def register_table(self, name: str, df: DataFrame) -> None:
        if name.lower() in ("blocks", "documents"):
            raise StoreError(f"{name} is a built-in table")
        if name.lower() in self.views:
            raise StoreError(f"{name} is a view")
        self.tables[name.lower()] = df

    def unregister_table(self, name: str) -> bool:
        return self.tables.pop(name.lower(), None) is not None

    def attach(self, alias: str, store: DocumentStore | str) -> None:
        alias = alias.lower()
        if alias in ("main", "blocks", "documents"):
            raise StoreError(f"{alias} is reserved")
        if alias in self.attached:
            raise StoreError(f"{alias} is attached already")
        self.attached[alias] = store if isinstance(store, DocumentStore) else DocumentStore.open(self.spark, store)

    def detach(self, alias: str) -> None:
        if self.attached.pop(alias.lower(), None) is None:
            raise StoreError(f"{alias} is not attached")

    def sql(self, text: str, allow_write_back: bool = False) -> DataFrame:
        from ..plans.sqlfront import execute

        return execute(self, text, allow_write_back)

    # -- persistence

    def save(self, path: str | None = None) -> None:
        """Write the parts and tables that ``path`` lacks, then add a line to its catalog; readers see the old or the new state."""
        path = path or self.location
        if not path:
            raise StoreError("no location to save to")
        self._parse()
        for part in self._parts:
            for kind in ("texts", "blocks", "zones", "dead"):
                at = getattr(part, kind)
                if at and not at.startswith(f"{path}/parts/"):
                    to = f"{path}/parts/{part.seq}-{uuid.uuid4().hex}/{kind}"
                    self.spark.read.parquet(at).write.parquet(to)
                    setattr(part, kind, to)
        for name, df in self.tables.items():
            held, at = self._table_paths.get(name, (None, ""))
            if held is not df or not at.startswith(f"{path}/tables/"):
                at = f"{path}/tables/{name}-{uuid.uuid4().hex}"
                df.write.parquet(at)
                self.tables[name] = self.spark.read.schema(df.schema).parquet(at)
                self._table_paths[name] = (self.tables[name], at)
        meta = {
            "schema_version": VERSION,
            "parts": [{k: v[len(path) + 1 :] if isinstance(v, str) else v for k, v in vars(p).items()} for p in self._parts],
            "next": [self._next_id, self._next_block, self._next_seq],
            "tables": {n: self._table_paths[n][1][len(path) + 1 :] for n in sorted(self.tables)},
            "views": self.views,
            "spans": self.spans,
        }
        self.spark.createDataFrame([(time.time_ns(), json.dumps(meta))], "at long, meta string").coalesce(1).write.mode("append").json(f"{path}/catalog")
        self.location = path

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        """Whether a store was saved there.  An error of the file system is an error, not an absence."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/catalog")
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    @staticmethod
    def _meta(spark: SparkSession, path: str) -> dict:
        row = spark.read.schema("at long, meta string").json(f"{path}/catalog").orderBy(F.col("at").desc()).first()
        if row is None:
            raise StoreError(f"{path} has no catalog")
        meta = json.loads(row["meta"])
        if meta["schema_version"] > VERSION:
            raise StoreError(f"{path} was written by a newer version")
        return meta

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DocumentStore:
        meta = cls._meta(spark, path)
        store = cls(spark, meta["spans"], path)
        store.views = dict(meta["views"])
        if meta["schema_version"] == 1:  # one folder a version, texts and blocks whole
            at = f"{path}/{meta['current']}"
            store._add_part(store.spark.read.schema("id int, path string, text string").parquet(f"{at}/texts"), None)
            store._next_id = meta["next_id"]
            tables = {n: f"{at}/tables/{n}" for n in meta["tables"]}
        else:
            store._parts = [Part(**{k: f"{path}/{v}" if isinstance(v, str) else v for k, v in p.items()}) for p in meta["parts"]]
            store._next_id, store._next_block, store._next_seq = meta["next"]
            tables = {n: f"{path}/{p}" for n, p in meta["tables"].items()}
        store.tables = {n: store.spark.read.parquet(p) for n, p in tables.items()}
        store._table_paths = {n: (store.tables[n], p) for n, p in tables.items()}
        return store

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DocumentStore:
        """``open`` with the tables kept in memory until the next change."""
        store = cls.open(spark, path)
        store._kept = {"texts": store.texts().persist(), "blocks": store.blocks().persist()}
        return store

    @classmethod
    def file_version(cls, spark: SparkSession, path: str) -> int:
        return cls._meta(spark, path)["schema_version"]

    @classmethod
    def migrate(cls, spark: SparkSession, path: str) -> tuple[int, int]:
        """Write the store anew if it is of an older version; (version before, after)."""
        before = cls.file_version(spark, path)
        if before < VERSION:
            cls.open(spark, path).save(path)
        return before, VERSION

    @classmethod
    def catalog(cls, spark: SparkSession, path: str) -> DataFrame:
        """The zone maps alone."""
        return cls.open(spark, path).zone_maps()

    def vacuum(self) -> dict[str, int]:
        """Merge the parts of a saved store into one without dead rows and delete what is no longer used; files and bytes before and after."""
        if not self.location:
            raise StoreError("only a saved store can be vacuumed")
        self.save()
        fs, root = self._fs()
        before = self._usage(fs, root)
        seq = F.lit(self._next_seq).cast("long").alias("seq")
        texts = self._live("texts", STORED_TEXTS, "id").select("id", "path", "text", "hash", seq)
        blocks = self._live("blocks", STORED_BLOCKS, "document_id").withColumn("seq", seq)
        zones = self.zone_maps().withColumn("seq", seq)
        few = lambda df: df.coalesce(max(1, df.rdd.getNumPartitions() // 4))
        part, folder = Part(self._next_seq), f"{self.location}/parts/{self._next_seq}-{uuid.uuid4().hex}"
        for kind, df in (("texts", texts), ("blocks", blocks.sortWithinPartitions("document_id", "pre")), ("zones", zones)):
            few(df).write.parquet(f"{folder}/{kind}")
            setattr(part, kind, f"{folder}/{kind}")
        self._parts, self._next_seq, self._kept = [part], self._next_seq + 1, {}
        self.save()
        used = {v.split("/")[-2] for p in self._parts for v in vars(p).values() if isinstance(v, str)}
        for folder in ("parts", "tables"):
            used_here = used if folder == "parts" else {at.split("/")[-1] for _, at in self._table_paths.values()}
            at = self._path(f"{self.location}/{folder}")
            for s in fs.listStatus(at) if fs.exists(at) else []:
                if s.getPath().getName() not in used_here:
                    fs.delete(s.getPath(), True)
        for s in fs.listStatus(root):
            if s.getPath().getName().startswith("v"):  # folders of version 1
                fs.delete(s.getPath(), True)
        after = self._usage(fs, root)
        return {"files_before": before[0], "files_after": after[0], "bytes_before": before[1], "bytes_after": after[1]}

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self):
        root = self._path(self.location)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    @staticmethod
    def _usage(fs, root) -> tuple[int, int]:
        s = fs.getContentSummary(root)
        return s.getFileCount(), s.getLength()


TABLE_TYPES = {"text": T.StringType(), "varchar": T.StringType(), "string": T.StringType(), "char": T.StringType(), "int": T.LongType(), "integer": T.LongType(), "bigint": T.LongType(), "float": T.DoubleType(), "real": T.DoubleType(), "double": T.DoubleType(), "numeric": T.DoubleType(), "boolean": T.BooleanType(), "bool": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}
