"""The edge-list store as tables: upserts, first-write edges, removals, watch sets and versioned snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.functions import ids

SCHEMA_VERSION, RESOLVER_VERSION = 4, "ts-resolveModuleName-v1"

NODE = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("fileId", T.StringType()), T.StructField("callGraph", T.StringType())])
EDGE = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("typeOnly", T.BooleanType())])


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: the last written wins and keeps the place (pos) of the first. Null ids are left out."""
    values = [c for c in nodes.columns if c not in ("id", "ord")]
    best = nodes.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*values), "ord").alias("v"), F.min("ord").alias("pos"))
    return best.select("id", *(F.col(f"v.{c}").alias(c) for c in values), "pos")


def first_edges(edges: DataFrame, kind: str) -> DataFrame:
    """Edges of one kind, one per (source, target): the first written sticks, with its typeOnly."""
    rows = edges.where((F.col("kind") == kind) & F.col("source").isNotNull() & F.col("target").isNotNull())
    best = rows.groupBy("source", "target").agg(F.min_by(F.struct("typeOnly", "ord"), "ord").alias("v"))
    return best.select("source", "target", F.lit(kind).alias("kind"), F.coalesce("v.typeOnly", F.lit(False)).alias("typeOnly"), F.col("v.ord").alias("ord"))


def nodes_of_file(nodes: DataFrame, file_id: str) -> DataFrame:
    return nodes.where(F.col("fileId") == file_id)


def nodes_under(nodes: DataFrame, folder: str) -> DataFrame:
    return nodes.where(ids.under("fileId", folder))


def without_file_nodes(nodes: DataFrame, file_id: str) -> DataFrame:
    return nodes.where(~F.col("fileId").eqNullSafe(file_id))


def remove_folder(nodes: DataFrame, edges: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Drops the folder's nodes, and edges by their source only: edges into the folder stay."""
    source = F.col("source")
    inside = (source == folder) | source.startswith(folder + "/") | source.startswith(folder + ids.SEP)
    return nodes.where(~F.coalesce(ids.under("fileId", folder), F.lit(False))), edges.where(~inside)


def remove_file(nodes: DataFrame, edges: DataFrame, file_id: str) -> tuple[DataFrame, DataFrame]:
    """Drops the file's nodes, and edges on either side of it."""
    return without_file_nodes(nodes, file_id), edges.where((ids.file_part("source") != file_id) & (ids.file_part("target") != file_id))


def replace_files(nodes: DataFrame, edges: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store after files (column path) changed or went: their nodes and edges on either side are purged, then the new ones written."""
    keep_n = nodes.join(changed.select(F.col("path").alias("fileId")), "fileId", "left_anti").select(nodes.columns)
    e = edges.withColumn("__s", ids.file_part("source")).withColumn("__t", ids.file_part("target"))
    keep_e = e.join(changed.select(F.col("path").alias("__s")), "__s", "left_anti").join(changed.select(F.col("path").alias("__t")), "__t", "left_anti").select(edges.columns)
    n = keep_n.withColumn("__new", F.lit(0)).unionByName(new_nodes.withColumn("__new", F.lit(1)))
    last = n.groupBy("id").agg(F.max_by(F.struct(*nodes.columns), "__new").alias("v")).select("v.*")
    m = keep_e.withColumn("__new", F.lit(0)).unionByName(new_edges.withColumn("__new", F.lit(1)))
    first = m.groupBy("source", "target").agg(F.min_by(F.struct(*edges.columns), "__new").alias("v")).select("v.*")
    return last, first


def changed_hashes(saved: DataFrame, current: DataFrame) -> DataFrame:
    """(path, hash) of current files whose hash differs from the saved one or that are not saved; missing files are skipped."""
    return current.alias("c").join(saved.select("path", F.col("hash").alias("old")), "path", "left").where(~F.col("hash").eqNullSafe(F.col("old"))).select("path", "hash")


def watch_add(watched: DataFrame, files: DataFrame) -> DataFrame:
    return watched.select("path").unionByName(files.select("path")).distinct()


def watch_remove_folder(watched: DataFrame, folder: str) -> DataFrame:
    return watched.where(~ids.under("path", folder))


def folders_with_watched(watched: DataFrame) -> DataFrame:
    """(folder, files): every folder with a watched descendant."""
    return watched.select(F.explode(ids.ancestors("path")).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


def migrate_watch(entries: DataFrame, files: DataFrame, hashes: DataFrame) -> DataFrame:
    """(path, hash): a watch list of files and folders spelled out as files, each with the hash it was saved with, if any."""
    inside = files.select("path", F.explode(F.concat(ids.ancestors("path"), F.array("path"))).alias("entry"))
    hit = inside.join(entries.select(F.col("path").alias("entry")), "entry", "left_semi").select("path").distinct()
    return hit.join(hashes.select("path", "hash"), "path", "left")


def store_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("fileId").alias("fileCount"))
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class TableStore:
    """Versioned parquet tables under one path, for any number of writers.

    A write is a new folder; it counts once the file with the next version's number names it. That file is created only if it is not
    there yet, so of two writers with one base the second one fails, and a transaction starts again from what the first one wrote.
    Where nothing was written, or a version's tables can't be read and `tolerant` is set, the tables are empty.
    """

    TABLES: dict[str, T.StructType] = {}

    def __init__(self, spark: SparkSession, path: str, tolerant: bool = False) -> None:
        self.spark, self.path, self.tolerant = spark, path.rstrip("/"), tolerant

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(conf)

    def versions(self) -> list[str]:
        """Committed versions, oldest first."""
        jvm, fs = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(root):
            return []
        return sorted(s.getPath().getName()[:-5] for s in fs.listStatus(root) if s.getPath().getName().endswith(".done"))

    def _read(self, version: str | None) -> tuple[DataFrame, ...]:
        if version is None:
            return tuple(self.spark.createDataFrame([], schema) for schema in self.TABLES.values())
        try:
            folder = self.spark.read.text(f"{self.path}/{version}.done").first()[0]
            out = tuple(self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/{name}") for name, schema in self.TABLES.items())
            if self.tolerant:
                for df in out:
                    df.foreach(lambda _: None)
            return out
        except Exception:
            if not self.tolerant:
                raise
            return self._read(None)

    def load(self) -> tuple[DataFrame, ...]:
        """The tables of the current version."""
        return self._read(next(iter(self.versions()[-1:]), None))

    def save(self, *tables: DataFrame, base: str | None = None) -> str:
        """Writes a new version on top of base, by default the current one; fails with Conflict if another writer was faster."""
        at = self.versions()[-1:] if base is None else [base] * bool(base)
        version = f"{int(at[0]) + 1 if at else 0:08d}"
        folder = f"{version}-{uuid.uuid4().hex[:12]}"
        for (name, schema), df in zip(self.TABLES.items(), tables, strict=True):
            df.select(*(F.col(f.name).cast(f.dataType) for f in schema)).write.parquet(f"{self.path}/{folder}/{name}")
        jvm, fs = self._fs()
        path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}")
        try:
            out = fs.create(path(f"{version}.done"), False)
        except Exception as e:
            fs.delete(path(folder), True)
            if fs.exists(path(f"{version}.done")):
                raise Conflict(version) from e
            raise
        out.write(bytearray(folder.encode()))
        out.close()
        return version

    def transaction(self, change, attempts: int = 20) -> str:
        """load, change(*tables) -> tables, save; again from the start if another writer came first. A failing change leaves the store as it was."""
        for left in range(attempts - 1, -1, -1):
            base = next(iter(self.versions()[-1:]), "")
            out = change(*self._read(base or None))
            try:
                return self.save(*(out if isinstance(out, tuple) else (out,)), base=base)
            except Conflict:
                if not left:
                    raise
        raise AssertionError


class EdgeStore(TableStore):
    TABLES = {"nodes": NODE, "edges": EDGE}


class CloneStore(TableStore):
    TABLES = {"edges": T.StructType([T.StructField(c, T.StringType()) for c in ("source", "target", "kind", "severity", "cloneType")])}


class FolderTreeStore(TableStore):
    TABLES = {"folders": T.StructType([T.StructField("path", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("fileCount", T.LongType()), T.StructField("totalLOC", T.LongType()), T.StructField("documented", T.BooleanType())])}


class FolderEdgeStore(TableStore):
    TABLES = {"edges": T.StructType([T.StructField("from", T.StringType()), T.StructField("to", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("weight", T.LongType())])}


class ManifestStore(TableStore):
    """Files as the last scan saw them."""

    TABLES = {"files": T.StructType([T.StructField("path", T.StringType()), T.StructField("mtimeMs", T.DoubleType()), T.StructField("size", T.LongType()), T.StructField("lines", T.LongType()), T.StructField("status", T.StringType()), T.StructField("hash", T.StringType())])}


class AnalysisCache(TableStore):
    """Hashes of entities by file and content; entries of files that changed or left are put out by the next update."""

    TABLES = {
        "entities": T.StructType(
            [T.StructField(c, T.StringType()) for c in ("fileId", "contentHash", "id", "normalizedHash")] + [T.StructField("tokenCount", T.LongType()), T.StructField("literalHashes", T.ArrayType(T.StringType()))]
        )
    }

    def missing(self, files: DataFrame) -> DataFrame:
        """(path, hash) of the files whose content is not in the cache; a file without entities is there under a null id."""
        have = self.load()[0].select(F.col("fileId").alias("path"), F.col("contentHash").alias("hash")).distinct()
        return files.select("path", "hash").join(have, ["path", "hash"], "left_anti")

    def update(self, files: DataFrame, fresh: DataFrame) -> str:
        """Keeps what still belongs to files (path, hash), and adds fresh entities."""
        now = files.select(F.col("path").alias("fileId"), F.col("hash").alias("contentHash")).distinct()
        names = [f.name for f in self.TABLES["entities"]]
        return self.transaction(lambda old: old.join(now, ["fileId", "contentHash"], "left_semi").select(*names).unionByName(fresh.select(*names)))
