"""Assembly of the import and call graph from the store, with referential filtering and repair, and edge filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions import ids

# Method and constructor names of the languages' own libraries, left out of call listings.
STDLIB = [
    "push", "pop", "shift", "unshift", "splice", "slice", "concat",
    "map", "filter", "reduce", "forEach", "find", "findIndex", "some", "every",
    "includes", "indexOf", "join", "split", "trim", "replace", "match",
    "toString", "valueOf", "hasOwnProperty",
    "get", "set", "has", "delete", "clear", "add", "keys", "values", "entries",
    "next", "done", "then", "catch", "finally",
    "log", "error", "warn", "info", "debug",
    "Map", "Set", "Promise", "Error", "JSON", "Object", "Array",
]

_INIT = r"(\.(?:tsx|ts|jsx|js|py|cpp|hpp|cxx|hxx|cc|c|h|rs|r|R))$"


@dataclass
class Graph:
    """nodes: (id, kind) of the import graph, file or external. imports: (source, target, typeOnly). entities, calls: the call graph."""

    nodes: DataFrame
    imports: DataFrame
    entities: DataFrame
    calls: DataFrame

    @property
    def files(self) -> DataFrame:
        return self.nodes.where(F.col("kind") == "file").select("id")

    @property
    def file_imports(self) -> DataFrame:
        """Import edges between two files, duplicates kept."""
        return self.imports.where(~ids.is_external("source") & ~ids.is_external("target"))


def import_edges(nodes: DataFrame, edges: DataFrame, watched: DataFrame | None = None) -> DataFrame:
    """Import edges whose ends exist; external modules pass. A missing target falls back to its package's init file."""
    files = nodes.where(F.col("fileId").isNotNull()).select(F.col("fileId").alias("id")).distinct()
    if watched is not None:
        files = files.join(watched.select(F.col("path").alias("id")), "id", "left_semi")
    f = lambda name: files.select(F.col("id").alias(name), F.lit(True).alias(f"has_{name}"))
    e = edges.where(F.col("kind") == "import").withColumn("init", F.regexp_replace("target", _INIT, "/__init__$1"))
    e = e.join(f("source"), "source", "left").join(f("target"), "target", "left").join(f("init"), "init", "left")
    there = F.coalesce("has_target", F.lit(False)) | ids.is_external("target")
    target = F.when(there, F.col("target")).when(F.col("has_init"), F.col("init"))
    source_ok = F.coalesce("has_source", F.lit(False)) | (ids.is_external("source") if watched is None else F.lit(False))
    return e.where(source_ok).select("source", target.alias("target"), "typeOnly", "ord").where(F.col("target").isNotNull())


def call_nodes(nodes: DataFrame, watched: DataFrame | None = None) -> DataFrame:
    n = nodes.where((F.col("kind") != "file") & (F.coalesce("callGraph", F.lit("none")) != "none"))
    if watched is not None:
        outside = F.col("fileId").eqNullSafe(F.col("id")) | ids.is_external("fileId")
        n = n.join(watched.select(F.col("path").alias("fileId"), F.lit(True).alias("__w")), "fileId", "left").where(F.col("__w") | outside).drop("__w")
    return n.select("id", "name", "kind", "fileId", "callGraph")


def call_edges(entities: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.where(F.col("kind") == "call").select("source", "target")
    return e.join(entities.select(F.col("id").alias("source")), "source", "left_semi").join(entities.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target")


def build(nodes: DataFrame, edges: DataFrame, watched: DataFrame | None = None) -> Graph:
    imports = import_edges(nodes, edges, watched)
    own = nodes.where(F.col("fileId").isNotNull()).select(F.col("fileId").alias("id"))
    if watched is not None:
        own = own.join(watched.select(F.col("path").alias("id")), "id", "left_semi")
    ends = imports.select(F.explode(F.array("source", "target")).alias("id"))
    everyone = own.unionByName(ends).distinct().select("id", F.when(ids.is_external("id"), "external").otherwise("file").alias("kind"))
    entities = call_nodes(nodes, watched)
    return Graph(everyone, imports, entities, call_edges(entities, edges))


def without_barrels(edges: DataFrame) -> DataFrame:
    """Edges that touch no file that only re-exports; such edges are no architecture."""
    return edges.where(~ids.is_barrel("source") & ~ids.is_barrel("target"))


def without_external_calls(edges: DataFrame) -> DataFrame:
    external = lambda c: ids.is_external(ids.file_part(c))
    return edges.where(~external("source") & ~external("target"))


def successors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, next): sorted distinct targets of every node."""
    out = edges.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("target")).alias("next"))
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("next", F.array().cast("array<string>")).alias("next"))


def reverse_index(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """(target, caller, callerName, callerFile): each entity's distinct callers."""
    who = entities.select(F.col("id").alias("source"), F.col("name").alias("callerName"), F.col("fileId").alias("callerFile"))
    return calls.join(who, "source").select("target", F.col("source").alias("caller"), "callerName", "callerFile").distinct()


def edges_from_file(edges: DataFrame, file_id: str) -> DataFrame:
    return edges.where(F.when(F.col("kind") == "import", F.col("source") == file_id).otherwise(F.col("source").startswith(file_id + ids.SEP)))


def edges_for_module(edges: DataFrame, folder: str, recursive: bool = False) -> DataFrame:
    """Edges with a side inside the folder; without recursive, only files directly in it count."""
    prefix = folder.rstrip("/") + "/"

    def inside(c: str):
        f = F.when(F.col("kind") == "call", ids.file_part(c)).otherwise(F.col(c))
        return f.startswith(prefix) & (F.lit(True) if recursive else F.instr(F.substring(f, len(prefix) + 1, 1_000_000), "/") == 0)

    return edges.where(inside("source") | inside("target"))


def no_stdlib_calls(calls: DataFrame) -> DataFrame:
    return calls.where(~F.coalesce(ids.name_part("target"), F.col("target")).isin(STDLIB))


def folder_calls(calls: DataFrame, folder: str) -> DataFrame:
    """(source, target, side): distinct calls with a side in the folder: internal, outgoing or incoming."""
    inside = lambda c: ids.under(ids.file_part(c), folder)
    side = F.when(inside("source") & inside("target"), "internal").when(inside("source"), "outgoing").when(inside("target"), "incoming")
    return no_stdlib_calls(calls).select("source", "target", side.alias("side")).where(F.col("side").isNotNull()).distinct()


def neighbours(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id): nodes one undirected step from the start set, without it."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return both.join(start.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct().join(start.select("id"), "id", "left_anti")


def graph_stats(g: Graph) -> DataFrame:
    """One row: counts of both graphs and of distinct files."""
    imports = g.imports.agg(F.count(F.lit(1)).alias("importEdges"))
    nodes = g.nodes.agg(F.count(F.lit(1)).alias("importNodes"), F.count(F.when(F.col("kind") == "file", 1)).alias("fileCount"))
    calls = g.calls.agg(F.count(F.lit(1)).alias("callEdges"))
    return nodes.crossJoin(imports).crossJoin(g.entities.agg(F.count(F.lit(1)).alias("callNodes"))).crossJoin(calls)
