"""From artifacts to nodes and edges: import targets, calls by import or name, and class members by line range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import ids
from codeweft.operators.manifest import capability

INDEX_CANDIDATES = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def parent(c: Column) -> Column:
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit("."))


def squeezed(c: Column) -> Column:
    """A path without ./ parts and doubled slashes."""
    out = F.regexp_replace(F.regexp_replace(c, "/+", "/"), r"(^|/)(\./)+", "$1")
    return F.regexp_replace(out, r"^\./", "")


def import_target(file_id: Column | str, source: Column | str, resolved: Column | str | None = None) -> Column:
    """Where an import of a file points.

    A resolved path wins. A relative source climbs one folder for every leading dot but the first, its inner dots become
    slashes, and the file's own extension is added without asking whether the file exists. An absolute dotted source starts
    at the first folder of the file's path that has its first segment's name; without one it is the external module of that
    name. Sources in node_modules point nowhere.
    """
    f, s = ids.col(file_id), ids.col(source)
    ext = F.regexp_extract(f, r"(?s)^.*[^/](\.[^./]*)$", 1)
    ext = F.when(ext == "", ".ts").otherwise(ext)
    dots = F.length(F.regexp_extract(s, r"^(\.+)", 1))
    module = F.regexp_replace(s, r"^\.+", "")
    dirs = F.split(parent(f), "/")
    kept = F.greatest(F.size(dirs) - (dots - 1), F.lit(0))
    base = F.when(parent(f) == ".", F.lit(".")).when(kept == 0, F.lit(".")).otherwise(F.array_join(F.slice(dirs, F.lit(1), F.greatest(kept, F.lit(1))), "/"))
    inner = F.translate(module, ".", "/")
    relative = F.concat(squeezed(F.when(module == "", base).otherwise(F.concat(base, F.lit("/"), inner))), ext)
    segments = F.split(f, "/")
    folders = F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
    top = F.substring_index(s, ".", 1)
    at = F.array_position(folders, top)
    absolute = F.when(at > 0, F.concat(F.array_join(F.concat(F.slice(segments, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), F.split(s, r"\.")), "/"), ext)).otherwise(top)
    out = F.when(s.startswith("."), relative).when(~F.contains(s, F.lit("node_modules")), absolute)
    return F.coalesce(ids.normalised(resolved), out) if resolved is not None else out


def resolve_module(stems: DataFrame, files: DataFrame) -> DataFrame:
    """(stem, path): each extensionless path's file, by the first of the candidate endings that exists; unresolved stems are left out."""
    ways = F.posexplode(F.array(*map(F.lit, INDEX_CANDIDATES)))
    rows = stems.select("stem").distinct().select("stem", ways.alias("rank", "end")).withColumn("path", F.concat("stem", "end"))
    return rows.join(files.select("path").distinct(), "path").groupBy("stem").agg(F.min_by("path", "rank").alias("path"))


def entity_nodes(arts: DataFrame, *keep: str) -> DataFrame:
    """(id, name, kind, fileId, callGraph, *keep): a file node per artifact and a node per entity; unusual kinds count as functions."""
    f = arts.select(F.col("path").alias("id"), ids.basename("path").alias("name"), F.lit("file").alias("kind"), F.col("path").alias("fileId"), capability("path").alias("callGraph"), *keep)
    e = arts.select("path", *keep, F.inline("entities"))
    kind = F.when(F.col("kind").isin("class", "method", "arrow", "const"), F.col("kind")).otherwise("function")
    return f.unionByName(e.select(ids.entity_id("path", "name").alias("id"), "name", kind.alias("kind"), F.col("path").alias("fileId"), capability("path").alias("callGraph"), *keep))


def import_edges_of(arts: DataFrame, internal_only: bool = True) -> DataFrame:
    """(source, target, kind, typeOnly, ord); external modules are left out with internal_only."""
    i = arts.select("path", F.posexplode("imports").alias("ord", "i")).select(F.col("path").alias("source"), import_target("path", "i.source").alias("target"), F.col("i.typeOnly").alias("typeOnly"), "ord")
    out = i.where(F.col("target").isNotNull() & ~F.col("target").contains("node_modules"))
    return (out.where(~ids.is_external("target")) if internal_only else out).withColumn("kind", F.lit("import"))


def call_edges_of(arts: DataFrame, *keep: str) -> DataFrame:
    """(source, target, kind, *keep): a call goes to the first import that brings in its name, in import and specifier order, else to the file's own entity of that name.

    Where a path has several texts, a call sees only the imports of its own text.
    """
    calls = arts.select("path", "textHash", F.inline("entities")).select("path", "textHash", ids.entity_id("path", "name").alias("source"), F.explode("calls").alias("c")).select("path", "textHash", "source", F.substring_index("c.name", ".", 1).alias("callee"))
    specs = arts.select("path", "textHash", F.posexplode("imports").alias("i", "imp")).select("path", "textHash", "i", F.col("imp.source").alias("from"), F.posexplode("imp.names").alias("j", "n"))
    specs = specs.select("path", "textHash", F.coalesce("n.alias", "n.name").alias("callee"), F.col("n.name").alias("name"), import_target("path", "from").alias("file"), "i", "j").where(F.col("file").isNotNull())
    first = specs.groupBy("path", "textHash", "callee").agg(F.min_by(F.struct("file", "name"), F.struct("i", "j")).alias("hit"))
    target = F.when(F.col("hit").isNotNull(), ids.entity_id("hit.file", "hit.name")).otherwise(ids.entity_id("path", "callee"))
    return calls.join(first, ["path", "textHash", "callee"], "left").select("source", target.alias("target"), F.lit("call").alias("kind"), *keep)


def class_members(entities: DataFrame) -> DataFrame:
    """(fileId, class, member): function-like entities within a class's line range. entities: fileId, id, kind, startLine, endLine."""
    c = entities.where(F.col("kind") == "class").select("fileId", F.col("id").alias("class"), F.col("startLine").alias("a"), F.col("endLine").alias("b"))
    m = entities.where(F.col("kind").isin("function", "method", "arrow")).select("fileId", F.col("id").alias("member"), "startLine", "endLine")
    return c.join(m, "fileId").where((F.col("startLine") >= F.col("a")) & (F.col("endLine") <= F.col("b")) & (F.col("class") != F.col("member"))).select("fileId", "class", "member")


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(fileId, offset, name): each point's smallest enclosing span, the later one on ties; null outside all. spans: fileId, name, start, end."""
    inside = points.join(spans, "fileId").where((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end")))
    w = Window.partitionBy("fileId", "offset").orderBy(F.col("end") - F.col("start"), F.desc("start"), "name")
    best = inside.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("fileId", "offset", "name")
    return points.select("fileId", "offset").distinct().join(best, ["fileId", "offset"], "left")
