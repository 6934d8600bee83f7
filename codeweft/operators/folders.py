"""Folder rollups: trees, edges between folders, status and documents by nearest ancestor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions import ids
from codeweft.session import staged

# States of a folder from best to worst.
STATES = ["current", "outdated", "never"]


def is_workspace_file(c: Column | str) -> Column:
    c = ids.col(c)
    return ~ids.is_external(c) | c.rlike(r"(?s)^.+\..*$")


def folder_edges(imports: DataFrame, calls: DataFrame, entities: DataFrame) -> DataFrame:
    """(from, to, kind, weight): edges between different folders. Call ends are placed by their entity's file, or by their id."""
    home = entities.groupBy("id").agg(F.max("fileId").alias("f"))
    place = lambda e, c: e.join(home.select(F.col("id").alias(c), F.col("f").alias(f"{c}_f")), c, "left").withColumn(c, F.coalesce(f"{c}_f", ids.file_part(c))).drop(f"{c}_f")
    placed = place(place(calls.select("source", "target"), "source"), "target")
    rows = imports.select("source", "target", F.lit("import").alias("kind")).unionByName(placed.select("source", "target", F.lit("call").alias("kind")))
    ok = is_workspace_file("source") & is_workspace_file("target")
    f = rows.where(ok).select(ids.folder("source").alias("from"), ids.folder("target").alias("to"), "kind")
    return f.where(F.col("from") != F.col("to")).groupBy("from", "to", "kind").agg(F.count(F.lit(1)).alias("weight"))


def weight_p90(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.percentile("weight", F.lit(0.9)), F.lit(0.0)).alias("weightP90"))


def folder_tree(files: DataFrame, documented: DataFrame) -> DataFrame:
    """(path, parent, name, depth, fileCount, totalLOC, documented): every folder with what lies below it; '' is the root, '.' holds root files."""
    f = files.where(is_workspace_file("id")).select("id", F.coalesce("loc", F.lit(0)).alias("loc"))
    above = F.when(F.instr("id", "/") > 0, ids.ancestors("id")).otherwise(F.array(F.lit(".")))
    rows = f.select(F.explode(F.concat(F.array(F.lit("")), above)).alias("path"), "loc")
    n = rows.groupBy("path").agg(F.count(F.lit(1)).alias("fileCount"), F.sum("loc").alias("totalLOC"))
    d = documented.select("path").distinct().withColumn("documented", F.lit(True))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    parent = F.when(F.col("path") == "", F.lit(None).cast("string")).when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    return n.join(d, "path", "left").select("path", parent.alias("parent"), F.substring_index("path", "/", -1).alias("name"), depth.alias("depth"), "fileCount", "totalLOC", F.coalesce("documented", F.lit(False)).alias("documented"))


def worst(c: Column) -> Column:
    return F.when(c == 2, "never").when(c == 1, "outdated").otherwise("current")


def folder_status(files: DataFrame, done: DataFrame, stamp: float) -> DataFrame:
    """(folder, fileCount, withEdges, status): never without any edge, outdated if only some files have edges or one is newer than the stamp.

    files: path, mtimeMs. done: path of files with edges.
    """
    d = done.select("path").distinct().withColumn("has", F.lit(1))
    g = files.join(d, "path", "left").groupBy(ids.folder("path").alias("folder")).agg(F.count(F.lit(1)).alias("fileCount"), F.count("has").alias("withEdges"), F.max("mtimeMs").alias("last"))
    s = F.when((F.col("withEdges") == F.col("fileCount")) & (F.col("last") <= stamp), "current").when(F.col("withEdges") > 0, "outdated").otherwise("never")
    return g.select("folder", "fileCount", "withEdges", s.alias("status"))


def bubbled_status(status: DataFrame, root: str = ".") -> DataFrame:
    """(folder, status): the worst of a folder and everything below it, over folders that exist; the root is above all."""
    rank = F.when(F.col("status") == "never", 2).when(F.col("status") == "outdated", 1).otherwise(0)
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    own = F.when(F.col("folder") == root, F.array("folder")).otherwise(F.concat(up, F.array(F.lit(root))))
    rows = status.select(F.explode(own).alias("folder"), rank.alias("r")).groupBy("folder").agg(F.max("r").alias("r"))
    return rows.join(status.select("folder"), "folder", "left_semi").select("folder", worst(F.col("r")).alias("status"))


def nearest_document(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """(folder, document): the document of the nearest folder at or above that has one. documents: path (folder), document."""
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = folders.select("folder", F.posexplode(up).alias("depth", "path")).join(documents, "path")
    return rows.groupBy("folder").agg(F.max_by("document", F.struct("depth", "document")).alias("document"))


def visible_edges(edges: DataFrame, show_all: bool = False) -> DataFrame:
    """(id, from, to, kind, weight, width): edges from the ninth decile of weight on, with their drawing width."""
    rows = edges.crossJoin(F.broadcast(weight_p90(edges)))  # one row
    width = F.least(1 + F.log2(F.col("weight") + 1), F.lit(6.0))
    kept = rows if show_all else rows.where(F.col("weight") >= F.col("weightP90"))
    return kept.select(F.concat_ws("|", "kind", "from", "to").alias("id"), "from", "to", "kind", "weight", width.alias("width"))


def inherited_status(folders_: DataFrame, status: DataFrame) -> DataFrame:
    """(folder, status): each folder's own status or that of its nearest ancestor with one; never if none has."""
    return folders_.select("folder").join(nearest_document(folders_, status.select(F.col("folder").alias("path"), F.col("status").alias("document"))), "folder", "left").select("folder", F.coalesce("document", F.lit("never")).alias("status"))


def layout(tree: DataFrame) -> DataFrame:
    """(path, depth, y): leaves one below the other in the order of their paths, a parent midway between its first and last child.

    tree: path, parent, depth; one pass a level, from the deepest up. Leaves are ranked by a range sort, not in one task.
    """
    leaves = tree.join(tree.select(F.col("parent").alias("path")).distinct(), "path", "left_anti")
    rank = leaves.select("path").rdd.map(lambda r: r[0]).sortBy(lambda x: x).zipWithIndex()
    placed = staged(tree.sparkSession.createDataFrame(rank, "path string, y long").select("path", F.col("y").cast("double").alias("y")).join(tree.select("path", "parent", "depth"), "path"))
    top = tree.agg(F.max("depth")).first()[0] or 0
    for depth in range(top, 0, -1):
        kids = placed.where(F.col("depth") == depth).groupBy(F.col("parent").alias("path")).agg(((F.min("y") + F.max("y")) / 2).alias("y"))
        placed = staged(placed.unionByName(kids.join(tree.select("path", "parent", "depth"), "path").join(placed.select("path"), "path", "left_anti")))
    return placed.select("path", "depth", "y")
