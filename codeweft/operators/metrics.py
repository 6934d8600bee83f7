"""Coupling and interface-width metrics over file graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import ids

HUB_DEGREE, KERNEL_INSTABILITY = 8, 0.3
MIN_FOLDERS, SHALLOW_Q, WIDE_Q, MIN_WIDE, UTILITY_Q, MIN_UTILITY = 8, 0.25, 0.75, 2.0, 0.9, 5


def coupling(file_imports: DataFrame) -> DataFrame:
    """(id, ca, ce): distinct files in and out; a self import counts on both sides."""
    e = file_imports.select("source", "target").distinct()
    ca = e.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("ca"))
    ce = e.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("ce"))
    return ca.join(ce, "id", "full_outer").select("id", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))


def hubs(file_imports: DataFrame) -> DataFrame:
    """Files of degree 8 or more: (id, ca, ce, degree, instability, label), kernels being mostly imported, unstable hubs mostly importing."""
    c = coupling(file_imports).withColumn("degree", F.col("ca") + F.col("ce")).where(F.col("degree") >= HUB_DEGREE)
    i = F.col("ce") / F.col("degree")
    return c.select("id", "ca", "ce", "degree", i.alias("instability"), F.when(i <= KERNEL_INSTABILITY, "kernel").otherwise("unstable-hub").alias("label"))


def max_fan_in(file_imports: DataFrame) -> DataFrame:
    return coupling(file_imports).agg(F.coalesce(F.max("ca"), F.lit(0)).alias("maxFanIn"))


def folder_depth(c: Column | str) -> Column:
    return F.size(F.split(F.col(c) if isinstance(c, str) else c, "/")) - 1


def file_depth(c: Column | str) -> Column:
    return F.greatest(F.lit(0), F.size(F.split(F.col(c) if isinstance(c, str) else c, "/")) - 2)


def entry_points(file_imports: DataFrame, entities: DataFrame, calls: DataFrame) -> DataFrame:
    """(scope, module, entry, inbound): how often each entry point of a module is used from outside it.

    Edges are counted as often as they occur. A folder's outside is what is not below it, so each edge reaches just the
    target's ancestors that are none of the source's.
    """
    e = file_imports.select("source", "target").where(F.col("source") != F.col("target"))
    n = e.groupBy("source", "target").agg(F.count(F.lit(1)).alias("k"))
    file = n.groupBy(F.col("target").alias("module")).agg(F.sum("k").alias("inbound")).select(F.lit("file").alias("scope"), "module", F.col("module").alias("entry"), "inbound")
    above = n.select("source", "target", "k", F.explode(ids.ancestors("target")).alias("module")).where(~F.col("source").startswith(F.concat("module", F.lit("/"))))
    folder = above.groupBy("module", F.col("target").alias("entry")).agg(F.sum("k").alias("inbound")).select(F.lit("folder").alias("scope"), "module", "entry", "inbound")
    home = lambda c: entities.select(F.col("id").alias(c), F.col("fileId").alias(f"{c}_file"))
    crossing = calls.join(home("source"), "source").join(home("target"), "target").where(F.col("source_file") != F.col("target_file"))
    function = crossing.groupBy(F.col("target").alias("module")).agg(F.count(F.lit(1)).alias("inbound")).select(F.lit("function").alias("scope"), "module", F.col("module").alias("entry"), "inbound")
    return file.unionByName(folder).unionByName(function)


def interface_width(files: DataFrame, file_imports: DataFrame, entities: DataFrame, calls: DataFrame) -> DataFrame:
    """(scope, module, treeDepth, w, wEff, moduleDepth, dmr, isBarrel) of all files and folders, and of functions called from other files.

    wEff is the inverse of the squared shares, kept in integers up to the one division.
    """
    doors = entry_points(file_imports, entities, calls).groupBy("scope", "module").agg(F.count(F.lit(1)).alias("w"), F.sum("inbound").alias("s"), F.sum(F.col("inbound") * F.col("inbound")).alias("q"))
    per_file = entities.where(F.col("fileId").isNotNull()).groupBy(F.col("fileId").alias("module")).agg(F.count(F.lit(1)).alias("n"))
    inbound = file_imports.select(F.col("target").alias("module")).distinct().withColumn("used", F.lit(True))
    file = files.select(F.col("id").alias("module")).join(per_file, "module", "left").join(inbound, "module", "left")
    file = file.select(F.lit("file").alias("scope"), "module", file_depth("module").alias("treeDepth"), F.coalesce("n", F.lit(0)).alias("moduleDepth"), (F.col("n").isNull() & F.coalesce("used", F.lit(False))).alias("isBarrel"))
    below = per_file.select(F.explode(ids.ancestors("module")).alias("module"), "n").groupBy("module").agg(F.sum("n").alias("n"))
    folder = files.select(F.explode(ids.ancestors("id")).alias("module")).distinct().join(below, "module", "left")
    folder = folder.select(F.lit("folder").alias("scope"), "module", folder_depth("module").alias("treeDepth"), F.coalesce("n", F.lit(0)).alias("moduleDepth"), F.lit(False).alias("isBarrel"))
    called = doors.where(F.col("scope") == "function").select("module").join(entities.select(F.col("id").alias("module"), "fileId"), "module")
    function = called.select(F.lit("function").alias("scope"), "module", file_depth("fileId").alias("treeDepth"), F.lit(1).cast("long").alias("moduleDepth"), F.lit(False).alias("isBarrel"))
    rows = file.unionByName(folder).unionByName(function).join(doors, ["scope", "module"], "left")
    w_eff = F.when(F.col("w") > 0, F.col("s") * F.col("s") / F.col("q")).otherwise(F.lit(0.0))
    return rows.select("scope", "module", "treeDepth", F.coalesce("w", F.lit(0)).alias("w"), w_eff.alias("wEff"), "moduleDepth", F.when(F.col("w") > 0, F.col("moduleDepth") / (F.col("s") * F.col("s") / F.col("q"))).otherwise(F.lit(0.0)).alias("dmr"), "isBarrel")


def top_entry_points(doors: DataFrame, k: int = 5) -> DataFrame:
    """(scope, module, entry, inbound, place): the k most used entry points of each module."""
    w = Window.partitionBy("scope", "module").orderBy(F.desc("inbound"), "entry")
    return doors.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def calibrated(width: DataFrame) -> DataFrame:
    """width (with its inbound, see with_inbound) with severity and note: folders that are wide and shallow by the graph's own quartiles are medium, much-called functions noted."""
    used = width.where((F.col("scope") == "folder") & (F.col("w") > 0))
    q = used.agg(F.count(F.lit(1)).alias("folders"), F.percentile("wEff", F.lit(WIDE_Q)).alias("wide"), F.percentile("dmr", F.lit(SHALLOW_Q)).alias("shallow"))
    u = width.where(F.col("scope") == "function").agg(F.coalesce(F.percentile("inbound", F.lit(UTILITY_Q)), F.lit(0.0)).alias("busy"))
    rows = width.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(u))  # one row each
    shallow = (F.col("scope") == "folder") & (F.col("w") > 0) & (F.col("folders") >= MIN_FOLDERS) & (F.col("wEff") >= F.greatest("wide", F.lit(MIN_WIDE))) & (F.col("dmr") <= F.col("shallow")) & (F.col("treeDepth") >= 1)
    busy = (F.col("scope") == "function") & (F.col("inbound") >= F.greatest("busy", F.lit(float(MIN_UTILITY))))
    return rows.withColumn("severity", F.when(shallow, "medium").otherwise("low")).withColumn("note", F.when(shallow, "shallow-wide").when(busy, "wide-utility")).drop("folders", "wide", "shallow", "busy")


def with_inbound(width: DataFrame, doors: DataFrame) -> DataFrame:
    total = doors.groupBy("scope", "module").agg(F.sum("inbound").alias("inbound"))
    return width.join(total, ["scope", "module"], "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)))
