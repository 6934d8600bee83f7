"""What changed between consecutive full snapshots of a table.

Every row stands once with +1 in its own snapshot and once with -1 in the next one; the sums over whole rows are EXCEPT ALL
in both directions at once (positive: only in the later snapshot, negative: only in the earlier), and identical rows are
gone. The few residues are full-joined by key and labelled. All of it runs on one shuffle, by group and key; a key with so
many writings that one task would wait for it is reduced before it moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import ids
from codeweft.operators.skew import hot_hashes
from codeweft.session import small


def snapshot_steps(envelopes: DataFrame, group: str, number: str) -> DataFrame:
    """(group, number, next): the snapshots of a group in order, each with the one after it; next is null at the last."""
    w = Window.partitionBy(group).orderBy(number)
    return envelopes.select(group, number).where(F.col(group).isNotNull() & F.col(number).isNotNull()).distinct().select(group, number, F.lead(number).over(w).alias("__next"), F.lag(number).over(w).isNull().alias("__first"))


def snapshot_changes(rows: DataFrame, steps: DataFrame, group: str, number: str, key: list[str], values: list[str], order: Column) -> DataFrame:
    """(group, number, *key, change): keys added, removed or changed from a snapshot to the next.

    rows: the snapshots, one row per record or more. steps: from snapshot_steps; rows of other snapshots are ignored. If a
    key stands several times in a snapshot, the row with the greatest order counts. Rows with a null in group or key are
    ignored; null values equal each other. Further columns of rows play no part, whatever their names. A snapshot in steps without rows is empty, and a group's first gives no changes.
    """
    rows = rows.where(F.col(group).isNotNull()).dropna(subset=key).select(group, number, *key, *values, order.alias("__order"))
    placed = rows.join(small(steps), [group, number])
    by = [group, number, "__next", "__first", *key]
    writings = placed.select(*by, F.struct(*values, F.lit(1).alias("__one")).alias("__v"), "__order")
    hot = hot_hashes(rows, [group, *key])
    if hot:
        is_hot = F.xxhash64(group, *key).isin(hot)
        reduced = writings.where(is_hot).groupBy(*by).agg(F.max_by("__v", "__order").alias("__v"), F.max("__order").alias("__order"))
        writings = writings.where(~is_hot).unionByName(reduced)
    state = writings.repartition(group, *key).groupBy(*by).agg(F.max_by("__v", "__order").alias("__v"))
    sides = F.array_compact(
        F.array(
            F.when(~F.col("__first"), F.struct(F.col(number).alias("__at"), F.lit(1).alias("__side"))),
            F.when(F.col("__next").isNotNull(), F.struct(F.col("__next").alias("__at"), F.lit(-1).alias("__side"))),
        )
    )
    signed = state.select(group, *key, "__v", F.explode(sides).alias("__s")).select(group, F.col("__s.__at").alias(number), *key, "__v", F.col("__s.__side").alias("__side"))
    residue = signed.groupBy(group, number, *key, "__v").agg(F.sum("__side").alias("__side")).where(F.col("__side") != 0)
    on = [group, number, *key]
    # the full join of both sides' residues by key, as one grouping: they already lie together
    joined = residue.groupBy(*on).agg(F.max(F.col("__side") > 0).alias("__l"), F.max(F.col("__side") < 0).alias("__e"))
    change = F.when(~F.col("__e"), "added").when(~F.col("__l"), "removed").otherwise("changed")
    return joined.select(*on, change.alias("change"))


def graph_snapshot_changes(nodes: DataFrame, edges: DataFrame, envelopes: DataFrame, version: int = 4, resolver: str = "ts-resolveModuleName-v1") -> DataFrame:
    """(rel, pkg, snap_no, id, target, change) over the node and edge snapshots of all packages.

    Of a node written several times the last writing counts, of an edge the first; ids are normalised, a null callGraph is
    none and a null typeOnly false.
    """
    steps = snapshot_steps(envelopes.where((F.col("schemaVersion") == version) & (F.col("resolverVersion") == resolver)), "pkg", "snap_no")
    n = nodes.select("pkg", "snap_no", ids.normalised("id").alias("id"), "name", "kind", ids.normalised("fileId").alias("fileId"), F.coalesce("callGraph", F.lit("none")).alias("callGraph"), "ord")
    e = edges.select("pkg", "snap_no", ids.normalised("source").alias("id"), ids.normalised("target").alias("target"), F.coalesce("typeOnly", F.lit(False)).alias("typeOnly"), "ord")
    a = snapshot_changes(n, steps, "pkg", "snap_no", ["id"], ["name", "kind", "fileId", "callGraph"], F.col("ord")).withColumn("target", F.lit(""))
    b = snapshot_changes(e, steps, "pkg", "snap_no", ["id", "target"], ["typeOnly"], -F.col("ord"))
    return a.withColumn("rel", F.lit("node")).unionByName(b.withColumn("rel", F.lit("edge")))
