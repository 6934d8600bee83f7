"""References to records that are not there at the time of the reference.

References and the validity intervals of their parents are co-partitioned on the referred key and sorted by time; one
linear pass over each sorted run keeps the number of open intervals, so a reference is an orphan where none is open.
An interval opened before tells a deleted parent, one opened only later a late parent, none at all a missing parent; a row
ahead of each run says whether its key has an interval at all, so the pass only looks back.
Tasks are packed by references and intervals together. Hot keys are split into shards over tasks, and their (deduplicated)
intervals copied to each shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import ids
from codeweft.operators.skew import TASK, fragment, plan_fragments, replicate, to_tasks

HEAD = 9


def merge_references(refs: DataFrame, parents: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every row of refs with its state: found, missing, deleted or late.

    refs: key STRING, at TIMESTAMP and any further columns, which are kept. parents: key, opened, closed (null: still
    there); opened counts as inside, closed as outside. Intervals that are empty or without a key or start never hold.
    A reference with a null key refers to nothing and is left out; one without a time can't lie in an interval, and is
    missing, or late where the parent exists at some time. Repeated rows stay repeated. A further column named state comes
    out as state_ref. Empty tables are fine on either side.
    """
    extra = [c for c in refs.columns if c not in ("key", "at")]
    refs = refs.where(F.col("key").isNotNull())
    spans = parents.where(F.col("key").isNotNull() & F.col("opened").isNotNull() & (F.col("closed").isNull() | (F.col("closed") > F.col("opened")))).select("key", "opened", "closed")
    plan = plan_fragments(refs.select("key").unionByName(spans.select("key")), "key", tasks)
    # a head without a time goes before everything else of its key
    head, ends = F.struct(F.lit(None).cast("timestamp").alias("at"), F.lit(HEAD).alias("step")), [F.struct(F.col(c).alias("at"), F.lit(n).alias("step")) for c, n in (("opened", 1), ("closed", -1))]
    events = spans.distinct().select("key", F.explode(F.array(head, *ends)).alias("e")).select("key", "e.*").where(F.col("at").isNotNull() | (F.col("step") == HEAD))
    left = fragment(refs.select("key", "at", F.lit(0).alias("step"), F.struct(*(F.col(c) for c in extra), F.lit(1).alias("__ref")).alias("row")), plan)
    stream = to_tasks(left.unionByName(replicate(events, plan), allowMissingColumns=True), plan)
    # closings before openings before references, at equal times
    step = F.col("step")
    sofar = Window.partitionBy(TASK, "key").orderBy("at", F.when(step == 0, 2).when(step == HEAD, -2).otherwise(step)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = stream.select(
        "key", "at", "row", F.sum(F.when(step != HEAD, step)).over(sofar).alias("open"), F.max(F.when(step == 1, 1)).over(sofar).alias("before"), F.max(F.when(step == HEAD, 1)).over(sofar).alias("ever")
    ).where(F.col("row").isNotNull())
    state = F.when(F.col("open") > 0, "found").when(F.col("before") == 1, "deleted").when(F.col("ever") == 1, "late").otherwise("missing")
    return merged.select("key", "at", *(F.col(f"row.{c}").alias("state_ref" if c == "state" else c) for c in extra), state.alias("state"))


def graph_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The references of both graph tables as (key, at, ref_table, period, ord).

    An edge refers to its target, whatever its kind of node; a node refers to its file. Keys carry the kind of reference as
    a prefix, since a file reference is only met by a node of kind file. Null and empty targets, external modules and null
    file ids are no references.
    """
    at = F.col("scanned_at").cast("timestamp")
    period = F.date_format(at, "yyyy-MM")
    target = ids.normalised("target")
    e = edges.select(target.alias("k"), at.alias("at"), F.lit("edge_entry").alias("ref_table"), period.alias("period"), "ord").where((F.col("k") != "") & ~ids.is_external("k"))
    n = nodes.where(F.col("fileId").isNotNull()).select(ids.normalised("fileId").alias("k"), at.alias("at"), F.lit("node_entry").alias("ref_table"), period.alias("period"), "ord")
    return e.withColumn("key", F.concat(F.lit("n "), "k")).drop("k").unionByName(n.withColumn("key", F.concat(F.lit("f "), "k")).drop("k"))


def graph_parents(*nodes: DataFrame) -> DataFrame:
    """Intervals of the nodes under every key they can be referred by: id, module of a package's __init__.py, file."""
    out = None
    for df in nodes:
        closed = F.col("deleted_at") if "deleted_at" in df.columns else F.lit(None)
        one = df.select(ids.normalised("id").alias("id"), "kind", F.col("scanned_at").cast("timestamp").alias("opened"), closed.cast("timestamp").alias("closed"))
        out = one if out is None else out.unionByName(one)
    module = F.when(F.col("id").endswith("/__init__.py"), F.concat(F.lit("n "), F.regexp_replace("id", r"/__init__\.py$", ".py")))
    keys = F.array_compact(F.array(F.concat(F.lit("n "), "id"), module, F.when(F.col("kind") == "file", F.concat(F.lit("f "), "id"))))
    return out.select(F.explode(keys).alias("key"), "opened", "closed")


def orphan_references(edges: DataFrame, nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """(ref_table, period, ord, key, state) of every reference whose node is not there at the time of the row."""
    return merge_references(graph_references(edges, nodes), graph_parents(nodes, shared)).where(F.col("state") != "found").withColumn("key", F.substring("key", 3, 1_000_000)).drop("at")
