"""Queries of the general data-processing problems: snapshots, skewed keys, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import ids
from codeweft.operators.orphans import orphan_references
from codeweft.operators.skew import fragment_join, heavy_keys, key_counts, plan_fragments, skew_report
from codeweft.operators.snapshot_diff import graph_snapshot_changes
from codeweft.plans.base import Register
from codeweft.session import staged, table

R = Register()
EXTS = "'.ts','.tsx','.js','.jsx','.py','.c','.h','.cpp','.hpp','.cc','.cxx','.hxx','.rs','.r'"

P3 = r"""
WITH valid AS (
  SELECT DISTINCT pkg, snap_no FROM snapshot_envelope WHERE schemaVersion = 4 AND resolverVersion = 'ts-resolveModuleName-v1' AND pkg IS NOT NULL AND snap_no IS NOT NULL),
steps AS (SELECT pkg, snap_no, lag(snap_no) OVER (PARTITION BY pkg ORDER BY snap_no) AS prev FROM valid),
n AS (
  SELECT pkg, snap_no, replace(id, '\', '/') AS id, name, kind, replace(fileId, '\', '/') AS fileId, coalesce(callGraph, 'none') AS callGraph
  FROM node_snapshot WHERE id IS NOT NULL AND pkg IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY pkg, snap_no, replace(id, '\', '/') ORDER BY ord DESC) = 1),
e AS (
  SELECT pkg, snap_no, replace(source, '\', '/') AS id, replace(target, '\', '/') AS target, coalesce(typeOnly, false) AS typeOnly
  FROM edge_snapshot WHERE source IS NOT NULL AND target IS NOT NULL AND pkg IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY pkg, snap_no, replace(source, '\', '/'), replace(target, '\', '/') ORDER BY ord) = 1),
nb AS (SELECT s.pkg, s.snap_no, n.id, n.name, n.kind, n.fileId, n.callGraph FROM steps s JOIN n ON n.pkg = s.pkg AND n.snap_no = s.snap_no WHERE s.prev IS NOT NULL),
na AS (SELECT s.pkg, s.snap_no, n.id, n.name, n.kind, n.fileId, n.callGraph FROM steps s JOIN n ON n.pkg = s.pkg AND n.snap_no = s.prev),
eb AS (SELECT s.pkg, s.snap_no, e.id, e.target, e.typeOnly FROM steps s JOIN e ON e.pkg = s.pkg AND e.snap_no = s.snap_no WHERE s.prev IS NOT NULL),
ea AS (SELECT s.pkg, s.snap_no, e.id, e.target, e.typeOnly FROM steps s JOIN e ON e.pkg = s.pkg AND e.snap_no = s.prev)
SELECT 'node' AS rel, coalesce(b.snap_no, a.snap_no) AS snap_no, coalesce(b.id, a.id) AS id, '' AS target,
       CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM nb b FULL JOIN na a ON a.pkg = b.pkg AND a.snap_no = b.snap_no AND a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR (a.name, a.kind, a.fileId, a.callGraph) IS DISTINCT FROM (b.name, b.kind, b.fileId, b.callGraph)
UNION ALL
SELECT 'edge', coalesce(b.snap_no, a.snap_no), coalesce(b.id, a.id), coalesce(b.target, a.target),
       CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END
FROM eb b FULL JOIN ea a ON a.pkg = b.pkg AND a.snap_no = b.snap_no AND a.id = b.id AND a.target = b.target
WHERE a.id IS NULL OR b.id IS NULL OR a.typeOnly <> b.typeOnly"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return graph_snapshot_changes(table(spark, d, "node_snapshot"), table(spark, d, "edge_snapshot"), table(spark, d, "snapshot_envelope"))


@R.add("p3_found", P3)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("rel", "snap_no", "id", "target", "change")


@R.add("p3_changes_per_step", f"SELECT rel, snap_no, change, count(*) AS keys FROM ({P3}) GROUP BY ALL")
def p3_changes_per_step(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).groupBy("rel", "snap_no", "change").agg(F.count(F.lit(1)).alias("keys"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edge_entry").select(ids.normalised("source").alias("source"), ids.normalised("target").alias("target"), "kind", F.coalesce("typeOnly", F.lit(False)).alias("typeOnly"))


#: Share of all rows from which p4_found names a key.
HEAVY_SHARE = 0.02

P4 = r"""
WITH e AS (SELECT replace(source, '\', '/') AS source, replace(target, '\', '/') AS target FROM edge_entry)
SELECT 'target' AS side, target AS id FROM e WHERE target IS NOT NULL GROUP BY target HAVING count(*) >= 0.02 * (SELECT count(*) FROM e)
UNION ALL
SELECT 'source', source FROM e WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 0.02 * (SELECT count(*) FROM e)"""


@R.add("p4_found", P4)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    total = e.count()
    sides = [heavy_keys(e.select(c), c, HEAVY_SHARE, total=total).select(F.lit(c).alias("side"), F.col(c).alias("id")) for c in ("target", "source")]
    return sides[0].unionByName(sides[1])


def _per_key(spark: SparkSession, d: str, key: str, other: str) -> DataFrame:
    """Rows, distinct partners and the node behind every key; repeated pairs are merged before anything moves by key."""
    pairs = staged(_edges(spark, d).where(F.col(key).isNotNull()).groupBy(key, other).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kind") == "call", 1)).alias("calls")))
    nodes = table(spark, d, "node_entry").unionByName(table(spark, d, "shared_node"), allowMissingColumns=True)
    about = nodes.where(F.col("id").isNotNull()).groupBy(ids.normalised("id").alias(key)).agg(F.min("kind").alias("node_kind"))
    joined = fragment_join(pairs, about, key, "left", plan_fragments(pairs, key))
    parts = joined.groupBy(key, F.pmod(F.xxhash64(other), F.lit(64)).alias("shard")).agg(F.sum("n").alias("n"), F.sum("calls").alias("calls"), F.count(other).alias("partners"), F.max("node_kind").alias("node_kind"))
    return parts.groupBy(key).agg(F.sum("n").alias("edges"), F.sum("calls").alias("calls"), F.sum("partners").alias("partners"), F.max("node_kind").alias("node_kind")).withColumnRenamed(key, "id")


def _per_key_sql(key: str, other: str) -> str:
    return rf"""
WITH e AS (SELECT replace({key}, '\', '/') AS k, replace({other}, '\', '/') AS o, kind FROM edge_entry WHERE {key} IS NOT NULL),
n AS (SELECT replace(id, '\', '/') AS id, min(kind) AS node_kind FROM (SELECT id, kind FROM node_entry UNION ALL SELECT id, kind FROM shared_node) WHERE id IS NOT NULL GROUP BY 1),
c AS (SELECT k, count(*) AS edges, count(*) FILTER (kind = 'call') AS calls, count(DISTINCT o) AS partners FROM e GROUP BY k)
SELECT c.k AS id, edges, calls, partners, node_kind FROM c LEFT JOIN n ON n.id = c.k"""


@R.add("p4_fan_in", _per_key_sql("target", "source"))
def p4_fan_in(spark: SparkSession, d: str) -> DataFrame:
    return _per_key(spark, d, "target", "source")


@R.add("p4_fan_out", _per_key_sql("source", "target"))
def p4_fan_out(spark: SparkSession, d: str) -> DataFrame:
    return _per_key(spark, d, "source", "target")


@R.add("p4_counts", r"SELECT replace(target, '\', '/') AS target, count(*) AS rows FROM edge_entry WHERE target IS NOT NULL GROUP BY 1")
def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return key_counts(_edges(spark, d), "target")


@R.add("p4_task_loads")
def p4_task_loads(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the fullest task under plain hashing and under the plan, for both ends; no SQL, as the plan is Spark's."""
    e = _edges(spark, d)
    return skew_report(e, "target").withColumn("side", F.lit("target")).unionByName(skew_report(e, "source").withColumn("side", F.lit("source")))


P5_ALL = rf"""
WITH p AS (
  SELECT replace(id, '\', '/') AS id, kind, scanned_at AS a, deleted_at AS b FROM node_entry WHERE id IS NOT NULL
  UNION ALL SELECT replace(id, '\', '/'), kind, scanned_at, NULL FROM shared_node WHERE id IS NOT NULL),
e AS (
  SELECT ord, scanned_at AS t, replace(target, '\', '/') AS k FROM edge_entry
  WHERE target IS NOT NULL AND target <> ''),
r AS (
  SELECT 'edge_entry' AS ref_table, ord, t, k, false AS files FROM e
  WHERE contains(k, '::') OR contains(k, '/') OR lower(regexp_extract(k, '^.+(\.[^.]*)$', 1)) IN ({EXTS})
  UNION ALL
  SELECT 'node_entry', ord, scanned_at, replace(fileId, '\', '/'), true FROM node_entry WHERE fileId IS NOT NULL),
m AS (
  SELECT r.*, p.a, p.b FROM r JOIN p ON p.id = r.k WHERE NOT r.files OR p.kind = 'file'
  UNION ALL
  SELECT r.*, p.a, p.b FROM r JOIN p ON p.id = regexp_replace(r.k, '\.py$', '/__init__.py') WHERE NOT r.files AND r.k LIKE '%.py'),
s AS (
  SELECT ref_table, ord, bool_or(a <= t AND (b IS NULL OR t < b)) AS hit, bool_or(a <= t AND (b IS NULL OR b > a)) AS before, bool_or(b IS NULL OR b > a) AS ever
  FROM m GROUP BY ref_table, ord)
SELECT r.ref_table, strftime(r.t AT TIME ZONE 'UTC', '%Y-%m') AS period, r.ord, r.k AS key,
       CASE WHEN s.before THEN 'deleted' WHEN s.ever THEN 'late' ELSE 'missing' END AS state
FROM r LEFT JOIN s ON s.ref_table = r.ref_table AND s.ord = r.ord WHERE NOT coalesce(s.hit, false)"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "edge_entry"), table(spark, d, "node_entry"), table(spark, d, "shared_node"))


@R.add("p5_found", f"SELECT ref_table, period, ord FROM ({P5_ALL})")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "period", "ord")


@R.add("p5_orphans", P5_ALL)
def p5_orphans(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "period", "ord", "key", "state")


@R.add("p5_report", f"SELECT ref_table, period, state, count(*) AS orphans, count(DISTINCT key) AS keys FROM ({P5_ALL}) GROUP BY ALL")
def p5_report(spark: SparkSession, d: str) -> DataFrame:
    per_key = _orphans(spark, d).groupBy("ref_table", "period", "state", "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("ref_table", "period", "state").agg(F.sum("n").alias("orphans"), F.count(F.lit(1)).alias("keys"))
