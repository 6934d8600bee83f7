"""The test tables as store, graph and file tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import ids
from codeweft.operators import graph, store
from codeweft.session import table

EXTS = "'.ts','.tsx','.js','.jsx','.py','.c','.h','.cpp','.hpp','.cc','.cxx','.hxx','.rs','.r'"


def raw_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All node writings; shared nodes count as written before everything else."""
    a = table(spark, d, "node_entry").select("id", "name", "kind", "fileId", "callGraph", "ord", "deleted_at")
    b = table(spark, d, "shared_node").select("id", "name", "kind", "fileId", "callGraph", F.lit(-1).cast("long").alias("ord"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return a.unionByName(b).withColumns({"id": ids.normalised("id"), "fileId": ids.normalised("fileId"), "callGraph": F.coalesce("callGraph", F.lit("none"))})


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert_nodes(raw_nodes(spark, d)).where(F.col("deleted_at").isNull()).drop("deleted_at")


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edge_entry").select(ids.normalised("source").alias("source"), ids.normalised("target").alias("target"), "kind", "typeOnly", "ord")
    return e.where((F.col("source") != "") & (F.col("target") != ""))


def edges(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    e = raw_edges(spark, d)
    if kind:
        return store.first_edges(e, kind)
    return store.first_edges(e, "import").unionByName(store.first_edges(e, "call"))


def graph_of(spark: SparkSession, d: str) -> graph.Graph:
    return graph.build(nodes(spark, d), edges(spark, d))


def files(spark: SparkSession, d: str) -> DataFrame:
    """(path, size, lines, mtimeMs), one row per file id."""
    f = table(spark, d, "file_node").where(F.col("id").isNotNull())
    return f.groupBy(F.col("id").alias("path")).agg(F.max("size").alias("size"), F.max("lines").alias("lines"), F.max("mtimeMs").alias("mtimeMs"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Cached entities, one row per id: (id, fileId, normalizedHash, tokenCount, literalHashes)."""
    e = table(spark, d, "cached_entity").where(F.col("id").isNotNull())
    return e.groupBy("id").agg(F.max("fileId").alias("fileId"), F.max("normalizedHash").alias("normalizedHash"), F.max("tokenCount").alias("tokenCount"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("literalHashes")))).alias("literalHashes"))


def q_external(x: str) -> str:
    return rf"(NOT contains({x}, '::') AND NOT contains({x}, '/') AND NOT lower(regexp_extract({x}, '^.+(\.[^.]*)$', 1)) IN ({EXTS}))"


def q_file(x: str) -> str:
    return f"CASE WHEN contains({x}, '::') THEN left({x}, instr({x}, '::') - 1) ELSE {x} END"


def q_folder(x: str) -> str:
    return f"CASE WHEN contains({x}, '/') THEN regexp_replace({x}, '/[^/]*$', '') ELSE '.' END"


def q_ancestors(x: str) -> str:
    return f"list_transform(range(1, len(string_split({x}, '/'))), lambda k: array_to_string(string_split({x}, '/')[1:k], '/'))"


#: Two states of the files: what a scan of the middle of 2024 knew, with files modified since as they may have been, and what is
#: there after the output folders were cleared. Conditions for Spark and SQL alike.
CUT = "1.72e12"
THEN, NOW = f"(mtimeMs < {CUT} OR lines IS NOT NULL)", "(path NOT LIKE '%/dist/%' AND path NOT LIKE '%/public/%')"
#: Files that speak for their folder.
SPEAKS = "(path LIKE '%/__init__.%' OR path LIKE '%/index.%')"

BARREL = r"'(^|/)(index\.(ts|tsx|js|jsx)|__init__\.pyi?)$'"
TESTFILE = r"'^tests/|/tests/|__tests__/|\.(test|spec)\.'"

CTES = rf"""
raw_nodes AS (
  SELECT replace(id, '\', '/') AS id, name, kind, replace(fileId, '\', '/') AS fileId, coalesce(callGraph, 'none') AS callGraph, ord, deleted_at FROM node_entry
  UNION ALL SELECT id, name, kind, fileId, coalesce(callGraph, 'none'), -1, NULL FROM shared_node),
nodes AS (
  SELECT id, name, kind, fileId, callGraph, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn, min(ord) OVER (PARTITION BY id) AS pos FROM raw_nodes WHERE id IS NOT NULL)
  WHERE rn = 1 AND deleted_at IS NULL),
raw_edges AS (
  SELECT replace(source, '\', '/') AS source, replace(target, '\', '/') AS target, kind, typeOnly, ord FROM edge_entry WHERE source <> '' AND target <> ''),
edges AS (
  SELECT source, target, kind, coalesce(typeOnly, false) AS typeOnly, ord FROM raw_edges WHERE kind IN ('import', 'call')
  QUALIFY row_number() OVER (PARTITION BY kind, source, target ORDER BY ord) = 1),
fids AS (SELECT DISTINCT fileId AS id FROM nodes WHERE fileId IS NOT NULL),
ie AS (
  SELECT source, target, typeOnly, ord FROM (
    SELECT e.source, CASE WHEN t.id IS NOT NULL OR {q_external("e.target")} THEN e.target WHEN i.id IS NOT NULL THEN i.id END AS target, typeOnly, ord
    FROM edges e LEFT JOIN fids s ON s.id = e.source LEFT JOIN fids t ON t.id = e.target
    LEFT JOIN fids i ON i.id = regexp_replace(e.target, '(\.(tsx|ts|jsx|js|py|cpp|hpp|cxx|hxx|cc|c|h|rs|r|R))$', '/__init__\1')
    WHERE e.kind = 'import' AND (s.id IS NOT NULL OR {q_external("e.source")}))
  WHERE target IS NOT NULL),
inodes AS (
  SELECT id, CASE WHEN {q_external("id")} THEN 'external' ELSE 'file' END AS kind FROM (
    SELECT id FROM fids UNION SELECT source FROM ie UNION SELECT target FROM ie)),
fe AS (SELECT * FROM ie WHERE NOT {q_external("source")} AND NOT {q_external("target")}),
ib AS (SELECT * FROM ie WHERE NOT regexp_matches(source, {BARREL}) AND NOT regexp_matches(target, {BARREL})),
ents AS (SELECT id, name, kind, fileId, callGraph FROM nodes WHERE kind <> 'file' AND callGraph <> 'none'),
ce AS (SELECT source, target FROM edges WHERE kind = 'call' AND source IN (SELECT id FROM ents) AND target IN (SELECT id FROM ents)),
files AS (SELECT id AS path, max(size) AS size, max(lines) AS lines, max(mtimeMs) AS mtimeMs FROM file_node WHERE id IS NOT NULL GROUP BY id),
ce_ents AS (
  SELECT id, max(fileId) AS fileId, max(normalizedHash) AS normalizedHash, max(tokenCount) AS tokenCount FROM cached_entity WHERE id IS NOT NULL GROUP BY id),
lits AS (SELECT DISTINCT l.id, c.fileId, l.literal FROM (SELECT id, unnest(literalHashes) AS literal FROM cached_entity) l JOIN ce_ents c ON c.id = l.id WHERE l.literal IS NOT NULL),
folder1 AS (SELECT min(split_part(id, '/', 1) || '/' || split_part(id, '/', 2)) AS f FROM nodes WHERE id LIKE 'packages/%'),
file1 AS (SELECT target AS f FROM fe GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)"""


def sql(body: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{CTES}{', ' + more if more else ''} {body}"


def first_folder(spark: SparkSession, d: str) -> str:
    """The least package folder: a parameter that every size of the tables has."""
    p = F.substring_index("id", "/", 2)
    return nodes(spark, d).where(F.col("id").startswith("packages/")).agg(F.min(p)).first()[0] or "packages/none"


def top_file(spark: SparkSession, d: str) -> str:
    """The most imported file."""
    r = graph_of(spark, d).file_imports.groupBy("target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target").first()
    return r[0] if r else "none"
