"""Queries of the store, graph, metric, clone, folder and manifest operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import ids
from codeweft.operators import clones, folders, graph, manifest, metrics, scc, store
from codeweft.plans.base import Register
from codeweft.plans.tables import (
    CUT, NOW, SPEAKS, THEN,
    BARREL, EXTS, TESTFILE, edges, entities, files, first_folder, graph_of, nodes, q_ancestors, q_external, q_file, q_folder, raw_edges, raw_nodes, sql, top_file,
)
from codeweft.session import ranked, staged, table

R = Register()
S = SparkSession
D = DataFrame


# ---- store -----------------------------------------------------------------------------------------------------------


@R.add("m1_upsert_nodes", sql("SELECT id, name, kind, fileId, callGraph, pos FROM nodes"))
def m1(s: S, d: str) -> D:
    return nodes(s, d).select("id", "name", "kind", "fileId", "callGraph", "pos")


@R.add("m2_first_edges", sql("SELECT * FROM edges"))
def m2(s: S, d: str) -> D:
    return edges(s, d)


@R.add("m3_remove_file_nodes", sql("SELECT id FROM nodes WHERE fileId IS DISTINCT FROM (SELECT f FROM file1)"))
def m3(s: S, d: str) -> D:
    return store.without_file_nodes(nodes(s, d), top_file(s, d)).select("id")


@R.add(
    "m4_remove_folder",
    sql(
        "SELECT 'node' AS rel, id AS a, '' AS b FROM nodes, folder1 WHERE NOT coalesce(fileId = f OR starts_with(fileId, f || '/'), false) UNION ALL "
        "SELECT kind, source, target FROM edges, folder1 WHERE NOT (source = f OR starts_with(source, f || '/') OR starts_with(source, f || '::'))"
    ),
)
def m4(s: S, d: str) -> D:
    n, e = store.remove_folder(nodes(s, d), edges(s, d), first_folder(s, d))
    return n.select(F.lit("node").alias("rel"), F.col("id").alias("a"), F.lit("").alias("b")).unionByName(e.select(F.col("kind").alias("rel"), F.col("source").alias("a"), F.col("target").alias("b")))


@R.add("m5_remove_file", sql(f"SELECT kind, source, target FROM edges WHERE {q_file('source')} <> (SELECT f FROM file1) AND {q_file('target')} <> (SELECT f FROM file1)"))
def m5(s: S, d: str) -> D:
    return store.remove_file(nodes(s, d), edges(s, d), top_file(s, d))[1].select("kind", "source", "target")


@R.add("m6_nodes_under", sql("SELECT id, kind FROM nodes, folder1 WHERE fileId = f OR starts_with(fileId, f || '/')"))
def m6(s: S, d: str) -> D:
    return store.nodes_under(nodes(s, d), first_folder(s, d)).select("id", "kind")


@R.add("m6_store_stats", sql("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT fileId) FROM nodes) AS fileCount, (SELECT count(*) FROM edges) AS edges"))
def m6s(s: S, d: str) -> D:
    return store.store_stats(nodes(s, d), edges(s, d))


@R.add(
    "m9_replace_files",
    sql(
        "SELECT id AS a, '' AS b FROM kept UNION ALL SELECT source, target FROM edges WHERE kind = 'import' AND source NOT IN (SELECT path FROM chg) AND target NOT IN (SELECT path FROM chg) UNION ALL SELECT DISTINCT 'new', path FROM chg",
        "chg AS (SELECT path FROM files WHERE lines > 350), kept AS (SELECT id FROM nodes WHERE fileId IS NULL OR fileId NOT IN (SELECT path FROM chg))",
    ),
)
def m9(s: S, d: str) -> D:
    n, e = nodes(s, d).select("id", "name", "kind", "fileId", "callGraph"), edges(s, d, "import").select("source", "target", "kind", "typeOnly")
    chg = files(s, d).where("lines > 350").select("path")
    new = chg.select(F.lit("new").alias("source"), F.col("path").alias("target"), F.lit("import").alias("kind"), F.lit(False).alias("typeOnly"))
    a, b = store.replace_files(n, e, chg, n.limit(0), new)
    return a.select(F.col("id").alias("a"), F.lit("").alias("b")).unionByName(b.select(F.col("source").alias("a"), F.col("target").alias("b")))


@R.add("m10_valid_envelopes", "SELECT DISTINCT pkg, snap_no FROM snapshot_envelope WHERE schemaVersion = 4 AND resolverVersion = 'ts-resolveModuleName-v1'")
def m10(s: S, d: str) -> D:
    e = table(s, d, "snapshot_envelope")
    return e.where((F.col("schemaVersion") == store.SCHEMA_VERSION) & (F.col("resolverVersion") == store.RESOLVER_VERSION)).select("pkg", "snap_no").distinct()


@R.add("m11_watched_folders", sql(f"SELECT folder, count(*) AS files FROM (SELECT unnest({q_ancestors('path')}) AS folder FROM files WHERE lines > 100) GROUP BY folder"))
def m11(s: S, d: str) -> D:
    return store.folders_with_watched(files(s, d).where("lines > 100").select("path"))


@R.add("m11_watch_set", sql("SELECT path FROM (SELECT path FROM files WHERE lines > 100 UNION SELECT path FROM files WHERE size > 9000), folder1 WHERE NOT (path = f OR starts_with(path, f || '/'))"))
def m11w(s: S, d: str) -> D:
    f = files(s, d)
    return store.watch_remove_folder(store.watch_add(f.where("lines > 100"), f.where("size > 9000")), first_folder(s, d))


CHANGED = f"saved AS (SELECT DISTINCT path, sha256('v' || size) AS hash FROM files WHERE {THEN}), cur AS (SELECT path, sha256('v' || (size + CAST(lines > 200 AS INT))) AS hash FROM files WHERE lines IS NOT NULL)"


@R.add("m12_changed_files", sql("SELECT cur.path, cur.hash FROM cur LEFT JOIN saved ON saved.path = cur.path WHERE cur.hash IS DISTINCT FROM saved.hash", CHANGED))
def m12(s: S, d: str) -> D:
    f = files(s, d)
    saved = f.where(THEN).select("path", F.sha2(F.concat(F.lit("v"), F.col("size").cast("string")), 256).alias("hash"))
    now = f.where("lines is not null").select("path", F.sha2(F.concat(F.lit("v"), (F.col("size") + (F.col("lines") > 200).cast("int")).cast("string")), 256).alias("hash"))
    return store.changed_hashes(saved, now)


# ---- filters ---------------------------------------------------------------------------------------------------------

GEN = r"regexp_matches(lower(regexp_extract(path, '[^/]*$')), '\.min\.|\.bundle\.|\.generated\.|\.d\.ts$')"
EXT = r"lower(regexp_extract(path, '^.+(\.[^.]*)$', 1))"


@R.add(
    "f1_scan_decisions",
    sql(f"SELECT path, CASE WHEN {GEN} THEN 'skipped-denylist' WHEN size > 524288 THEN 'skipped-size' WHEN {EXT} IN ({EXTS}) THEN CASE WHEN lines > 2000 THEN 'skipped-lines' ELSE 'parse' END ELSE 'unsupported' END AS decision, {EXT} = '.py' AS heuristic FROM files"),
)
def f1(s: S, d: str) -> D:
    return files(s, d).select("path", manifest.scan_decision("path", "size", "lines").alias("decision"), (manifest.capability("path") == "heuristic").alias("heuristic"))


@R.add("f2_generated_names", sql(f"SELECT path FROM files WHERE {GEN}"))
def f2(s: S, d: str) -> D:
    return files(s, d).where(manifest.is_generated_name("path")).select("path")


@R.add("f3_internal_edges", sql("SELECT kind, source, target FROM edges WHERE NOT contains(source, 'node_modules') AND NOT contains(target, 'node_modules')"))
def f3(s: S, d: str) -> D:
    return edges(s, d).where(~F.col("source").contains("node_modules") & ~F.col("target").contains("node_modules")).select("kind", "source", "target")


@R.add("f4_edges_by_kind", "SELECT kind, count(*) AS edges FROM edge_entry GROUP BY kind")
def f4(s: S, d: str) -> D:
    return table(s, d, "edge_entry").groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


@R.add("f5_edges_from_file", sql("SELECT kind, source, target FROM edges, file1 WHERE CASE WHEN kind = 'import' THEN source = f ELSE starts_with(source, f || '::') END"))
def f5(s: S, d: str) -> D:
    return graph.edges_from_file(edges(s, d), top_file(s, d)).select("kind", "source", "target")


@R.add("f6_nodes_of_file", sql("SELECT id, kind FROM nodes WHERE fileId = (SELECT f FROM file1)"))
def f6(s: S, d: str) -> D:
    return store.nodes_of_file(nodes(s, d), top_file(s, d)).select("id", "kind")


def _inside(c: str, deep: bool) -> str:
    f = f"(CASE WHEN kind = 'call' THEN {q_file(c)} ELSE {c} END)"
    return f"(starts_with({f}, f || '/src/')" + ("" if deep else f" AND NOT contains(substr({f}, length(f) + 6), '/')") + ")"


@R.add("f7_module_edges", sql(f"SELECT kind, source, target FROM edges, folder1 WHERE {_inside('source', False)} OR {_inside('target', False)}"))
def f7(s: S, d: str) -> D:
    return graph.edges_for_module(edges(s, d), first_folder(s, d) + "/src").select("kind", "source", "target")


@R.add("f7_module_edges_recursive", sql(f"SELECT kind, source, target FROM edges, folder1 WHERE {_inside('source', True)} OR {_inside('target', True)}"))
def f7r(s: S, d: str) -> D:
    return graph.edges_for_module(edges(s, d), first_folder(s, d) + "/src", True).select("kind", "source", "target")


@R.add("f8_without_barrels", sql("SELECT source, target, typeOnly FROM ib"))
def f8(s: S, d: str) -> D:
    return graph.without_barrels(graph_of(s, d).imports).select("source", "target", "typeOnly")


@R.add("f9_without_external_calls", sql(f"SELECT source, target FROM edges WHERE kind = 'call' AND NOT {q_external('(' + q_file('source') + ')')} AND NOT {q_external('(' + q_file('target') + ')')}"))
def f9(s: S, d: str) -> D:
    return graph.without_external_calls(edges(s, d, "call")).select("source", "target")


W_IE = f"""w AS (SELECT path AS id FROM files WHERE lines > 60), wf AS (SELECT id FROM fids WHERE id IN (SELECT id FROM w)),
wie AS (SELECT source, target FROM (SELECT e.source, CASE WHEN t.id IS NOT NULL OR {q_external('e.target')} THEN e.target WHEN i.id IS NOT NULL THEN i.id END AS target FROM edges e JOIN wf s ON s.id = e.source LEFT JOIN wf t ON t.id = e.target
LEFT JOIN wf i ON i.id = regexp_replace(e.target, '(\\.(tsx|ts|jsx|js|py|cpp|hpp|cxx|hxx|cc|c|h|rs|r|R))$', '/__init__\\1') WHERE e.kind = 'import') WHERE target IS NOT NULL)"""


@R.add("f10_watched_graph", sql("SELECT source, target FROM wie", W_IE))
def f10(s: S, d: str) -> D:
    return graph.build(nodes(s, d), edges(s, d), files(s, d).where("lines > 60").select("path")).imports.select("source", "target")


@R.add("f11_typescript_files", sql("SELECT path FROM files WHERE regexp_matches(path, '\\.tsx?$')"))
def f11(s: S, d: str) -> D:
    return files(s, d).where(F.col("path").rlike(r"\.tsx?$")).select("path")


@R.add("f12_workspace_ends", sql(f"SELECT DISTINCT target, (NOT {q_external('target')} OR regexp_matches(target, '^.+\\..*$')) AS workspace FROM edges WHERE kind = 'import'"))
def f12(s: S, d: str) -> D:
    return edges(s, d, "import").select("target", folders.is_workspace_file("target").alias("workspace")).distinct()


@R.add("f13_under_path", sql("SELECT path FROM files, folder1 WHERE path = f || '/src' OR starts_with(path, f || '/src/')"))
def f13(s: S, d: str) -> D:
    return files(s, d).where(ids.under("path", first_folder(s, d) + "/src/")).select("path")


@R.add("f14_test_files", sql(f"SELECT path FROM files WHERE regexp_matches(path, {TESTFILE})"))
def f14(s: S, d: str) -> D:
    return files(s, d).where(clones.is_test_file("path")).select("path")


@R.add("f15_clone_floor", sql("SELECT id FROM ce_ents WHERE tokenCount >= 20"))
def f15(s: S, d: str) -> D:
    return entities(s, d).where(F.col("tokenCount") >= clones.MIN_TOKENS).select("id")


STD = "(" + ",".join(f"'{x}'" for x in graph.STDLIB) + ")"
NAME = lambda c: f"(CASE WHEN contains({c}, '::') THEN substr({c}, instr({c}, '::') + 2) ELSE {c} END)"


@R.add("f17_no_stdlib_calls", sql(f"SELECT source, target FROM edges WHERE kind = 'call' AND {NAME('target')} NOT IN {STD}"))
def f17(s: S, d: str) -> D:
    return graph.no_stdlib_calls(edges(s, d, "call")).select("source", "target")


# ---- graph -----------------------------------------------------------------------------------------------------------


@R.add("g1_import_graph", sql("SELECT source, target, typeOnly FROM ie"))
def g1i(s: S, d: str) -> D:
    return graph_of(s, d).imports.select("source", "target", "typeOnly")


@R.add("g1_import_nodes", sql("SELECT id, kind FROM inodes"))
def g1n(s: S, d: str) -> D:
    return graph_of(s, d).nodes


@R.add("g1_call_graph", sql("SELECT source, target FROM ce"))
def g1c(s: S, d: str) -> D:
    return graph_of(s, d).calls


@R.add("g1_call_nodes", sql("SELECT id, name, kind, fileId, callGraph FROM ents"))
def g1e(s: S, d: str) -> D:
    return graph_of(s, d).entities


@R.add("g2_successors", sql("SELECT n.id, coalesce(string_agg(DISTINCT ie.target, ' ' ORDER BY ie.target), '') AS next FROM inodes n LEFT JOIN ie ON ie.source = n.id GROUP BY n.id"))
def g2(s: S, d: str) -> D:
    g = graph_of(s, d)
    return graph.successors(g.nodes, g.imports).select("id", F.array_join("next", " ").alias("next"))


REACH = """e AS (SELECT DISTINCT source, target FROM {e}), reach AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM reach r JOIN e ON e.source = r.target),
mutual AS (SELECT a.source AS id, least(a.source, min(a.target)) AS scc, count(*) AS n FROM reach a JOIN reach b ON b.source = a.target AND b.target = a.source GROUP BY a.source),
cyc AS (SELECT id, scc FROM mutual)"""


@R.add("g3_components", sql("SELECT n.id, coalesce(cyc.scc, n.id) AS scc FROM inodes n LEFT JOIN cyc ON cyc.id = n.id", REACH.format(e="ib"), True))
def g3(s: S, d: str) -> D:
    g = graph_of(s, d)
    return scc.all_components(g.nodes, graph.without_barrels(g.imports))


@R.add("g4_cyclic_components", sql("SELECT id, scc FROM cyc", REACH.format(e="ib"), True))
def g4(s: S, d: str) -> D:
    return scc.cyclic_components(graph.without_barrels(graph_of(s, d).imports))


@R.add("g5_edges_in_cycles", sql("SELECT DISTINCT ib.source || '->' || ib.target AS key FROM ib JOIN cyc a ON a.id = ib.source JOIN cyc b ON b.id = ib.target AND a.scc = b.scc", REACH.format(e="ib"), True))
def g5(s: S, d: str) -> D:
    e = graph.without_barrels(graph_of(s, d).imports)
    return scc.edges_in_cycles(e, scc.cyclic_components(e)).select(F.concat("source", F.lit("->"), "target").alias("key")).distinct()


WALK = """, inner_e AS (SELECT DISTINCT a.scc, ib.source, ib.target FROM ib JOIN cyc a ON a.id = ib.source JOIN cyc b ON b.id = ib.target AND a.scc = b.scc),
walk AS (SELECT scc, scc AS pt, [scc] AS path FROM (SELECT DISTINCT scc FROM cyc) UNION ALL
  SELECT w.scc, i.target, list_append(w.path, i.target) FROM walk w JOIN inner_e i ON i.scc = w.scc AND i.source = w.pt WHERE (NOT list_contains(w.path, i.target) OR i.target = w.scc) AND (w.pt <> w.scc OR len(w.path) = 1)),
best AS (SELECT scc, path, row_number() OVER (PARTITION BY scc ORDER BY len(path), path) AS rn FROM walk WHERE pt = scc AND len(path) > 1)"""


@R.add("g6_shortest_cycles", sql("SELECT scc, array_to_string(path, ' -> ') AS path FROM best WHERE rn = 1", REACH.format(e="ib") + WALK, True))
def g6(s: S, d: str) -> D:
    e = staged(graph.without_barrels(graph_of(s, d).imports).select("source", "target"))
    return scc.shortest_cycles(e, staged(scc.cyclic_components(e))).select("scc", F.array_join("path", " -> ").alias("path"))


CALLS_IN = f"xc AS (SELECT * FROM ce WHERE NOT {q_external('(' + q_file('source') + ')')} AND NOT {q_external('(' + q_file('target') + ')')})"


@R.add("g7_call_edges_in_cycles")
def g7(s: S, d: str) -> D:
    """Call edges on cycles; reachability over the call graph is too large for SQL on whole tables, so tests use brute force."""
    e = staged(graph.without_external_calls(graph_of(s, d).calls))
    return scc.edges_in_cycles(e, scc.cyclic_components(e)).select(F.concat("source", F.lit("->"), "target").alias("key")).distinct()


RUNTIME = """, re AS (SELECT DISTINCT source, target FROM ib WHERE NOT typeOnly), rreach AS (SELECT source, target FROM re UNION SELECT r.source, re.target FROM rreach r JOIN re ON re.source = r.target),
rt AS (SELECT DISTINCT source AS id FROM rreach WHERE source = target),
cnt AS (SELECT a.scc, count(*) AS totalEdgeCount, count(*) FILTER (typeOnly) AS typeOnlyEdgeCount FROM ib JOIN cyc a ON a.id = ib.source JOIN cyc b ON b.id = ib.target AND a.scc = b.scc GROUP BY a.scc)"""


@R.add(
    "g8_import_cycles",
    sql("SELECT cyc.scc, string_agg(cyc.id, ' ' ORDER BY cyc.id) AS members, coalesce(string_agg(rt.id, ' ' ORDER BY rt.id), '') AS runtimeMembers, any_value(totalEdgeCount) AS totalEdgeCount, any_value(typeOnlyEdgeCount) AS typeOnlyEdgeCount, any_value(array_to_string(best.path, ' ')) AS path FROM cyc LEFT JOIN rt ON rt.id = cyc.id JOIN cnt ON cnt.scc = cyc.scc JOIN best ON best.scc = cyc.scc AND best.rn = 1 GROUP BY cyc.scc", REACH.format(e="ib") + WALK + RUNTIME, True),
)
def g8(s: S, d: str) -> D:
    c = scc.import_cycles(staged(graph.without_barrels(graph_of(s, d).imports).select("source", "target", "typeOnly")))
    j = lambda x: F.array_join(x, " ").alias(x)
    return c.select("scc", j("members"), j("runtimeMembers"), "totalEdgeCount", "typeOnlyEdgeCount", j("path"))


@R.add("g9_call_cycles")
def g9(s: S, d: str) -> D:
    """Mutual call cycles and recursion; as g7, tested by brute force."""
    return scc.call_cycles(staged(graph.without_external_calls(graph_of(s, d).calls))).select("scc", F.array_join("members", " ").alias("members"), "kind", "severity")


@R.add("g11_reverse_index", sql("SELECT DISTINCT target, source AS caller, name AS callerName, fileId AS callerFile FROM ce JOIN ents ON ents.id = ce.source"))
def g11(s: S, d: str) -> D:
    g = graph_of(s, d)
    return graph.reverse_index(g.calls, g.entities)


@R.add("j5_file_of_calls", sql(f"SELECT e.source, e.target, coalesce(n.fileId, {q_file('e.target')}) AS targetFile FROM edges e LEFT JOIN nodes n ON n.id = e.target WHERE e.kind = 'call'"))
def j5(s: S, d: str) -> D:
    home = nodes(s, d).select(F.col("id").alias("target"), "fileId")
    return edges(s, d, "call").join(home, "target", "left").select("source", "target", F.coalesce("fileId", ids.file_part("target")).alias("targetFile"))


@R.add("j16_neighbours", sql("SELECT DISTINCT id FROM (SELECT target AS id FROM ie WHERE source = (SELECT f FROM file1) UNION ALL SELECT source FROM ie WHERE target = (SELECT f FROM file1)) WHERE id <> (SELECT f FROM file1)"))
def j16(s: S, d: str) -> D:
    return graph.neighbours(graph_of(s, d).imports, s.createDataFrame([(top_file(s, d),)], "id string"))


@R.add("a15_graph_stats", sql("SELECT (SELECT count(*) FROM inodes) AS importNodes, (SELECT count(*) FROM inodes WHERE kind = 'file') AS fileCount, (SELECT count(*) FROM ie) AS importEdges, (SELECT count(*) FROM ents) AS callNodes, (SELECT count(*) FROM ce) AS callEdges"))
def a15(s: S, d: str) -> D:
    return graph.graph_stats(graph_of(s, d))


# ---- metrics ---------------------------------------------------------------------------------------------------------

HUBS = "ca AS (SELECT target AS id, count(DISTINCT source) AS ca FROM fe GROUP BY 1), cx AS (SELECT source AS id, count(DISTINCT target) AS ce FROM fe GROUP BY 1), deg AS (SELECT coalesce(ca.id, cx.id) AS id, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM ca FULL JOIN cx ON cx.id = ca.id)"
HUB_ROWS = "SELECT id, ca, ce, ca + ce AS degree, round(ce / (ca + ce), 9) AS instability, CASE WHEN ce / (ca + ce) <= 0.3 THEN 'kernel' ELSE 'unstable-hub' END AS label FROM deg WHERE ca + ce >= 8"


@R.add("a1_hub_metrics", sql(HUB_ROWS, HUBS))
def a1(s: S, d: str) -> D:
    return metrics.hubs(graph_of(s, d).file_imports).withColumn("instability", F.round("instability", 9))


@R.add("o1_hubs_ranked", sql(f"SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) AS place FROM ({HUB_ROWS})", HUBS))
def o1(s: S, d: str) -> D:
    return ranked(metrics.hubs(graph_of(s, d).file_imports).select("id", "degree"), [F.desc("degree"), F.col("id")], "place")


@R.add("a2_max_fan_in", sql("SELECT coalesce(max(ca), 0) AS maxFanIn FROM deg", HUBS))
def a2(s: S, d: str) -> D:
    return metrics.max_fan_in(graph_of(s, d).file_imports)


WIDTH = f"""
doors AS (
  SELECT 'file' AS scope, target AS module, target AS entry, count(*) AS inbound FROM fe WHERE source <> target GROUP BY target
  UNION ALL
  SELECT 'folder', module, target, count(*) FROM (SELECT source, target, unnest({q_ancestors('target')}) AS module FROM fe WHERE source <> target) WHERE NOT starts_with(source, module || '/') GROUP BY module, target
  UNION ALL
  SELECT 'function', target, target, count(*) FROM ce JOIN ents a ON a.id = ce.source JOIN ents b ON b.id = ce.target WHERE a.fileId <> b.fileId GROUP BY target),
dw AS (SELECT scope, module, count(*) AS w, sum(inbound) AS s, sum(inbound * inbound) AS q FROM doors GROUP BY ALL),
pf AS (SELECT fileId AS module, count(*) AS n FROM ents WHERE fileId IS NOT NULL GROUP BY fileId),
pfo AS (SELECT module, sum(n) AS n FROM (SELECT unnest({q_ancestors('module')}) AS module, n FROM pf) GROUP BY module),
mods AS (
  SELECT 'file' AS scope, i.id AS module, greatest(0, len(string_split(i.id, '/')) - 2) AS treeDepth, coalesce(n, 0) AS moduleDepth, n IS NULL AND i.id IN (SELECT target FROM fe) AS isBarrel
  FROM inodes i LEFT JOIN pf ON pf.module = i.id WHERE i.kind = 'file'
  UNION ALL
  SELECT 'folder', f.module, len(string_split(f.module, '/')) - 1, coalesce(n, 0), false FROM (SELECT DISTINCT unnest({q_ancestors('id')}) AS module FROM inodes WHERE kind = 'file') f LEFT JOIN pfo ON pfo.module = f.module
  UNION ALL
  SELECT 'function', e.id, greatest(0, len(string_split(e.fileId, '/')) - 2), 1, false FROM ents e WHERE e.id IN (SELECT module FROM doors WHERE scope = 'function')),
width AS (
  SELECT m.scope, m.module, treeDepth, coalesce(w, 0) AS w, CASE WHEN w > 0 THEN s * s / q ELSE 0.0 END AS wEff, moduleDepth, CASE WHEN w > 0 THEN moduleDepth / (s * s / q) ELSE 0.0 END AS dmr, isBarrel, coalesce(s, 0) AS inbound
  FROM mods m LEFT JOIN dw ON dw.scope = m.scope AND dw.module = m.module),
fq AS (SELECT count(*) AS folders, quantile_cont(wEff, 0.75) AS wide, quantile_cont(dmr, 0.25) AS shallow FROM width WHERE scope = 'folder' AND w > 0),
uq AS (SELECT coalesce(quantile_cont(inbound, 0.9), 0) AS busy FROM width WHERE scope = 'function'),
cal AS (
  SELECT width.*, CASE WHEN scope = 'folder' AND w > 0 AND folders >= 8 AND wEff >= greatest(wide, 2) AND dmr <= shallow AND treeDepth >= 1 THEN 'shallow-wide' WHEN scope = 'function' AND inbound >= greatest(busy, 5) THEN 'wide-utility' END AS note FROM width, fq, uq)"""


def _width(s: S, d: str) -> tuple[D, D]:
    g = graph_of(s, d)
    doors = metrics.entry_points(g.file_imports, g.entities, g.calls)
    return metrics.interface_width(g.files, g.file_imports, g.entities, g.calls), doors


@R.add("a3_interface_width", sql("SELECT scope, module, treeDepth, w, round(wEff, 9) AS wEff, moduleDepth, round(dmr, 9) AS dmr, isBarrel FROM width", WIDTH), treeDepth="INTEGER", moduleDepth="BIGINT")
def a3(s: S, d: str) -> D:
    return _width(s, d)[0].withColumns({"wEff": F.round("wEff", 9), "dmr": F.round("dmr", 9)})


@R.add("a4_top_entry_points", sql("SELECT scope, module, entry, inbound, row_number() OVER (PARTITION BY scope, module ORDER BY inbound DESC, entry) AS place FROM doors QUALIFY place <= 5", WIDTH), place="INTEGER")
def a4(s: S, d: str) -> D:
    return metrics.top_entry_points(_width(s, d)[1])


@R.add("a5_barrel_modules", sql("SELECT module FROM width WHERE isBarrel", WIDTH))
def a5(s: S, d: str) -> D:
    return _width(s, d)[0].where("isBarrel").select("module")


@R.add("a7_width_severity", sql("SELECT scope, module, note, CASE WHEN note = 'shallow-wide' THEN 'medium' ELSE 'low' END AS severity FROM cal", WIDTH))
def a7(s: S, d: str) -> D:
    w, doors = _width(s, d)
    return metrics.calibrated(metrics.with_inbound(w, doors)).select("scope", "module", "note", "severity")


@R.add(
    "v16_width_quantiles",
    sql("SELECT round(quantile_cont(wEff, 0.25), 9) AS p25, round(quantile_cont(wEff, 0.5), 9) AS p50, round(quantile_cont(wEff, 0.75), 9) AS p75, round(quantile_cont(wEff, 0.9), 9) AS p90, round(max(wEff), 9) AS top, round(quantile_cont(dmr, 0.25), 9) AS dmr25, (SELECT count(*) FROM cal WHERE note = 'shallow-wide') AS promoted FROM width WHERE scope = 'folder' AND w > 0", WIDTH),
)
def v16(s: S, d: str) -> D:
    w, doors = _width(s, d)
    f = metrics.calibrated(metrics.with_inbound(w, doors))
    p = lambda c, q: F.round(F.percentile(c, F.lit(q)), 9)
    used = f.where("scope = 'folder' and w > 0")
    return used.agg(p("wEff", 0.25).alias("p25"), p("wEff", 0.5).alias("p50"), p("wEff", 0.75).alias("p75"), p("wEff", 0.9).alias("p90"), F.round(F.max("wEff"), 9).alias("top"), p("dmr", 0.25).alias("dmr25"), F.count(F.when(F.col("note") == "shallow-wide", 1)).alias("promoted"))


# ---- clones ----------------------------------------------------------------------------------------------------------


def _cluster_sql(rows: str, key: str) -> str:
    m = "CASE WHEN starts_with(fileId, 'src/') THEN split_part(fileId, '/', 1) || '/' || split_part(fileId, '/', 2) ELSE split_part(fileId, '/', 1) END"
    t = f"NOT regexp_matches(fileId, {TESTFILE})"
    return f"""SELECT {key}, count(*) AS members, count(DISTINCT fileId) AS files, min(id) AS first, CASE WHEN count(DISTINCT CASE WHEN {t} THEN fileId END) <= 1 THEN 'low' WHEN count(DISTINCT CASE WHEN {t} THEN {m} END) <= 1 THEN 'medium' ELSE 'high' END AS severity
FROM {rows} GROUP BY {key} HAVING count(*) >= 2"""


EXACT = _cluster_sql("(SELECT * FROM ce_ents WHERE tokenCount >= 20 AND normalizedHash IS NOT NULL)", "normalizedHash")
LITS = _cluster_sql("lits", "literal")
KIND = "CASE split_part(literal, ':', 1) WHEN 'str' THEN 'string' WHEN 'arr' THEN 'array' WHEN 're' THEN 'regex' WHEN 'num' THEN 'numeric' END"


@R.add("a11_exact_clones", sql(EXACT))
def a11(s: S, d: str) -> D:
    return clones.exact_clones(entities(s, d))


@R.add("a12_shared_literals", sql(f"SELECT *, {KIND} AS sharedKind FROM ({LITS})"))
def a12(s: S, d: str) -> D:
    return clones.shared_literals(entities(s, d))


@R.add("w1_clone_chain", sql("SELECT normalizedHash, id AS source, lead(id) OVER (PARTITION BY normalizedHash ORDER BY id) AS target, 'exact-body' AS cloneType FROM ce_ents WHERE tokenCount >= 20 AND normalizedHash IS NOT NULL QUALIFY target IS NOT NULL"))
def w1(s: S, d: str) -> D:
    e = entities(s, d).where((F.col("tokenCount") >= clones.MIN_TOKENS) & F.col("normalizedHash").isNotNull())
    return clones.chain_edges(e, "normalizedHash", "exact-body")


@R.add("o2_clones_ranked", sql(f"SELECT severity, first, members, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rank FROM ({EXACT})"))
def o2(s: S, d: str) -> D:
    return clones.ranked(clones.exact_clones(entities(s, d))).select("severity", "first", "members", "rank")


@R.add("f16_clones_kept", sql(f"SELECT normalizedHash FROM ({EXACT}) WHERE members >= 3 OR files > 1"))
def f16(s: S, d: str) -> D:
    return clones.exact_clones(entities(s, d)).where((F.col("members") >= 3) | (F.col("files") > 1)).select("normalizedHash")


@R.add("w2_disambiguated", sql("SELECT fileId, name, startByte, CASE WHEN row_number() OVER (PARTITION BY fileId, name ORDER BY startByte) > 1 THEN fileId || '::' || name || '@' || startByte ELSE fileId || '::' || name END AS id FROM (SELECT replace(fileId, '\\', '/') AS fileId, name, ord AS startByte FROM node_entry WHERE fileId IS NOT NULL AND kind <> 'file')"))
def w2(s: S, d: str) -> D:
    n = table(s, d, "node_entry").where((F.col("kind") != "file") & F.col("fileId").isNotNull())
    return clones.disambiguated(n.select(ids.normalised("fileId").alias("fileId"), "name", F.col("ord").alias("startByte")))


# ---- folders ---------------------------------------------------------------------------------------------------------

FOLDER_EDGES = f"""
rows_ AS (SELECT source, target, 'import' AS kind FROM ie UNION ALL SELECT coalesce(a.fileId, {q_file('ce.source')}), coalesce(b.fileId, {q_file('ce.target')}), 'call' FROM ce LEFT JOIN ents a ON a.id = ce.source LEFT JOIN ents b ON b.id = ce.target),
ws AS (SELECT * FROM rows_ WHERE (NOT {q_external('source')} OR regexp_matches(source, '^.+\\..*$')) AND (NOT {q_external('target')} OR regexp_matches(target, '^.+\\..*$'))),
fo AS (SELECT "from", "to", kind, count(*) AS weight FROM (SELECT {q_folder('source')} AS "from", {q_folder('target')} AS "to", kind FROM ws) WHERE "from" <> "to" GROUP BY ALL),
p90 AS (SELECT coalesce(quantile_cont(weight, 0.9), 0) AS p FROM fo)"""


def _folder_edges(s: S, d: str) -> D:
    g = graph_of(s, d)
    return folders.folder_edges(g.imports, g.calls, g.entities)


@R.add("a9_folder_edges", sql('SELECT "from", "to", kind, weight FROM fo', FOLDER_EDGES))
def a9(s: S, d: str) -> D:
    return _folder_edges(s, d)


@R.add("a8_weight_p90", sql('SELECT round(p, 9) AS "weightP90" FROM p90', FOLDER_EDGES))
def a8(s: S, d: str) -> D:
    return folders.weight_p90(_folder_edges(s, d)).select(F.round("weightP90", 9).alias("weightP90"))


@R.add("f18_visible_edges", sql("""SELECT kind || '|' || "from" || '|' || "to" AS id, "from", "to", kind, weight, round(least(1 + log2(weight + 1), 6), 9) AS width FROM fo, p90 WHERE weight >= p""", FOLDER_EDGES))
def f18(s: S, d: str) -> D:
    return folders.visible_edges(_folder_edges(s, d)).withColumn("width", F.round("width", 9))


@R.add("f19_non_incident_edges", sql("""SELECT kind || '|' || "from" || '|' || "to" AS id FROM fo, folder1 WHERE "from" <> f || '/src' AND "to" <> f || '/src'""", FOLDER_EDGES))
def f19(s: S, d: str) -> D:
    f = first_folder(s, d) + "/src"
    return folders.visible_edges(_folder_edges(s, d), True).where((F.col("from") != f) & (F.col("to") != f)).select("id")


@R.add("j11_drilldown", sql(f'SELECT ie.source, ie.target, fo."from", fo."to" FROM ie JOIN fo ON fo."from" = {q_folder("ie.source")} AND fo."to" = {q_folder("ie.target")} AND fo.kind = \'import\' WHERE weight >= (SELECT p FROM p90)', FOLDER_EDGES))
def j11(s: S, d: str) -> D:
    g = graph_of(s, d)
    top = folders.visible_edges(folders.folder_edges(g.imports, g.calls, g.entities)).where("kind = 'import'").select("from", "to")
    return g.imports.select("source", "target", ids.folder("source").alias("from"), ids.folder("target").alias("to")).join(top, ["from", "to"])


TREE = f"""
tf AS (SELECT i.id, coalesce(f.lines, 0) AS loc FROM inodes i LEFT JOIN files f ON f.path = i.id WHERE NOT {q_external('i.id')} OR regexp_matches(i.id, '^.+\\..*$')),
tr AS (SELECT '' AS path, loc FROM tf UNION ALL SELECT unnest(CASE WHEN contains(id, '/') THEN {q_ancestors('id')} ELSE ['.'] END), loc FROM tf),
docd AS (SELECT DISTINCT {q_folder('path')} AS path FROM documents WHERE source = 'readme' AND path IS NOT NULL UNION SELECT f || '/src' FROM folder1),
tree AS (SELECT t.path, count(*) AS fileCount, sum(loc) AS totalLOC, t.path IN (SELECT path FROM docd) AS documented FROM tr t GROUP BY t.path)"""


def _tree(s: S, d: str) -> D:
    f = graph_of(s, d).nodes.join(files(s, d).select(F.col("path").alias("id"), F.col("lines").alias("loc")), "id", "left").select("id", "loc")
    docs = table(s, d, "documents").where("source = 'readme' and path is not null").select(ids.folder("path").alias("path"))
    return folders.folder_tree(f, docs.unionByName(s.createDataFrame([(first_folder(s, d) + "/src",)], "path string")))


@R.add("a10_folder_tree", sql("SELECT path, CASE WHEN path = '' THEN NULL WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, regexp_extract(path, '[^/]*$') AS name, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS depth, fileCount, totalLOC, documented FROM tree", TREE), depth="INTEGER", totalLOC="BIGINT")
def a10(s: S, d: str) -> D:
    return _tree(s, d)


@R.add("g12_folder_children", sql("SELECT a.path AS parent, b.path AS child FROM tree a JOIN tree b ON a.path = CASE WHEN contains(b.path, '/') THEN regexp_replace(b.path, '/[^/]*$', '') ELSE '' END AND b.path <> ''", TREE))
def g12(s: S, d: str) -> D:
    t = _tree(s, d)
    return t.where("path <> ''").select("parent", F.col("path").alias("child")).join(t.select(F.col("path").alias("parent")), "parent", "left_semi")


STATUS = f"""
done AS (SELECT DISTINCT source AS path FROM ie),
st AS (SELECT {q_folder('files.path')} AS folder, count(*) AS fileCount, count(done.path) AS withEdges, max(mtimeMs) AS last FROM files LEFT JOIN done ON done.path = files.path GROUP BY 1),
stt AS (SELECT folder, fileCount, withEdges, CASE WHEN withEdges = fileCount AND last <= 1720000000000 THEN 'current' WHEN withEdges > 0 THEN 'outdated' ELSE 'never' END AS status FROM st)"""


def _status(s: S, d: str) -> D:
    return folders.folder_status(files(s, d), graph_of(s, d).imports.select(F.col("source").alias("path")), 1_720_000_000_000)


@R.add("a18_folder_status", sql("SELECT * FROM stt", STATUS))
def a18(s: S, d: str) -> D:
    return _status(s, d)


@R.add("g13_bubbled_status", sql("SELECT a.folder, CASE max(CASE b.status WHEN 'never' THEN 2 WHEN 'outdated' THEN 1 ELSE 0 END) WHEN 2 THEN 'never' WHEN 1 THEN 'outdated' ELSE 'current' END AS status FROM stt a JOIN stt b ON b.folder = a.folder OR starts_with(b.folder, a.folder || '/') OR a.folder = '.' GROUP BY a.folder", STATUS))
def g13(s: S, d: str) -> D:
    return folders.bubbled_status(_status(s, d))


@R.add(
    "j17_nearest_document",
    sql(f"SELECT folder, document FROM (SELECT f.folder, dd.document, row_number() OVER (PARTITION BY f.folder ORDER BY length(dd.path) DESC, dd.document DESC) AS rn FROM (SELECT DISTINCT {q_folder('path')} AS folder FROM files) f JOIN dd ON f.folder = dd.path OR starts_with(f.folder, dd.path || '/')) WHERE rn = 1", "dd AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path, regexp_extract(path, '[^/]*$') AS document FROM files WHERE " + SPEAKS + ")"),
)
def j17(s: S, d: str) -> D:
    f = files(s, d)
    docs = f.where(SPEAKS).select(ids.folder("path").alias("path"), ids.basename("path").alias("document")).distinct()
    return folders.nearest_document(f.select(ids.folder("path").alias("folder")).distinct(), docs)


# ---- manifest --------------------------------------------------------------------------------------------------------

MANIFESTS = f"""old AS (SELECT path, least(mtimeMs, {CUT}) AS mtimeMs, size, CASE WHEN mtimeMs < {CUT} OR size > 5000 THEN sha256(path || size) ELSE 'x' END AS hash FROM files WHERE {THEN}),
new AS (SELECT path, mtimeMs, size, CASE WHEN lines IS NOT NULL THEN sha256(path || size) END AS hash FROM files WHERE {NOW})"""


@R.add(
    "t7_diff_manifest",
    sql("SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'new' WHEN new.path IS NULL THEN 'deleted' WHEN old.mtimeMs = new.mtimeMs AND old.size = new.size THEN 'unchanged' WHEN old.hash = new.hash THEN 'unchanged' ELSE 'changed' END AS change FROM old FULL JOIN new ON new.path = old.path", MANIFESTS),
)
def t7(s: S, d: str) -> D:
    f = files(s, d).withColumn("hash", F.sha2(F.concat("path", F.col("size").cast("string")), 256))
    old = f.where(THEN).withColumn("hash", F.expr(f"case when mtimeMs < {CUT} or size > 5000 then hash else 'x' end")).withColumn("mtimeMs", F.expr(f"least(mtimeMs, {CUT})"))
    new = f.where(NOW).withColumn("hash", F.expr("case when lines is not null then hash end"))
    return manifest.diff_manifest(old, new)


@R.add("s6_ignored_folders", sql(r"SELECT path FROM files WHERE list_has_any(string_split(path, '/')[1:-2], [" + ",".join(f"'{x}'" for x in manifest.IGNORED) + "])"))
def s6(s: S, d: str) -> D:
    return files(s, d).where(manifest.in_ignored_folder("path")).select("path")


@R.add("s17_line_counts", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(text, chr(10))) END AS lines FROM documents WHERE text IS NOT NULL", lines="INTEGER")
def s17(s: S, d: str) -> D:
    return table(s, d, "documents").where("text is not null").select("doc_id", manifest.line_count("text").alias("lines"))


@R.add("s18_folder_lines", sql(f"SELECT {q_folder('path')} AS folder, {EXT} AS ext, count(*) AS files, sum(greatest(coalesce(lines, 0), 1)) AS lines FROM files GROUP BY 1, 2"), lines="BIGINT")
def s18(s: S, d: str) -> D:
    return manifest.folder_lines(files(s, d))


@R.add("s28_lazy_population", sql("SELECT coalesce(sum(lines), 0) AS lines, coalesce(sum(lines), 0) > 10000 AS filesOnly FROM files"), lines="BIGINT")
def s28(s: S, d: str) -> D:
    return manifest.lazy(files(s, d))


@R.add("x15_languages", sql(f"SELECT path, CASE WHEN {EXT} IN ('.ts', '.tsx', '.js', '.jsx') THEN 'semantic' WHEN {EXT} = '.py' THEN 'heuristic' ELSE 'none' END AS callGraph, CASE WHEN {EXT} IN ('.js', '.jsx') THEN 'javascript' WHEN {EXT} IN ('.ts', '.tsx') THEN 'typescript' WHEN {EXT} = '.py' THEN 'python' WHEN {EXT} = '.rs' THEN 'rust' WHEN {EXT} = '.r' THEN 'r' WHEN {EXT} IN ({EXTS}) THEN 'cpp' ELSE 'code' END AS language FROM files"))
def x15(s: S, d: str) -> D:
    return files(s, d).select("path", manifest.capability("path").alias("callGraph"), manifest.language("path").alias("language"))


@R.add("s14_text_hashes", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def s14(s: S, d: str) -> D:
    return table(s, d, "documents").where("text is not null").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))


# ---- health ----------------------------------------------------------------------------------------------------------


@R.add("a14_health_vector")
def a14(s: S, d: str) -> D:
    """All scalars in one row; no SQL, as call-graph reachability is too large for it. Its parts have their own SQL."""
    from codeweft.operators.health import health_vector

    return health_vector(graph_of(s, d), entities(s, d), files(s, d))


# ---- viewer ----------------------------------------------------------------------------------------------------------


@R.add("v1_folder_calls", sql(f"SELECT DISTINCT source, target, CASE WHEN si AND ti THEN 'internal' WHEN si THEN 'outgoing' ELSE 'incoming' END AS side FROM (SELECT source, target, starts_with({q_file('source')}, f || '/') AS si, starts_with({q_file('target')}, f || '/') AS ti FROM edges, folder1 WHERE kind = 'call' AND {NAME('target')} NOT IN {STD}) WHERE si OR ti"))
def v1(s: S, d: str) -> D:
    return graph.folder_calls(edges(s, d, "call").select("source", "target"), first_folder(s, d))


@R.add("v2_folder_external_imports", sql("SELECT DISTINCT regexp_extract(source, '[^/]*$') AS source, target FROM edges, folder1 WHERE kind = 'import' AND starts_with(source, f || '/') AND NOT starts_with(target, f || '/')"))
def v2(s: S, d: str) -> D:
    f = first_folder(s, d)
    return edges(s, d, "import").where(ids.under("source", f) & ~ids.under("target", f)).select(ids.basename("source").alias("source"), "target").distinct()


@R.add("v3_folder_listing", sql("SELECT fileId, count(*) FILTER (kind <> 'file') AS entities, string_agg(name, ',' ORDER BY name, id) FILTER (kind <> 'file') AS names FROM nodes, folder1 WHERE fileId = f OR starts_with(fileId, f || '/') GROUP BY fileId"))
def v3(s: S, d: str) -> D:
    n = store.nodes_under(nodes(s, d), first_folder(s, d))
    own = F.when(F.col("kind") != "file", F.struct("name", "id"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["name"]), ",")
    return n.groupBy("fileId").agg(F.count(own).alias("entities"), names.alias("names")).withColumn("names", F.when(F.col("entities") > 0, F.col("names")))


@R.add("v4_file_calls", sql(f"SELECT source, target, {q_file('target')} = f AS local FROM edges, file1 WHERE kind = 'call' AND starts_with(source, f || '::') AND {NAME('target')} NOT IN {STD}"))
def v4(s: S, d: str) -> D:
    f = top_file(s, d)
    c = graph.no_stdlib_calls(graph.edges_from_file(edges(s, d, "call"), f))
    return c.select("source", "target", (ids.file_part("target") == f).alias("local"))


@R.add("v7_top_container", sql("SELECT path FROM tree WHERE path <> '' AND NOT (len(string_split(path, '/')) = 1 AND (SELECT count(*) FROM tree WHERE path <> '' AND NOT contains(path, '/')) = 1)", TREE))
def v7(s: S, d: str) -> D:
    t = _tree(s, d).where("path <> ''")
    n = t.where("depth = 1").agg(F.count(F.lit(1)).alias("n"))
    return t.crossJoin(F.broadcast(n)).where("not (depth = 1 and n = 1)").select("path")


@R.add("v11_watched_descendants", sql(f"SELECT folder, bool_and(w) AS allWatched, bool_or(w) AS anyWatched FROM (SELECT unnest({q_ancestors('path')}) AS folder, coalesce(lines > 100, false) AS w FROM files) GROUP BY folder"))
def v11(s: S, d: str) -> D:
    f = files(s, d).select(F.explode(ids.ancestors("path")).alias("folder"), F.coalesce(F.col("lines") > 100, F.lit(False)).alias("w"))
    return f.groupBy("folder").agg(F.bool_and("w").alias("allWatched"), F.bool_or("w").alias("anyWatched"))


@R.add("v12_parsable_folders", sql(f"SELECT folder, bool_or(p) AS parsable FROM (SELECT unnest({q_ancestors('path')}) AS folder, {EXT} IN ({EXTS}) AS p FROM files) GROUP BY folder"))
def v12(s: S, d: str) -> D:
    f = files(s, d).select(F.explode(ids.ancestors("path")).alias("folder"), ids.has_source_extension("path").alias("p"))
    return f.groupBy("folder").agg(F.bool_or("p").alias("parsable"))


@R.add("v13_labels", sql(r"SELECT id, list_extract(regexp_split_to_array(id, '[/\\:#]'), -1) AS label, callGraph = 'heuristic' AS heuristic FROM nodes"))
def v13(s: S, d: str) -> D:
    return nodes(s, d).select("id", F.element_at(F.split("id", r"[/\\:#]"), -1).alias("label"), (F.col("callGraph") == "heuristic").alias("heuristic"))


@R.add("f20_graph_view", sql("SELECT source, target, EXISTS (SELECT 1 FROM cyc a JOIN cyc b ON a.scc = b.scc WHERE a.id = ie.source AND b.id = ie.target) AND NOT regexp_matches(source, " + BARREL + ") AND NOT regexp_matches(target, " + BARREL + ") AS inCycle FROM ie", REACH.format(e="ib"), True))
def f20(s: S, d: str) -> D:
    imports = staged(graph_of(s, d).imports)
    inner = scc.edges_in_cycles(graph.without_barrels(imports), scc.cyclic_components(graph.without_barrels(imports))).select("source", "target", F.lit(True).alias("c")).distinct()
    return imports.join(inner, ["source", "target"], "left").select("source", "target", F.coalesce("c", F.lit(False)).alias("inCycle"))


@R.add("j12_clone_edges_shown", sql("SELECT source, target FROM (SELECT id AS source, lead(id) OVER (PARTITION BY normalizedHash ORDER BY id) AS target FROM ce_ents WHERE tokenCount >= 20 AND normalizedHash IS NOT NULL) WHERE source IN (SELECT id FROM ents) AND target IN (SELECT id FROM ents)"))
def j12(s: S, d: str) -> D:
    shown = nodes(s, d).where("kind <> 'file' and callGraph <> 'none'").select("id")
    return w1(s, d).select("source", "target").join(shown.withColumnRenamed("id", "source"), "source", "left_semi").join(shown.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")


@R.add("u7_involved_nodes", sql(f"SELECT DISTINCT id FROM (SELECT source AS id FROM edges, folder1 WHERE {_inside('source', True)} OR {_inside('target', True)} UNION ALL SELECT target FROM edges, folder1 WHERE {_inside('source', True)} OR {_inside('target', True)} UNION ALL SELECT id FROM nodes, folder1 WHERE starts_with(fileId, f || '/src/'))"))
def u7(s: S, d: str) -> D:
    f = first_folder(s, d) + "/src"
    e = graph.edges_for_module(edges(s, d), f, True)
    own = nodes(s, d).where(F.col("fileId").startswith(f + "/")).select("id")
    return e.select(F.explode(F.array("source", "target")).alias("id")).unionByName(own).distinct()


@R.add("a22_document_stats", sql("SELECT (SELECT count(DISTINCT fileId) FROM raw_nodes) AS files, (SELECT count(*) FROM raw_nodes) AS nodes, (SELECT count(*) FROM raw_edges) AS edges"))
def a22(s: S, d: str) -> D:
    n = raw_nodes(s, d).agg(F.countDistinct("fileId").alias("files"), F.count(F.lit(1)).alias("nodes"))
    return n.crossJoin(raw_edges(s, d).agg(F.count(F.lit(1)).alias("edges")))
