"""Queries behind reports and views: rankings, caps, overlays, refresh plans, inherited settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions import ids, numbers
from codeweft.operators import clones, folders, graph, manifest, metrics, scc, store
from codeweft.plans.base import Register
from codeweft.plans.graph_queries import EXACT, EXT, FOLDER_EDGES, HUB_ROWS, HUBS, REACH, STATUS, TREE, _folder_edges, _status, _tree
from codeweft.plans.tables import CUT, NOW, SPEAKS, THEN, edges, entities, files, first_folder, graph_of, nodes, q_ancestors, q_folder, sql
from codeweft.session import staged, table
from codeweft.sources import files as source_files

R = Register()
S, D = SparkSession, DataFrame
PKG = "split_part(path, '/', 2)"


@R.add("a1_hub_titles", sql(f"SELECT id, 'Ca=' || ca || ' Ce=' || ce || ' I=' || printf('%.2f', instability) AS title FROM (SELECT id, ca, ce, ce / (ca + ce) AS instability FROM deg WHERE ca + ce >= 8)", HUBS))
def a1_titles(s: S, d: str) -> D:
    h = metrics.hubs(graph_of(s, d).file_imports)
    return h.select("id", F.concat(F.lit("Ca="), "ca", F.lit(" Ce="), "ce", F.lit(" I="), numbers.to_fixed("instability")).alias("title"))


@R.add("a6_quantiles", sql("SELECT p, round(v, 9) AS v FROM (SELECT unnest([0.0, 0.25, 0.5, 0.9, 1.0]) AS p, unnest(quantile_cont(weight, [0.0, 0.25, 0.5, 0.9, 1.0])) AS v FROM fo)", FOLDER_EDGES), p="DOUBLE")
def a6(s: S, d: str) -> D:
    p = [0.0, 0.25, 0.5, 0.9, 1.0]
    q = _folder_edges(s, d).agg(F.percentile("weight", F.array(*map(F.lit, p))).alias("q"))
    return q.select(F.explode(F.arrays_zip(F.array(*map(F.lit, p)).alias("p"), F.col("q").alias("v"))).alias("x")).select("x.p", F.round("x.v", 9).alias("v"))


DEC = f"CASE WHEN regexp_matches(lower(regexp_extract(path, '[^/]*$')), '\\.min\\.|\\.bundle\\.|\\.generated\\.|\\.d\\.ts$') THEN 'skipped-denylist' WHEN size > 524288 THEN 'skipped-size' WHEN lines > 2000 THEN 'skipped-lines' ELSE 'parse' END"


@R.add("a16_coverage", sql(f"SELECT {DEC} AS decision, count(*) AS files, bool_or({EXT} = '.py') AS heuristic FROM files GROUP BY 1"))
def a16(s: S, d: str) -> D:
    """Coverage of one scan a package, merged."""
    f = files(s, d).select(F.split("path", "/")[1].alias("pkg"), "path", manifest.scan_decision("path", "size", "lines").alias("decision"))
    parts = f.groupBy("pkg", "decision").agg(F.count(F.lit(1)).alias("files"), F.bool_or(manifest.capability("path") == "heuristic").alias("heuristic"))
    return manifest.merged_coverage(parts)


@R.add("a21_bounding_boxes", sql(f"SELECT {q_folder('path')} AS folder, min(lines) AS x0, max(lines) AS x1, min(size) AS y0, max(size) AS y1 FROM files GROUP BY 1"))
def a21(s: S, d: str) -> D:
    return files(s, d).groupBy(ids.folder("path").alias("folder")).agg(F.min("lines").alias("x0"), F.max("lines").alias("x1"), F.min("size").alias("y0"), F.max("size").alias("y1"))


@R.add("a23_import_node_count", sql("SELECT count(*) AS nodes, count(*) = 0 AS empty FROM inodes"))
def a23(s: S, d: str) -> D:
    return graph_of(s, d).nodes.agg(F.count(F.lit(1)).alias("nodes"), (F.count(F.lit(1)) == 0).alias("empty"))


CHAIN = "ch AS (SELECT id AS source, lead(id) OVER (PARTITION BY normalizedHash ORDER BY id) AS target FROM ce_ents WHERE tokenCount >= 20 AND normalizedHash IS NOT NULL QUALIFY target IS NOT NULL)"


def _chain(s: S, d: str) -> D:
    e = entities(s, d).where((F.col("tokenCount") >= clones.MIN_TOKENS) & F.col("normalizedHash").isNotNull())
    return clones.chain_edges(e, "normalizedHash", "exact-body").select("source", "target")


@R.add("o3_clone_edges_first", sql("SELECT source, target FROM ch ORDER BY source, target", CHAIN))
def o3(s: S, d: str) -> D:
    """Clone edges in a report's order."""
    return _chain(s, d).orderBy("source", "target")


@R.add("o5_report_members", sql("SELECT normalizedHash, array_to_string(list_sort(list(id))[1:20], ' ') AS shown, count(*) AS members FROM ce_ents WHERE tokenCount >= 20 AND normalizedHash IS NOT NULL GROUP BY normalizedHash HAVING count(*) >= 2"))
def o5(s: S, d: str) -> D:
    """Clusters with the first 20 members a report shows; ranks are cut before members are gathered."""
    e = entities(s, d).where((F.col("tokenCount") >= clones.MIN_TOKENS) & F.col("normalizedHash").isNotNull())
    w = Window.partitionBy("normalizedHash")
    r = e.select("normalizedHash", "id", F.row_number().over(w.orderBy("id")).alias("rn"), F.count(F.lit(1)).over(w).alias("members")).where("members >= 2 and rn <= 20")
    return r.groupBy("normalizedHash").agg(F.array_join(F.array_sort(F.collect_list("id")), " ").alias("shown"), F.first("members").alias("members"))


@R.add("o6_capped_candidates", sql(f"SELECT first, severity, least(15, count(*) OVER ()) AS shown, count(*) OVER () AS total FROM ({EXACT}) WHERE members >= 3 OR files > 1 ORDER BY first, normalizedHash LIMIT 15"))
def o6(s: S, d: str) -> D:
    """The 15 candidates a capped review item shows, with how many there are."""
    kept = clones.exact_clones(entities(s, d)).where((F.col("members") >= 3) | (F.col("files") > 1))
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    return kept.orderBy("first", "normalizedHash").limit(15).crossJoin(F.broadcast(total)).select("first", "severity", F.least(F.lit(15).cast("long"), "total").alias("shown"), "total")  # one row


@R.add("o8_children_in_order", sql("SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, string_agg(regexp_extract(path, '[^/]*$'), ',' ORDER BY regexp_extract(path, '[^/]*$')) AS children FROM tree WHERE path <> '' GROUP BY 1", TREE))
def o8(s: S, d: str) -> D:
    return _tree(s, d).where("path <> ''").groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("children"))


@R.add("o9_heaviest_folder_edges", sql('SELECT kind, "from", "to", weight, row_number() OVER (PARTITION BY kind ORDER BY weight DESC, "from", "to") AS place FROM fo QUALIFY place <= 10', FOLDER_EDGES), place="INTEGER")
def o9(s: S, d: str) -> D:
    w = Window.partitionBy("kind").orderBy(F.desc("weight"), "from", "to")
    return _folder_edges(s, d).withColumn("place", F.row_number().over(w)).where("place <= 10")


@R.add("u1_all_edges", sql("SELECT source, target, 'import' AS kind FROM ie UNION ALL SELECT source, target, 'call' FROM ce"))
def u1(s: S, d: str) -> D:
    g = graph_of(s, d)
    return g.imports.select("source", "target", F.lit("import").alias("kind")).unionByName(g.calls.select("source", "target", F.lit("call").alias("kind")))


@R.add("u6_cache_in_scope", sql("SELECT id FROM ce_ents WHERE replace(fileId, '\\', '/') IN (SELECT path FROM files WHERE lines IS NOT NULL)"))
def u6(s: S, d: str) -> D:
    e = entities(s, d).select("id", ids.normalised("fileId").alias("path"))
    return e.join(files(s, d).where("lines is not null").select("path"), "path", "left_semi").select("id")


@R.add("u8_related_files", sql("SELECT normalizedHash, array_to_string(list_sort(list_distinct(list(fileId))), ' ') AS related FROM ce_ents WHERE tokenCount >= 20 AND normalizedHash IS NOT NULL GROUP BY normalizedHash HAVING count(*) >= 2"))
def u8(s: S, d: str) -> D:
    e = entities(s, d).where((F.col("tokenCount") >= clones.MIN_TOKENS) & F.col("normalizedHash").isNotNull())
    c = e.groupBy("normalizedHash").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("fileId")), " ").alias("related"))
    return c.where("n >= 2").select("normalizedHash", "related")


OLD = f"old AS (SELECT path, least(mtimeMs, {CUT}) AS mtimeMs, size, sha256(path) AS hash FROM files WHERE {THEN})"


def _old(s: S, d: str) -> D:
    return files(s, d).where(THEN).select("path", F.expr(f"least(mtimeMs, {CUT})").alias("mtimeMs"), "size", F.sha2("path", 256).alias("hash"))


@R.add("t5_files_to_hash", sql("SELECT f.path FROM files f LEFT JOIN old ON old.path = f.path WHERE old.path IS NULL OR old.mtimeMs <> f.mtimeMs OR old.size <> f.size", OLD))
def t5(s: S, d: str) -> D:
    return manifest.moved(_old(s, d), files(s, d))


@R.add(
    "t6_refresh_plan",
    sql("SELECT path, change IN ('changed', 'deleted') AS purge, change <> 'deleted' AS rescan FROM (SELECT coalesce(old.path, n.path) AS path, CASE WHEN old.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN old.mtimeMs = n.mtimeMs AND old.size = n.size THEN 'unchanged' WHEN old.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS change FROM old FULL JOIN n ON n.path = old.path), folder1 WHERE path = f OR starts_with(path, f || '/')", OLD + f", n AS (SELECT path, mtimeMs, size, sha256(CASE WHEN size > 5000 THEN path ELSE 'z' END) AS hash FROM files WHERE {NOW})"),
)
def t6(s: S, d: str) -> D:
    now = files(s, d).where(NOW).withColumn("hash", F.sha2(F.expr("case when size > 5000 then path else 'z' end"), 256))
    return manifest.refresh_plan(_old(s, d), now, first_folder(s, d))


@R.add("m13_migrated_watch", sql("SELECT f.path, h.hash FROM (SELECT DISTINCT files.path FROM files, folder1 WHERE starts_with(path, f || '/src/') OR lines > 300) f LEFT JOIN (SELECT path, sha256(path) AS hash FROM files WHERE lines IS NOT NULL) h ON h.path = f.path"))
def m13(s: S, d: str) -> D:
    f = files(s, d)
    entry = f.where("lines > 300").select("path").unionByName(s.createDataFrame([(first_folder(s, d) + "/src",)], "path string"))
    return store.migrate_watch(entry, f, f.where("lines is not null").select("path", F.sha2("path", 256).alias("hash")))


@R.add("x4_nearest_config", sql(f"SELECT path, config FROM (SELECT f.path, c.config, row_number() OVER (PARTITION BY f.path ORDER BY length(c.folder) DESC, c.config DESC) AS rn FROM files f JOIN (SELECT DISTINCT {q_folder('path')} AS folder, regexp_extract(path, '[^/]*$') AS config FROM files WHERE {SPEAKS}) c ON starts_with(f.path, c.folder || '/')) WHERE rn = 1"))
def x4(s: S, d: str) -> D:
    """Each file's settings: those of the nearest folder at or above it that has some."""
    f = files(s, d)
    conf = f.where(SPEAKS).select(ids.folder("path").alias("path"), ids.basename("path").alias("document")).distinct()
    at = folders.nearest_document(f.select(ids.folder("path").alias("folder")).distinct(), conf)
    return f.select("path", ids.folder("path").alias("folder")).join(at, "folder").select("path", F.col("document").alias("config"))


@R.add("x14_parser_support", sql(f"SELECT path, {EXT} IN ('.ts', '.tsx', '.js', '.jsx', '.py', '.c', '.h', '.cpp', '.hpp', '.cc', '.cxx', '.hxx', '.rs', '.r') AS parsable, {EXT} NOT IN ('.ts', '.tsx', '.js', '.jsx') AND {EXT} IN ('.py', '.c', '.h', '.cpp', '.hpp', '.cc', '.cxx', '.hxx', '.rs', '.r') AS needsGrammar FROM files"))
def x14(s: S, d: str) -> D:
    rows = [(e.lower(), name != "typescript") for name, _, exts, _ in ids.LANGUAGES for e in exts]
    dim = F.broadcast(s.createDataFrame(sorted(set(rows)), "ext string, needsGrammar boolean"))  # a row an extension
    f = files(s, d).select("path", ids.extension("path").alias("ext")).join(dim, "ext", "left")
    return f.select("path", F.col("needsGrammar").isNotNull().alias("parsable"), F.coalesce("needsGrammar", F.lit(False)).alias("needsGrammar"))


@R.add(
    "g14_inherited_status",
    sql("SELECT folder, coalesce(status, 'never') AS status FROM (SELECT a.folder, b.status, row_number() OVER (PARTITION BY a.folder ORDER BY length(b.folder) DESC NULLS LAST) AS rn FROM stt a LEFT JOIN (SELECT * FROM stt WHERE fileCount >= 2) b ON b.folder = a.folder OR starts_with(a.folder, b.folder || '/')) WHERE rn = 1", STATUS),
)
def g14(s: S, d: str) -> D:
    st = staged(_status(s, d))
    return folders.inherited_status(st, st.where("fileCount >= 2"))


@R.add("v5_folder_edge_stats", sql("SELECT kind, count(*) AS edges FROM edges, folder1 WHERE starts_with(source, f || '/') GROUP BY kind"))
def v5(s: S, d: str) -> D:
    return edges(s, d).where(F.col("source").startswith(first_folder(s, d) + "/")).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


@R.add("v6_view_nodes", sql("SELECT path AS id, regexp_extract(path, '[^/]*$') AS label, fileCount, totalLOC FROM tree WHERE path <> ''", TREE), totalLOC="BIGINT")
def v6(s: S, d: str) -> D:
    return _tree(s, d).where("path <> ''").select(F.col("path").alias("id"), F.col("name").alias("label"), "fileCount", "totalLOC")


@R.add("v7_node_colours", sql(f"SELECT i.id, fileCount FROM inodes i JOIN tree ON tree.path = {q_folder('i.id')} WHERE i.kind = 'file'", TREE))
def v7c(s: S, d: str) -> D:
    """Each file with the row of its exact parent folder, from which it takes its colour."""
    t = _tree(s, d).select(F.col("path").alias("folder"), "fileCount")
    return graph_of(s, d).files.select("id", ids.folder("id").alias("folder")).join(t, "folder").select("id", "fileCount")


@R.add("v10_tree_layout")
def v10(s: S, d: str) -> D:
    """Places of all folders in a drawn tree; parents lie midway between their children, level by level, which SQL can't say."""
    return folders.layout(staged(_tree(s, d).where("path <> ''").select("path", "parent", "depth")))


@R.add("v14_clone_edges_styled", sql("SELECT DISTINCT source, target FROM ch WHERE NOT EXISTS (SELECT 1 FROM cyc a JOIN cyc b ON a.scc = b.scc WHERE a.id = ch.source AND b.id = ch.target)", REACH.format(e="ib") + ", " + CHAIN, True))
def v14(s: S, d: str) -> D:
    """Clone edges a view may restyle: those that are no edge of a cycle."""
    e = staged(graph.without_barrels(graph_of(s, d).imports).select("source", "target"))
    c = staged(scc.cyclic_components(e))
    ch = _chain(s, d).distinct()
    inner = ch.join(c.select(F.col("id").alias("source"), "scc"), "source").join(c.select(F.col("id").alias("target"), F.col("scc").alias("t")), "target").where("scc = t").select("source", "target")
    return ch.join(inner, ["source", "target"], "left_anti")


@R.add("j19_subtree", sql("SELECT path FROM files, folder1 WHERE starts_with(path, f || '/') UNION SELECT unnest(" + q_ancestors("path") + ") FROM files, folder1 WHERE starts_with(path, f || '/')"))
def j19(s: S, d: str) -> D:
    """A folder's files, with all folders that lead to them."""
    f = files(s, d).where(F.col("path").startswith(first_folder(s, d) + "/")).select("path")
    return f.unionByName(f.select(F.explode(ids.ancestors("path")).alias("path"))).distinct()


@R.add("j20_nodes_by_place", sql(f"SELECT {q_folder('fileId')} AS folder, count(*) AS nodes, count(DISTINCT fileId) AS files FROM nodes WHERE fileId IS NOT NULL GROUP BY 1"))
def j20(s: S, d: str) -> D:
    n = nodes(s, d).where("fileId is not null").groupBy(ids.folder("fileId").alias("folder"), "fileId").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("folder").agg(F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("files"))


@R.add("s21_document_folders", sql(f"SELECT DISTINCT {q_folder('path')} AS path FROM files"))
def s21(s: S, d: str) -> D:
    """Source folders with a README under the documents' root, for a root that mirrors every folder."""
    f = files(s, d).select(F.concat(F.lit("docs/"), ids.folder("path"), F.lit("/README.md")).alias("path"))
    return source_files.document_folders(f, "docs")


@R.add("w4_first_notes", "SELECT DISTINCT source AS ref, lower(lang) AS note FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def w4(s: S, d: str) -> D:
    """Candidates without repetition; a row is its key, so which repetition stays makes no difference."""
    return table(s, d, "documents").where("source is not null and lang is not null").select(F.col("source").alias("ref"), F.lower("lang").alias("note")).dropDuplicates(["ref", "note"])


@R.add("f18_status_colours", sql("SELECT folder, CASE status WHEN 'current' THEN 'green' WHEN 'outdated' THEN 'orange' ELSE 'grey' END AS colour FROM stt", STATUS))
def f18c(s: S, d: str) -> D:
    c = F.when(F.col("status") == "current", "green").when(F.col("status") == "outdated", "orange").otherwise("grey")
    return _status(s, d).select("folder", c.alias("colour"))


@R.add("a13_module_distance", sql(f"SELECT severity, count(*) AS clusters, sum(members) AS members FROM ({EXACT}) GROUP BY severity"), members="BIGINT")
def a13(s: S, d: str) -> D:
    return clones.exact_clones(entities(s, d)).groupBy("severity").agg(F.count(F.lit(1)).alias("clusters"), F.sum("members").alias("members"))


@R.add("a1_labels", sql(f"SELECT label, count(*) AS files, max(degree) AS degree FROM ({HUB_ROWS}) GROUP BY label", HUBS))
def a1_labels(s: S, d: str) -> D:
    return metrics.hubs(graph_of(s, d).file_imports).groupBy("label").agg(F.count(F.lit(1)).alias("files"), F.max("degree").alias("degree"))
