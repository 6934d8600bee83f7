"""Queries of the extractors, resolvers, review scanners, file listings and change streams."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import bodies, ids
from codeweft.operators import clones, graph, metrics, review, scanners, scc
from codeweft.plans.base import Register
from codeweft.plans.graph_queries import EXACT, EXT, HUB_ROWS, HUBS, WIDTH, _width
from codeweft.plans.tables import EXTS, edges, entities, files, graph_of, nodes, q_ancestors, q_external, q_file, q_folder, raw_nodes, sql
from codeweft.session import ranked, shared_dir, staged, table
from codeweft.sources import extract, resolve
from codeweft.sources import files as source_files
from codeweft.streaming import watch

R = Register()
S, D = SparkSession, DataFrame


# ---- extraction ------------------------------------------------------------------------------------------------------


def _arts(s: S, d: str) -> D:
    """Artifacts of every distinct (path, text): a path may hold several texts that have nothing in common; copies count once."""
    docs = table(s, d, "documents").where("path is not null and text is not null").select("path", "text").distinct()
    return staged(extract.artifacts(docs))


@R.add("x1_entities")
def x1(s: S, d: str) -> D:
    """Entities of every source text, by the extractor of its path's language; textHash tells the texts of a path apart."""
    return _arts(s, d).select("path", "textHash", "language", F.inline("entities")).select("path", "textHash", "language", "name", "kind", "exported", "startLine", "endLine", F.size("calls").alias("calls"))


@R.add("x5_artifact_counts")
def x5(s: S, d: str) -> D:
    """Per language: paths, their distinct texts, and what the texts hold."""
    return _arts(s, d).groupBy("language").agg(F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("texts"), F.count("error").alias("errors"), F.sum(F.size("entities")).alias("entities"), F.sum(F.size("imports")).alias("imports"))


@R.add("x11_artifact_nodes")
def x11(s: S, d: str) -> D:
    return resolve.entity_nodes(_arts(s, d), "textHash")


@R.add("x13_artifact_calls")
def x13(s: S, d: str) -> D:
    return resolve.call_edges_of(_arts(s, d), "textHash")


# ---- bodies ----------------------------------------------------------------------------------------------------------

BODY = f"b AS (SELECT path, text, {bodies.normalized_sql('text')} AS n FROM (SELECT DISTINCT path, text FROM documents WHERE path IS NOT NULL AND text IS NOT NULL))"


def _bodies(s: S, d: str) -> D:
    return table(s, d, "documents").where("path is not null and text is not null").select("path", "text").distinct()


@R.add("h1_normalized_bodies", f"WITH {BODY} SELECT path, sha256(text) AS textHash, sha256(n.text) AS normalizedHash, n.tokenCount AS tokenCount FROM b", tokenCount="INTEGER")
def h1(s: S, d: str) -> D:
    """Every source text in the form that forgets names and literal values."""
    return _bodies(s, d).withColumn("n", bodies.normalized_body("text")).select("path", F.sha2("text", 256).alias("textHash"), F.sha2("n.text", 256).alias("normalizedHash"), "n.tokenCount")


@R.add("h2_literal_hashes")
def h2(s: S, d: str) -> D:
    """Literal payloads of every source text, with the number of texts that hold each; cut by Python, so tests pin them."""
    b = bodies.entity_hashes(_bodies(s, d), "text")
    return b.select(F.explode(F.array_distinct("literalHashes")).alias("literal")).groupBy("literal").agg(F.count(F.lit(1)).alias("texts")).withColumn("sharedKind", clones.shared_kind("literal"))


@R.add("h3_text_clones", f"WITH {BODY} SELECT sha256(n.text) AS normalizedHash, count(*) AS members, count(DISTINCT path) AS files, max(n.tokenCount) AS tokenCount FROM b WHERE n.tokenCount >= 20 GROUP BY 1 HAVING count(*) >= 2", tokenCount="INTEGER")
def h3(s: S, d: str) -> D:
    """Source texts that differ in names and literal values only; texts are counted by path and text."""
    n = _bodies(s, d).withColumn("n", bodies.normalized_body("text")).where(F.col("n.tokenCount") >= clones.MIN_TOKENS).select(F.sha2("n.text", 256).alias("normalizedHash"), "path", F.col("n.tokenCount").alias("t"))
    per = n.groupBy("normalizedHash", "path").agg(F.count(F.lit(1)).alias("m"), F.max("t").alias("t"))
    return per.groupBy("normalizedHash").agg(F.sum("m").alias("members"), F.count(F.lit(1)).alias("files"), F.max("t").alias("tokenCount")).where("members >= 2")


STEM = r"regexp_replace(regexp_replace(target, '\.[A-Za-z]+$', ''), '/index$', '')"
CAND = "[" + ", ".join(f"'{c}'" for c in resolve.INDEX_CANDIDATES) + "]"


@R.add(
    "x3_resolved_modules",
    sql(f"SELECT stem, path FROM (SELECT s.stem, f.path, row_number() OVER (PARTITION BY s.stem ORDER BY c.i) AS rn FROM st s, (SELECT unnest({CAND}) AS e, unnest(range(8)) AS i) c JOIN files f ON f.path = s.stem || c.e) WHERE rn = 1", f"st AS (SELECT DISTINCT {STEM} AS stem FROM edges WHERE kind = 'import' AND contains(target, '/'))"),
)
def x3(s: S, d: str) -> D:
    stems = edges(s, d, "import").where(F.col("target").contains("/")).select(F.regexp_replace(F.regexp_replace("target", r"\.[A-Za-z]+$", ""), "/index$", "").alias("stem"))
    return resolve.resolve_module(stems, files(s, d))


SPECS = "spec AS (SELECT path, CASE WHEN size % 7 = 0 THEN './x.y' WHEN size % 7 = 1 THEN '..' || regexp_replace(regexp_extract(path, '[^/]*$'), '\\..*$', '') WHEN size % 7 = 2 THEN 'src.parser.walker' WHEN size % 7 = 3 THEN 'react' WHEN size % 7 = 4 THEN 'x/node_modules/y' WHEN size % 7 = 5 THEN '...deep.mod' ELSE 'os.path' END AS s FROM files)"
DIR = lambda p: f"(CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '.' END)"


@R.add(
    "x12_import_targets",
    sql(
        f"""SELECT path, s AS source, CASE WHEN s = './x.y' THEN {DIR('path')} || '/x/y' || e WHEN starts_with(s, '...') THEN {DIR(DIR(DIR('path')))} || '/deep/mod' || e WHEN starts_with(s, '..') THEN {DIR(DIR('path'))} || '/' || substr(s, 3) || e
WHEN contains(s, 'node_modules') THEN NULL WHEN s = 'src.parser.walker' AND list_contains(string_split({DIR('path')}, '/'), 'src') THEN CASE WHEN starts_with(path, 'src/') THEN '' ELSE regexp_extract(path, '^(.*?/)src/', 1) END || 'src/parser/walker' || e ELSE string_split(s, '.')[1] END AS target
FROM (SELECT *, regexp_extract(path, '(\\.[^./]*)$', 1) AS e FROM spec)""",
        SPECS,
    ),
)
def x12(s: S, d: str) -> D:
    k = F.col("size") % 7
    stem = F.regexp_replace(ids.basename("path"), r"\..*$", "")
    spec = F.when(k == 0, "./x.y").when(k == 1, F.concat(F.lit(".."), stem)).when(k == 2, "src.parser.walker").when(k == 3, "react").when(k == 4, "x/node_modules/y").when(k == 5, "...deep.mod").otherwise("os.path")
    return files(s, d).select("path", spec.alias("source")).withColumn("target", resolve.import_target("path", "source"))


LINED = "le AS (SELECT id, fileId, kind, pos % 400 AS a, pos % 400 + length(name) * CASE WHEN kind = 'class' THEN 30 ELSE 2 END AS b FROM nodes WHERE fileId IS NOT NULL AND kind <> 'file')"


@R.add("x16_class_members", sql("SELECT c.fileId, c.id AS class, m.id AS member FROM le c JOIN le m ON m.fileId = c.fileId AND m.a >= c.a AND m.b <= c.b AND m.id <> c.id WHERE c.kind = 'class' AND m.kind IN ('function', 'method', 'arrow')", LINED))
def x16(s: S, d: str) -> D:
    a = F.col("pos") % 400
    n = nodes(s, d).where("fileId is not null and kind <> 'file'")
    lined = n.select("id", "fileId", "kind", a.alias("startLine"), (a + F.length("name") * F.when(F.col("kind") == "class", 30).otherwise(2)).alias("endLine"))
    return resolve.class_members(lined)


@R.add(
    "j8_innermost_span",
    sql("SELECT p.fileId, p.o AS \"offset\", arg_min(s.id, (s.b - s.a, -s.a, s.id)) AS name FROM (SELECT DISTINCT fileId, a + 3 AS o FROM le) p LEFT JOIN le s ON s.fileId = p.fileId AND p.o >= s.a AND p.o < s.b GROUP BY p.fileId, p.o", LINED),
)
def j8(s: S, d: str) -> D:
    a = F.col("pos") % 400
    n = nodes(s, d).where("fileId is not null and kind <> 'file'")
    spans = n.select("fileId", F.col("id").alias("name"), a.alias("start"), (a + F.length("name") * F.when(F.col("kind") == "class", 30).otherwise(2)).alias("end"))
    return resolve.innermost(spans.select("fileId", (F.col("start") + 3).alias("offset")), spans)


# ---- review ----------------------------------------------------------------------------------------------------------


def _sources(s: S, d: str) -> D:
    return table(s, d, "documents").where("path is not null and text is not null").select(F.col("path").alias("fileId"), "text")


READ = ["budget", "handler", "schema", "node", "severity", "payload"]
OBJECTS, PAYLOADS = ("hit", "x"), ["string", "number", "usize"]
READS = "(" + ", ".join(f"'{x}'" for x in READ) + ")"


@R.add("r6_ambient_reads", f"SELECT DISTINCT fileId, name FROM (SELECT path AS fileId, unnest(regexp_extract_all(text, '\\b(?:hit|x)\\.([A-Za-z_$][\\w$]*)', 1)) AS name FROM documents WHERE path IS NOT NULL AND text IS NOT NULL) WHERE name IN {READS}")
def r6(s: S, d: str) -> D:
    return scanners.ambient(_sources(s, d), READ, OBJECTS)


@R.add("r10_payload_owners", "SELECT type, count(*) AS files FROM (SELECT DISTINCT path, unnest(regexp_extract_all(text, '[\\w$]+\\s*:\\s*(string|number|usize)\\b', 1)) AS type FROM documents WHERE path IS NOT NULL AND text IS NOT NULL) GROUP BY type HAVING count(*) >= 2")
def r10(s: S, d: str) -> D:
    return scanners.payload_owners(_sources(s, d), PAYLOADS)


@R.add(
    "r11_unregistered",
    "SELECT DISTINCT name FROM (SELECT unnest(regexp_extract_all(text, 'function (\\w+)', 1)) AS name FROM documents WHERE path IS NOT NULL) WHERE name NOT IN (SELECT unnest(regexp_extract_all(text, '= (\\w+)\\(', 1)) FROM documents WHERE path IS NOT NULL AND text IS NOT NULL)",
)
def r11(s: S, d: str) -> D:
    return scanners.unregistered(_sources(s, d), r"function (\w+)", r"= (\w+)\(")


@R.add("r5_text_signals")
def r5(s: S, d: str) -> D:
    """Lifecycle, transport and wide declarations over all source texts; the lexer follows braces, so tests pin them."""
    return scanners.text_signals(scanners.text_events(_sources(s, d)))


@R.add("r7_dom_sources")
def r7(s: S, d: str) -> D:
    """The first read from the page in each text, by the lexer's events; tests pin it."""
    return scanners.dom_sources(scanners.text_events(_sources(s, d)))


@R.add("r1_registry")
def r1(s: S, d: str) -> D:
    """The review items; a fixed table, so there is no table to check it against."""
    return review.registry(s)


def _findings(s: S, d: str) -> D:
    g = graph_of(s, d)
    e = staged(graph.without_barrels(g.imports).select("source", "target"))
    cycles = scc.cyclic_components(e).groupBy("scc").agg(F.array_sort(F.collect_set("id")).alias("files")).select(F.lit("cycles").alias("query"), F.col("scc").alias("ref"), F.lit("import cycle").alias("note"), "files", F.lit(True).alias("keep"))
    c = entities(s, d)
    cl = clones.exact_clones(c)
    members = c.where(F.col("tokenCount") >= clones.MIN_TOKENS).join(cl, "normalizedHash").groupBy("normalizedHash").agg(F.collect_set("fileId").alias("files"), F.first("members").alias("members"), F.first("severity").alias("severity"))
    dup = members.select(F.lit("clones").alias("query"), F.col("normalizedHash").alias("ref"), "severity", "files", ((F.col("members") >= 3) | (F.size("files") > 1)).alias("keep")).withColumnRenamed("severity", "note")
    w, doors = _width(s, d)
    wide = metrics.calibrated(metrics.with_inbound(w, doors)).select(F.lit("interface-width").alias("query"), F.col("module").alias("ref"), F.col("scope").alias("note"), F.array("module").alias("files"), (F.col("severity") != "low").alias("keep"))
    return cycles.unionByName(dup).unionByName(wide)


def _signals(docs: D) -> D:
    """(query, ref, note) of all scanners, over the objects and types of r6 and r10."""
    row = lambda df, query, ref, note: df.select(F.lit(query).alias("query"), F.col(ref).alias("ref"), note.alias("note"))
    events = staged(scanners.text_events(docs))
    out = scanners.text_signals(events).unionByName(row(scanners.ambient(docs, READ, OBJECTS), "ambient", "fileId", F.col("name")))
    out = out.unionByName(row(scanners.payload_owners(docs, PAYLOADS), "payload-owners", "type", F.concat("files", F.lit(" files"))))
    out = out.unionByName(row(scanners.dormant_routes(docs), "routes", "name", F.lit("not registered")))
    return out.unionByName(row(scanners.dom_sources(events), "dom-source", "fileId", F.col("snippet")))


@R.add("r2_checklist")
def r2(s: S, d: str) -> D:
    """The whole checklist of a review of the repository; checked in its parts and by unit tests."""
    docs = _sources(s, d)
    return review.recall(review.registry(s), _findings(s, d), _signals(docs))


@R.add("r14_unresolved", "SELECT id, place FROM (SELECT 'D' || x AS id, CAST(x - 1 AS INTEGER) AS place FROM range(2, 5) t(x)) WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = place AND r_regionkey % 2 = 0)")
def r14(s: S, d: str) -> D:
    """Of the items D1 to D4, judged by region rows with an even key, those left; D1 is region 0's."""
    reg = review.registry(s, "general").where("id like 'D_' and id <> 'DC'")
    sub = table(s, d, "region").select(F.concat(F.lit("D"), F.col("r_regionkey") + 1).alias("id"), F.when(F.col("r_regionkey") % 2 == 0, "non-issue").otherwise("not-yet-checked").alias("status"), F.col("r_regionkey").alias("n"))
    return review.unresolved(reg, sub)


# ---- listings --------------------------------------------------------------------------------------------------------

RULES = ["*.rs", "public/*", "dist", "walker.ts"]
IGN = "list_has_any(string_split(path, '/'), [" + ",".join(f"'{x}'" for x in source_files.manifest.IGNORED) + "]) OR path LIKE '%.rs' OR starts_with(path, 'public/') OR regexp_matches(path, '(^|/)(dist|walker\\.ts)$') OR starts_with(path, 'dist/')"


@R.add("s19_ignored", sql(f"SELECT path FROM files WHERE {IGN}"))
def s19(s: S, d: str) -> D:
    return files(s, d).where(source_files.is_ignored("path", RULES)).select("path")


@R.add("s20_work_tree", sql(f"SELECT path, 'file' AS type, CAST(greatest(1, ceil(size / 40)) AS BIGINT) AS lineCount FROM files WHERE NOT ({IGN}) UNION ALL SELECT DISTINCT unnest({q_ancestors('path')}), 'directory', NULL FROM files WHERE NOT ({IGN})"))
def s20(s: S, d: str) -> D:
    return source_files.work_tree(files(s, d), RULES).select("path", "type", "lineCount")


@R.add("s22_document_keys", sql("SELECT path, CASE WHEN regexp_extract(path, '[^/]*$') = 'README.md' THEN path ELSE regexp_replace(path, '\\.md$', '.html') END AS key FROM (SELECT path || '.md' AS path FROM files UNION ALL SELECT path || '/README.md' FROM files)"))
def s22(s: S, d: str) -> D:
    f = files(s, d)
    md = f.select(F.concat("path", F.lit(".md")).alias("path")).unionByName(f.select(F.concat("path", F.lit("/README.md")).alias("path")))
    return md.select("path", source_files.document_key("path").alias("key"))


PARS = "(" + ", ".join(f"'{x}'" for x in source_files.PARSABLE) + ")"


@R.add("s23_parsable", sql(f"SELECT path FROM files WHERE {EXT} IN {PARS} AND NOT regexp_matches(path, '(^|/)(\\.|node_modules(/|$))')"))
def s23(s: S, d: str) -> D:
    return source_files.parsable(files(s, d)).select("path")


@R.add("a17_unsupported", sql(f"SELECT ext, count(*) AS files FROM (SELECT CASE WHEN {EXT} IN ('.c', '.h', '.cc', '.cpp') THEN 'c family' ELSE {EXT} END AS ext FROM files WHERE {EXT} NOT IN ('.ts', '.tsx', '.js', '.jsx')) GROUP BY ext"))
def a17(s: S, d: str) -> D:
    """Files no compiler is at hand for, by extension, the C family as one."""
    e = ids.extension("path")
    f = files(s, d).where(~e.isin(".ts", ".tsx", ".js", ".jsx"))
    return f.groupBy(F.when(e.isin(".c", ".h", ".cc", ".cpp"), "c family").otherwise(e).alias("ext")).agg(F.count(F.lit(1)).alias("files"))


# ---- change streams --------------------------------------------------------------------------------------------------


def _events(s: S, d: str) -> D:
    return table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("src/u"), F.col("user_id") % 10, F.lit("/user"), "user_id", F.lit(".ts")).alias("path"), F.col("event_type").alias("action"), "event_id")


EV = "ev AS (SELECT ts, 'src/u' || (user_id % 10) || '/user' || user_id || '.ts' AS path, event_type AS action, event_id FROM events), fl AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS f FROM ev WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)), ses AS (SELECT *, sum(f) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM fl)"


@R.add("t1_debounced", f"WITH {EV} SELECT path, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + 600000000 AS ended, count(*) AS events FROM ses GROUP BY path, n")
def t1(s: S, d: str) -> D:
    return watch.debounced(_events(s, d), "10 minutes", ["path"]).select("path", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "events")


@R.add("t2_last_action", f"WITH {EV} SELECT path, epoch_us(min(ts)) AS started, arg_max(action, (ts, event_id)) AS action FROM ses GROUP BY path, n")
def t2(s: S, d: str) -> D:
    return watch.last_action(_events(s, d), "10 minutes", ["ts", "event_id"]).select("path", F.unix_micros("started").alias("started"), "action")


@R.add("t3_net_state", f"WITH {EV} SELECT path, arg_max(action, (ts, event_id)) AS action FROM ev GROUP BY path")
def t3(s: S, d: str) -> D:
    return watch.net_state(_events(s, d), ["ts", "event_id"])


@R.add("t3_stream_state", f"WITH {EV} SELECT path, arg_max(action, (ts, event_id)) AS action FROM ev GROUP BY path")
def t3s(s: S, d: str) -> D:
    """The same net state, kept by a stream over the events' file."""
    import uuid

    schema = table(s, d, "events").schema
    at = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    raw = s.readStream.schema(schema).parquet(os.path.realpath(f"{d}") + "/events.parquet*")
    ev = raw.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("src/u"), F.col("user_id") % 10, F.lit("/user"), "user_id", F.lit(".ts")).alias("path"), F.col("event_type").alias("action"), "event_id")
    watch.upsert_stream(ev, f"{at}/state", f"{at}/checkpoint", ["ts", "event_id"]).awaitTermination()
    return watch.read_state(s, f"{at}/state")


# ---- health gate -----------------------------------------------------------------------------------------------------


@R.add("f21_gates", sql("SELECT (SELECT count(*) FROM deg WHERE ca + ce >= 8) > 0 AS hub, (SELECT count(*) FROM (" + EXACT + ")) > 0 AS clone, (SELECT count(*) FROM cal WHERE note = 'shallow-wide') > 0 AS width", HUBS + "," + WIDTH))
def f21(s: S, d: str) -> D:
    g = graph_of(s, d)
    hub = metrics.hubs(g.file_imports).agg((F.count(F.lit(1)) > 0).alias("hub"))
    clone = clones.exact_clones(entities(s, d)).agg((F.count(F.lit(1)) > 0).alias("clone"))
    w, doors = _width(s, d)
    width = metrics.calibrated(metrics.with_inbound(w, doors)).agg((F.count(F.when(F.col("severity") == "medium", 1)) > 0).alias("width"))
    return hub.crossJoin(clone).crossJoin(width)


@R.add("j13_smells", sql(f"SELECT id, string_agg(smell, ' ' ORDER BY smell) AS smells FROM (SELECT id, 'hub:' || label AS smell FROM ({HUB_ROWS}) UNION ALL SELECT module, 'width:' || note FROM cal WHERE note IS NOT NULL) WHERE id IN (SELECT id FROM inodes) GROUP BY id", HUBS + "," + WIDTH))
def j13(s: S, d: str) -> D:
    g = graph_of(s, d)
    hub = metrics.hubs(g.file_imports).select("id", F.concat(F.lit("hub:"), "label").alias("smell"))
    w, doors = _width(s, d)
    wide = metrics.calibrated(metrics.with_inbound(w, doors)).where("note is not null").select(F.col("module").alias("id"), F.concat(F.lit("width:"), "note").alias("smell"))
    rows = hub.unionByName(wide).join(g.nodes.select("id"), "id", "left_semi")
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("smell")), " ").alias("smells"))


@R.add("w6_colour_ranks", sql(f"SELECT id, dense_rank() OVER (ORDER BY folder) - 1 AS folderRank, row_number() OVER (PARTITION BY folder ORDER BY id) - 1 AS nodeRank FROM (SELECT id, CASE WHEN contains(id, '/') THEN {q_folder('id')} ELSE 'misc' END AS folder FROM inodes)"), folderRank="INTEGER", nodeRank="INTEGER")
def w6(s: S, d: str) -> D:
    """Each node's folder rank and its rank in the folder; folders are ranked range by range."""
    from pyspark.sql import Window

    n = graph_of(s, d).nodes.select("id", F.when(F.instr("id", "/") > 0, ids.folder("id")).otherwise("misc").alias("folder"))
    ranks = ranked(n.select("folder").distinct(), [F.col("folder")], "folderRank").withColumn("folderRank", (F.col("folderRank") - 1).cast("int"))
    return n.join(ranks, "folder").select("id", "folderRank", (F.row_number().over(Window.partitionBy("folder").orderBy("id")) - 1).alias("nodeRank"))


@R.add("w3_first_definition", sql("SELECT name, arg_min(id, (ord, id)) AS id FROM raw_nodes WHERE kind <> 'file' AND id IS NOT NULL GROUP BY name"))
def w3(s: S, d: str) -> D:
    n = raw_nodes(s, d).where("kind <> 'file' and id is not null")
    return n.groupBy("name").agg(F.min_by("id", F.struct("ord", "id")).alias("id"))


@R.add("j18_folder_graph_files", sql(f"SELECT {q_folder('path')} AS folder, count(*) AS files, count(i.id) AS inGraph FROM files LEFT JOIN inodes i ON i.id = files.path GROUP BY 1"))
def j18(s: S, d: str) -> D:
    g = graph_of(s, d).nodes.select(F.col("id").alias("path"), F.lit(1).alias("in"))
    return files(s, d).join(g, "path", "left").groupBy(ids.folder("path").alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.count("in").alias("inGraph"))


@R.add("u5_undefined_targets", sql(f"SELECT target AS id FROM edges WHERE kind = 'call' AND NOT {q_external('(' + q_file('target') + ')')} EXCEPT SELECT id FROM nodes"))
def u5(s: S, d: str) -> D:
    own = edges(s, d, "call").where(~ids.is_external(ids.file_part("target"))).select(F.col("target").alias("id"))
    return own.distinct().join(nodes(s, d).select("id"), "id", "left_anti")


@R.add("v8_viewer_folders", sql(f"SELECT folder, len(string_split(folder, '/')) - 1 AS depth, count(*) AS files FROM (SELECT unnest({q_ancestors('path')}) AS folder FROM files) GROUP BY folder"), depth="INTEGER")
def v8(s: S, d: str) -> D:
    f = files(s, d).select(F.explode(ids.ancestors("path")).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))
    return f.select("folder", (F.size(F.split("folder", "/")) - 1).alias("depth"), "files")


@R.add("v15_coverage_caveats", sql(f"SELECT path, decision FROM (SELECT path, CASE WHEN regexp_matches(lower(regexp_extract(path, '[^/]*$')), '\\.min\\.|\\.bundle\\.|\\.generated\\.|\\.d\\.ts$') THEN 'skipped-denylist' WHEN size > 524288 THEN 'skipped-size' WHEN {EXT} IN ({EXTS}) THEN CASE WHEN lines > 2000 THEN 'skipped-lines' ELSE 'parse' END ELSE 'unsupported' END AS decision FROM files) WHERE starts_with(decision, 'skipped')"))
def v15(s: S, d: str) -> D:
    from codeweft.operators import manifest

    return files(s, d).select("path", manifest.scan_decision("path", "size", "lines").alias("decision")).where(F.col("decision").startswith("skipped"))
