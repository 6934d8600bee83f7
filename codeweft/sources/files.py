"""Files in and out: folder scans, edge-list JSON, ignore rules, document folders, and reports."""

from __future__ import annotations

import contextlib
import json
import os
import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import ids
from codeweft.operators import manifest, store
from codeweft.session import staged
from codeweft.sources import extract, resolve

# Extensions that a tree listing leaves out.
SKIPPED = [
    ".asar", ".exe", ".dll", ".so", ".dylib", ".bin", ".wasm", ".csv", ".json", ".xml", ".yaml", ".yml", ".db", ".sqlite", ".sqlite3",
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".webp", ".mp4", ".avi", ".mov", ".mp3", ".wav", ".zip", ".tar", ".gz", ".7z", ".rar", ".pdf", ".doc", ".docx", ".xls", ".xlsx",
]
# Extensions that a watch set takes.
PARSABLE = [".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".go", ".rs", ".cpp", ".c", ".h", ".hpp"]
# Files that mark their folder as an environment or a cache.
MARKERS = ["pyvenv.cfg", "CACHEDIR.TAG"]
BYTES_A_LINE = 40


class SchemaMismatch(ValueError):
    """An edge list of another schema or resolver version."""


def listing(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, mtimeMs, size[, content]) of all files below root, paths relative to it; without content no file is opened. The reader leaves out files without a byte."""
    base = os.path.abspath(root.removeprefix("file://")) if "://" not in root or root.startswith("file://") else root.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base.rstrip("/")) + "/", "")
    out = df.select(path.alias("path"), (F.unix_micros("modificationTime") / 1000).alias("mtimeMs"), F.col("length").alias("size"), "content")
    return out if content else out.drop("content")


def admitted(files: DataFrame) -> DataFrame:
    """files without those below ignored folders, by name or by a marker file in the folder."""
    marked = files.where(ids.basename("path").isin(MARKERS)).select(ids.folder("path").alias("__f")).distinct()
    rows = files.where(~manifest.in_ignored_folder("path"))
    up = rows.select("path", F.explode(ids.ancestors("path")).alias("__f")).join(marked, "__f", "left_semi").select("path").distinct()
    return rows.join(up, "path", "left_anti")


def scan(spark: SparkSession, root: str, below: str = "") -> DataFrame:
    """(path, size, mtimeMs, lines, hash, decision, text): each admitted file at or below a path with its scan decision; text only where it is parsed."""
    f = admitted(listing(spark, root, content=True))
    if below not in ("", "."):
        f = f.where(ids.under("path", below))
    text = F.decode("content", "UTF-8")
    f = f.withColumn("lines", F.when(ids.has_source_extension("path"), manifest.line_count(text)).cast("long"))
    f = f.withColumn("decision", manifest.scan_decision("path", "size", "lines"))
    return f.select("path", "size", "mtimeMs", "lines", F.sha2("content", 256).alias("hash"), "decision", F.when(F.col("decision") == "parse", text).alias("text"))


def coverage(scanned: DataFrame) -> DataFrame:
    """(decision, files, heuristic): what a scan took and left out."""
    return scanned.groupBy("decision").agg(F.count(F.lit(1)).alias("files"), F.bool_or(manifest.capability("path") == "heuristic").alias("heuristic"))


def _graph_of(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of what a scan parses."""
    arts = extract.artifacts(scanned.where("decision = 'parse'"))
    imports, calls = resolve.import_edges_of(arts), resolve.call_edges_of(arts)
    first = imports.groupBy("source", "target", "kind").agg(F.min_by("typeOnly", "ord").alias("typeOnly")).select("source", "target", "kind", "typeOnly")
    nodes = resolve.entity_nodes(arts)
    last = nodes.groupBy("id").agg(F.max(F.struct("name", "kind", "fileId", "callGraph")).alias("v")).select("id", "v.*")
    return last, first.unionByName(calls.distinct().withColumn("typeOnly", F.lit(False)))


def scan_into(es: store.EdgeStore, root: str) -> DataFrame:
    """Scans root, replaces the store with what it finds and returns the coverage."""
    scanned = scan(es.spark, root)
    es.save(*_graph_of(scanned))
    return coverage(scanned)


def _append(es: store.EdgeStore, scanned: DataFrame) -> DataFrame:
    nodes, edges = (staged(x) for x in _graph_of(scanned))
    # known nodes are written again, known edges stay as they are
    last = lambda old: nodes.withColumn("__n", F.lit(1)).unionByName(old.withColumn("__n", F.lit(0))).groupBy("id").agg(F.max_by(F.struct("name", "kind", "fileId", "callGraph"), "__n").alias("v")).select("id", "v.*")
    first = lambda old: old.unionByName(edges.join(old.select("source", "target", "kind"), ["source", "target", "kind"], "left_anti"))
    es.transaction(lambda n, e: (last(n), first(e)))
    return coverage(scanned)


def scan_folder(es: store.EdgeStore, root: str, folder: str) -> DataFrame:
    """Adds the files that lie in one folder of root, not those below it, to the store; gives their coverage."""
    scanned = scan(es.spark, root, below=folder).where(ids.folder("path") == folder)
    return _append(es, scanned)


def scan_file(es: store.EdgeStore, root: str, path: str) -> DataFrame:
    """Adds one file of root to the store; fails if it is not there, not admitted, or does not parse."""
    scanned = scan(es.spark, root, below=path).where(F.col("path") == path)
    got = scanned.select("decision").collect()
    if not got or got[0][0] != "parse":
        raise ValueError(f"{path}: {got[0][0] if got else 'not found'}")
    error = extract.artifacts(scanned).select("error").first()
    if error is None or error[0]:
        raise ValueError(f"{path}: {error[0] if error else 'no artifact'}")
    return _append(es, scanned)


def load_or_rescan(es: store.EdgeStore, root: str, edge_list: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an edge-list file; if that is of another version, the store after a full scan of root."""
    try:
        return read_edge_list(es.spark, edge_list)
    except SchemaMismatch:
        scan_into(es, root)
        return es.load()


def add_watched(es: store.EdgeStore, watched: DataFrame, root: str, folder: str) -> DataFrame:
    """The watch set with the parsable files below a folder, which are scanned into the store."""
    scanned = scan(es.spark, root, below=folder).where(ids.under("path", folder))
    _append(es, scanned)
    return store.watch_add(watched, parsable(scanned))


def remove_watched(es: store.EdgeStore, watched: DataFrame, folder: str) -> DataFrame:
    """The watch set without a folder, whose nodes and edges leave the store."""
    es.transaction(lambda n, e: store.remove_folder(n, e, folder))
    return store.watch_remove_folder(watched, folder)


def refresh(es: store.EdgeStore, manifest_store: store.ManifestStore, root: str, folder: str = "") -> DataFrame:
    """Brings the store up to date with the files below a folder and stores the new manifest; gives (path, change).

    Files that did not move in time or size keep their hash; of the others, changed and deleted ones are purged, new and changed ones parsed.
    """
    (old,) = manifest_store.load()
    stats = admitted(listing(es.spark, root)).where(ids.under("path", folder))
    moved = staged(manifest.moved(old, stats))
    scanned = staged(scan(es.spark, root).join(moved, "path", "left_semi"))
    rest = stats.join(scanned.select("path"), "path", "left_anti").join(old.select("path", "hash", "lines", "status"), "path", "left")
    current = staged(scanned.select("path", "mtimeMs", "size", "lines", F.col("decision").alias("status"), "hash").unionByName(rest.select("path", "mtimeMs", "size", "lines", "status", "hash")))
    changes = staged(manifest.diff_manifest(old, current, folder))
    changed = changes.where("change in ('changed', 'deleted')").select("path")
    nodes, edges = (staged(x) for x in _graph_of(scanned.join(changes.where("change in ('new', 'changed')"), "path", "left_semi")))
    es.transaction(lambda n, e: store.replace_files(n, e, changed, nodes, edges))
    manifest_store.transaction(lambda m: m.where(~ids.under("path", folder)).unionByName(current))
    return changes


ENVELOPE = "schemaVersion int, resolverVersion string, timestamp string, nodes array<struct<id:string,name:string,kind:string,fileId:string,callGraph:string>>, edges array<struct<source:string,target:string,kind:string,typeOnly:boolean>>"


def read_edge_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an edge-list JSON file; another version is refused, a broken file fails."""
    df = spark.read.schema(ENVELOPE).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    seen = [(r[0], r[1]) for r in df.select("schemaVersion", "resolverVersion").distinct().limit(10).collect()]
    if seen != [(store.SCHEMA_VERSION, store.RESOLVER_VERSION)]:
        raise SchemaMismatch(f"{path}: {seen}, wanted {(store.SCHEMA_VERSION, store.RESOLVER_VERSION)}")
    return df.select(F.inline("nodes")), df.select(F.inline("edges"))


@contextlib.contextmanager
def atomic_file(path: str):
    """A text file on this machine, written beside its place and renamed when all of it is there."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            yield f
        os.replace(tmp, path)
    except BaseException:
        os.unlink(tmp)
        raise


def write_json(path: str, value: object) -> None:
    """A small result as one JSON file."""
    with atomic_file(path) as f:
        json.dump(value, f, indent=2, sort_keys=True, ensure_ascii=False)


def export_edge_list(nodes: DataFrame, edges: DataFrame, path: str, timestamp: str) -> None:
    """The store as one edge-list JSON file, for other tools: rows are written as they come, one partition at a time, so none but the file grows with the store."""
    plain = lambda r: {k: v for k, v in r.asDict().items() if v is not None and v is not False}

    def lines(df: DataFrame, by: list[str]) -> Iterator[str]:
        for i, r in enumerate(df.orderBy(*by).toLocalIterator()):
            yield (",\n    " if i else "\n    ") + json.dumps(plain(r), sort_keys=True, ensure_ascii=False)

    with atomic_file(path) as f:
        head = {"schemaVersion": store.SCHEMA_VERSION, "resolverVersion": store.RESOLVER_VERSION, "timestamp": timestamp}
        f.write(json.dumps(head, indent=2)[:-2] + ',\n  "nodes": [')
        f.writelines(lines(nodes, ["id"]))
        f.write('],\n  "edges": [')
        f.writelines(lines(edges, ["source", "target"]))
        f.write("]\n}\n")


def ignore_rules(text: str) -> list[str]:
    """Patterns of an ignore file; comments, blanks and negations are left out."""
    lines = (x.strip() for x in text.split("\n"))
    return [x.removesuffix("/") for x in lines if x and not x.startswith(("#", "!"))]


def is_ignored(path: Column | str, rules: list[str]) -> Column:
    """A path is ignored by exact name, path prefix, *.ext or folder/*, or by its kind of file."""
    p = ids.col(path)
    name = ids.basename(p)
    out = ids.extension(name).isin(SKIPPED) | F.exists(F.split(p, "/"), lambda x: x.isin(manifest.IGNORED))
    for r in rules:
        out = out | (name == r) | (p == r) | p.startswith(r + "/")
        if r.startswith("*."):
            out = out | name.endswith(r[1:])
        if r.endswith("/*"):
            out = out | p.startswith(r[:-1])
    return out


def work_tree(files: DataFrame, rules: list[str]) -> DataFrame:
    """(path, parent, name, type, size, lineCount): shown files and their folders; a file's lines are estimated from its size."""
    f = files.where(~is_ignored("path", rules))
    lines = F.greatest(F.lit(1), F.ceil(F.col("size") / BYTES_A_LINE))
    shown = f.select("path", F.lit("file").alias("type"), "size", lines.cast("long").alias("lineCount"))
    dirs = f.select(F.explode(ids.ancestors("path")).alias("path")).distinct().select("path", F.lit("directory").alias("type"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("lineCount"))
    rows = shown.unionByName(dirs)
    return rows.select("path", F.when(F.instr("path", "/") > 0, ids.folder("path")).otherwise("").alias("parent"), ids.basename("path").alias("name"), "type", "size", "lineCount")


def tree_order(tree: DataFrame) -> DataFrame:
    """Folders first, then by name in the order of the Unicode collation."""
    return tree.orderBy("parent", "type", F.collate("name", "UNICODE"))


def parsable(files: DataFrame) -> DataFrame:
    """Files a watch set takes: known extension, no hidden or package folder on the way."""
    hidden = F.exists(F.split("path", "/"), lambda x: x.startswith(".") | (x == "node_modules"))
    return files.where(ids.extension(ids.basename("path")).isin(PARSABLE) & ~hidden)


def document_folders(files: DataFrame, root: str) -> DataFrame:
    """(path): source folders that have a README below the documents' root; '.' for the root itself."""
    inside = files.where(F.col("path").startswith(root.rstrip("/") + "/") & (ids.basename("path") == "README.md"))
    rel = F.substring("path", len(root.rstrip("/")) + 2, 1_000_000)
    return inside.select(ids.folder(rel).alias("path")).distinct()


def document_key(path: Column | str) -> Column:
    """README keeps its name, every other markdown file is kept as html."""
    p = ids.col(path)
    return F.when(ids.basename(p) == "README.md", p).otherwise(F.regexp_replace(p, r"\.md$", ".html"))


def write_report(df: DataFrame, stem: str, title: str, rows: int = 1000) -> None:
    """A small result as stem.json and stem.md. More rows than given are refused, not cut."""
    got = [r.asDict(recursive=True) for r in df.limit(rows + 1).collect()]
    if len(got) > rows:
        raise ValueError(f"the report has more than {rows} rows")
    write_json(f"{stem}.json", got)
    head = df.columns
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(r[c]) for c in head) + " |" for r in got)]
    with open(f"{stem}.md", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
