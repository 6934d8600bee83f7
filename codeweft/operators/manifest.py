"""Scan admission and manifest comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions import ids

MAX_FILE_KB, MAX_FILE_LINES, LAZY_LINES, LINE_BUDGET = 512, 2000, 10_000, 350
# Names of derived files.
GENERATED = r"(?i)\.min\.|\.bundle\.|\.generated\.|\.d\.ts$"
# Folders no scan enters.
IGNORED = [
    ".git", ".hg", ".svn", ".idea", ".vscode", ".DS_Store", ".artifacts", ".arch", ".delegate", "node_modules", "dist", "out", "build", "coverage",
    ".next", ".nuxt", "__pycache__", ".venv", "venv", ".tox", ".pytest_cache", "target", "vendor", "bin", "obj",
]


def is_generated_name(c: Column | str) -> Column:
    return ids.basename(c).rlike(GENERATED)


def in_ignored_folder(c: Column | str) -> Column:
    parts = F.split(ids.col(c), "/")
    return F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.isin(IGNORED))


def capability(c: Column | str) -> Column:
    """semantic, heuristic or none, by extension."""
    out = F.lit("none")
    for _, _, exts, kind in ids.LANGUAGES:
        out = F.when(ids.extension(c).isin([e.lower() for e in exts]), kind).otherwise(out)
    return out


def language(c: Column | str) -> Column:
    out = F.lit("code")
    for name, _, exts, _ in ids.LANGUAGES:
        out = F.when(ids.extension(c).isin([e.lower() for e in exts]), name).otherwise(out)
    return F.when(ids.extension(c).isin(".js", ".jsx"), "javascript").otherwise(out)


def scan_decision(path: str, size: str, lines: str) -> Column:
    """Gates in order: derived name, size, then lines for what would be parsed. Limits themselves still pass; an unknown number passes its gate."""
    return (
        F.when(is_generated_name(path), "skipped-denylist").when(F.col(size) > MAX_FILE_KB * 1024, "skipped-size")
        .when(ids.has_source_extension(path), F.when(F.col(lines) > MAX_FILE_LINES, "skipped-lines").otherwise("parse")).otherwise("unsupported")
    )


def line_count(text: Column | str) -> Column:
    """0 for an empty text, else one more than its newlines."""
    t = ids.col(text)
    return F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"))) + 1)


def diff_manifest(old: DataFrame, new: DataFrame, prefix: str = "") -> DataFrame:
    """(path, change) under the prefix: new, changed, deleted or unchanged.

    A file with equal time and size is unchanged without a look at its hash; else it is changed unless both hashes are
    known and equal. old, new: path, mtimeMs, size, hash; one row per path.
    """
    o = old.where(ids.under("path", prefix)).select("path", *(F.col(c).alias(f"o_{c}") for c in ("mtimeMs", "size", "hash")), F.lit(True).alias("o"))
    n = new.where(ids.under("path", prefix)).select("path", *(F.col(c).alias(f"n_{c}") for c in ("mtimeMs", "size", "hash")), F.lit(True).alias("n"))
    same = (F.col("o_mtimeMs") == F.col("n_mtimeMs")) & (F.col("o_size") == F.col("n_size"))
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(same | (F.col("o_hash") == F.col("n_hash")), "unchanged").otherwise("changed")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))


def lazy(files: DataFrame) -> DataFrame:
    """One row: total lines, and whether the graph is populated with files only."""
    t = files.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    return t.withColumn("filesOnly", F.col("lines") > LAZY_LINES)


def folder_lines(files: DataFrame) -> DataFrame:
    """(folder, ext, files, lines): an empty file has one line here."""
    return files.groupBy(ids.folder("path").alias("folder"), ids.extension("path").alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.greatest(F.coalesce("lines", F.lit(0)), F.lit(1))).alias("lines"))


def over_budget(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.when(F.col("lines") > LINE_BUDGET, 1)).alias("filesOverBudget"))


def moved(old: DataFrame, stats: DataFrame) -> DataFrame:
    """(path) of files to hash: unknown ones and those whose time or size differs; the rest is unchanged without being read."""
    o = old.select("path", F.col("mtimeMs").alias("m"), F.col("size").alias("s"))
    return stats.join(o, "path", "left").where(F.col("m").isNull() | (F.col("mtimeMs") != F.col("m")) | (F.col("size") != F.col("s"))).select("path")


def refresh_plan(old: DataFrame, stats: DataFrame, folder: str) -> DataFrame:
    """(path, purge, rescan) for a folder whose files changed: changed and deleted files are purged, and the whole subtree is scanned again."""
    d = diff_manifest(old, stats, folder)
    return d.select("path", F.col("change").isin("changed", "deleted").alias("purge"), (F.col("change") != "deleted").alias("rescan"))


def merged_coverage(parts: DataFrame) -> DataFrame:
    """One row over (decision, files, heuristic) parts of several scans: counts summed, flags joined."""
    return parts.groupBy("decision").agg(F.sum("files").alias("files"), F.bool_or("heuristic").alias("heuristic"))
