"""The identifier grammar as Column expressions: every join key depends on it.

A file id is a workspace-relative path with slashes; an entity id is ``fileId::name``, split at the first separator;
an external module has neither separator nor slash nor a known source extension.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "::"

# The languages and their source extensions.
LANGUAGES = [
    ("typescript", "TypeScript/JavaScript", [".ts", ".tsx", ".js", ".jsx"], "semantic"),
    ("python", "Python", [".py"], "heuristic"),
    ("cpp", "C/C++", [".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".hxx"], "none"),
    ("rust", "Rust", [".rs"], "none"),
    ("r", "R", [".r", ".R"], "none"),
]
SOURCE_EXTENSIONS = list(dict.fromkeys(e.lower() for _, _, exts, _ in LANGUAGES for e in exts))

# Basenames that only re-export their members.
BARRELS = ["index.ts", "index.tsx", "index.js", "index.jsx", "__init__.py", "__init__.pyi"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalised(c: Column | str) -> Column:
    """Every backslash read as a slash."""
    return F.translate(col(c), "\\", "/")


def entity_id(file_id: Column | str, name: Column | str) -> Column:
    return F.concat(col(file_id), F.lit(SEP), col(name))


def is_entity(c: Column | str) -> Column:
    return F.instr(col(c), SEP) > 0


def file_part(c: Column | str) -> Column:
    """The id up to the first separator; ids without one stay whole."""
    c = col(c)
    return F.when(is_entity(c), F.substring_index(c, SEP, 1)).otherwise(c)


def name_part(c: Column | str) -> Column:
    """What follows the first separator; null without one."""
    c = col(c)
    return F.when(is_entity(c), F.substring(c, F.instr(c, SEP) + 2, F.length(c)))


def basename(c: Column | str) -> Column:
    return F.substring_index(col(c), "/", -1)


def extension(c: Column | str) -> Column:
    """Lower-cased extension with its dot; empty without a dot or when the only dot leads the id."""
    return F.lower(F.regexp_extract(col(c), r"(?s)^.+(\.[^.]*)$", 1))


def has_source_extension(c: Column | str) -> Column:
    return extension(c).isin(SOURCE_EXTENSIONS)


def is_external(c: Column | str) -> Column:
    c = col(c)
    return ~is_entity(c) & (F.instr(c, "/") == 0) & ~has_source_extension(c)


def is_barrel(c: Column | str) -> Column:
    return basename(c).isin(BARRELS)


def folder(c: Column | str) -> Column:
    """Parent folder; a root file lies in '.'."""
    c = col(c)
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, r"/[^/]*$", "")).otherwise(F.lit("."))


def ancestors(c: Column | str) -> Column:
    """All folders above a file, outermost first; empty for a root file."""
    parts = F.split(col(c), "/")
    n = F.size(parts) - 1
    return F.when(
        n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    ).otherwise(F.array().cast("array<string>"))


def under(c: Column | str, prefix: str) -> Column:
    """Boundary-safe prefix test; '', '.' and '/' are the root."""
    c = col(c)
    p = prefix.strip("/")
    return F.lit(True) if p in ("", ".") else (c == p) | c.startswith(p + "/")
