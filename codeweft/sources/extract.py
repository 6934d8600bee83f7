"""Source text to artifacts: imports, exports, entities and calls of a file, per language, without a compiler.

Python goes through its own syntax tree; the brace languages through a scanner that blanks comments and strings and follows
braces. Calls can't be typed here, so they are matched by name, and their call graph counts as heuristic.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = (
    "path string, language string, error string, "
    "imports array<struct<source:string,typeOnly:boolean,names:array<struct<name:string,alias:string>>,line:int>>, exports array<string>, "
    "entities array<struct<name:string,kind:string,exported:boolean,startLine:int,endLine:int,calls:array<struct<name:string,kind:string>>>>, "
    "textHash string"
)


@dataclass
class Artifact:
    imports: list[dict] = field(default_factory=list)
    exports: list[str] = field(default_factory=list)
    entities: list[dict] = field(default_factory=list)

    def add_import(self, source: str, names: list[tuple[str, str | None]], line: int, type_only: bool = False) -> None:
        self.imports.append({"source": source, "typeOnly": type_only, "names": [{"name": n, "alias": a} for n, a in names], "line": line})

    def add_entity(self, name: str, kind: str, exported: bool, start: int, end: int, calls: list[tuple[str, str]] = ()) -> None:
        self.entities.append({"name": name, "kind": kind, "exported": exported, "startLine": start, "endLine": end, "calls": [{"name": n, "kind": k} for n, k in calls]})


# ---- Python ----------------------------------------------------------------------------------------------------------


def _callee(f: ast.expr) -> str | None:
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def _python_calls(body: list[ast.stmt], classes: set[str]) -> list[tuple[str, str]]:
    out, todo = [], list(reversed(body))
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        if isinstance(node, ast.Call) and (name := _callee(node.func)):
            out.append((name, "new" if name in classes else "method" if isinstance(node.func, ast.Attribute) else "function"))
        todo.extend(reversed(list(ast.iter_child_nodes(node))))
    return out


def python(text: str) -> Artifact:
    """Top-level functions and classes and the methods directly in a class; names with a leading underscore are not exported."""
    tree, a = ast.parse(text), Artifact()
    classes = {n.name for n in tree.body if isinstance(n, ast.ClassDef)}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for n in node.names:
                a.add_import(n.name, [(n.name, n.asname or n.name.split(".")[0])], node.lineno)
        elif isinstance(node, ast.ImportFrom):
            a.add_import("." * node.level + (node.module or ""), [(n.name, n.asname) for n in node.names], node.lineno)
    a.imports.sort(key=lambda i: i["line"])
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a.add_entity(node.name, "function", node.name[0] != "_", node.lineno, node.end_lineno, _python_calls(node.body, classes))
        elif isinstance(node, ast.ClassDef):
            a.add_entity(node.name, "class", node.name[0] != "_", node.lineno, node.end_lineno)
            for m in node.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    a.add_entity(f"{node.name}.{m.name}", "method", m.name[0] != "_", m.lineno, m.end_lineno, _python_calls(m.body, classes))
    a.exports = [e["name"] for e in a.entities if e["exported"] and e["kind"] != "method"]
    return a


# ---- brace languages -------------------------------------------------------------------------------------------------

_noise = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
_call = re.compile(r"(\bnew\s+)?((?:[\w$]+\s*\.\s*)*)([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\(")
_no_call = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "super", "import", "constructor", "do", "else", "fn", "match", "sizeof"}


def blanked(text: str) -> str:
    """The text with comments and strings blanked, every offset and line break kept."""
    return _noise.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def block_end(code: str, start: int) -> int:
    """Offset past the brace block that opens at or after start; the end of the text if it never closes."""
    depth, i = 0, code.find("{", start)
    if i < 0:
        return len(code)
    for m in re.compile(r"[{}]").finditer(code, i):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def calls_in(code: str) -> list[tuple[str, str]]:
    return [(m[3], "new" if m[1] else "method" if m[2] else "function") for m in _call.finditer(code) if m[3] not in _no_call]


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


_ts_import = re.compile(r"^[ \t]*import\s+(type\s+)?(?:(?P<what>[^'\";]+?)\s+from\s+)?['\"](?P<src>[^'\"]+)['\"]", re.M)
_ts_entity = re.compile(
    r"^[ \t]*(?P<exp>export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:(?P<kind>(?:async\s+)?function\s*\*?|class)\s+(?P<name>[\w$]+)"
    r"|(?:const|let|var)\s+(?P<arrow>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=\n]+)?=>)",
    re.M,
)
_ts_method = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|abstract|readonly|async|get|set)\s+)*(?P<name>#?[\w$]+)\s*(?:<[^>\n]*>)?\([^)]*\)\s*(?::[^={;\n]+)?\{", re.M)
_ts_export = re.compile(r"^[ \t]*export\s*\{([^}]*)\}", re.M)


def _names(inner: str) -> list[tuple[str, str | None, bool]]:
    out = []
    for part in filter(None, map(str.strip, inner.split(","))):
        kind = part.startswith("type ")
        name, _, alias = part.removeprefix("type ").partition(" as ")
        out.append((name.strip(), alias.strip() or None, kind))
    return out


def typescript(text: str) -> Artifact:
    a, code = Artifact(), blanked(text)
    for m in _ts_import.finditer(text):
        if not code[m.start() : m.end()].strip().startswith("import"):
            continue
        what, names, types = (m["what"] or "").strip(), [], []
        if g := re.search(r"\{([^}]*)\}", what, re.S):
            for n, alias, t in _names(g[1]):
                names.append((n, alias))
                types.append(t)
        rest = re.sub(r"\{[^}]*\}", "", what).strip(" ,\n")
        for part in filter(None, map(str.strip, rest.split(","))):
            star = re.match(r"\*\s+as\s+([\w$]+)", part)
            names.insert(0, ("*", star[1]) if star else ("default", part))
            types.append(False)
        a.add_import(m["src"], names, _line(text, m.start()), bool(m[1]) or bool(types) and all(types))
    for m in _ts_entity.finditer(code):
        name, kind = m["name"] or m["arrow"], "arrow" if m["arrow"] else "class" if m["kind"] == "class" else "function"
        brace = code.find("{", m.end())
        stop = re.compile(r"[;\n]").search(code, m.end())
        bare = kind == "arrow" and (brace < 0 or stop and stop.start() < brace and code[m.end() : brace].strip())
        end = stop.end() if bare and stop else block_end(code, m.end())
        inside = code[m.end() : end]
        a.add_entity(name, kind, bool(m["exp"]), _line(code, m.start()), _line(code, max(m.start(), end - 1)), [] if kind == "class" else calls_in(inside[inside.find("{") + 1 :] if kind == "function" else inside))
        if m["exp"]:
            a.exports.append(name)
        if kind == "class":
            at, limit = code.find("{", m.end()) + 1, end
            while at and (mm := _ts_method.search(code, at, limit)):
                stop_at = block_end(code, mm.end() - 1)
                if mm["name"] not in _no_call or mm["name"] == "constructor":
                    a.add_entity(f"{name}.{mm['name']}", "method", bool(m["exp"]), _line(code, mm.start()), _line(code, stop_at - 1), calls_in(code[mm.end() : stop_at]))
                at = stop_at
    for m in _ts_export.finditer(code):
        a.exports += [alias or n for n, alias, _ in _names(m[1])]
    return a


_c_include = re.compile(r'^[ \t]*#[ \t]*include[ \t]*[<"]([^>"]+)[>"]', re.M)
_c_entity = re.compile(r"^(?:(?P<cls>class|struct)\s+(?P<cname>\w+)[^;{()]*\{|(?:[A-Za-z_][\w:<>,*&\s]*?[\s*&])(?P<fname>[A-Za-z_]\w*(?:::\w+)*)\s*\([^;{}()]*\)\s*(?:const\s*)?\{)", re.M)


def cpp(text: str, header: bool = False) -> Artifact:
    a, code = Artifact(), blanked(text)
    for m in _c_include.finditer(text):
        a.add_import(m[1], [], _line(text, m.start()))
    for m in _c_entity.finditer(code):
        name = m["cname"] or m["fname"]
        if name in _no_call:
            continue
        a.add_entity(name, "class" if m["cls"] else "function", header, _line(code, m.start()), _line(code, block_end(code, m.end() - 1) - 1))
    a.exports = [e["name"] for e in a.entities] if header else []
    return a


_rs_use = re.compile(r"^[ \t]*(?:pub\s+)?use\s+([^;]+);", re.M)
_rs_entity = re.compile(r"^(?P<in>[ \t]*)(?P<pub>pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?P<kind>fn|struct|impl)\b(?:<[^>]*>)?\s*(?:[\w:<>]+\s+for\s+)?(?P<name>\w+)", re.M)


def rust(text: str) -> Artifact:
    a, code, owner, until = Artifact(), blanked(text), None, 0
    for m in _rs_use.finditer(code):
        path = " ".join(m[1].split())
        last = path.rsplit("::", 1)[-1]
        names = [(n, al) for n, al, _ in _names(last.strip("{}"))] if last.startswith("{") else [(last.split(" as ")[0], last.split(" as ")[1] if " as " in last else None)]
        a.add_import(path.split("{")[0].rstrip(":").split(" as ")[0], names, _line(code, m.start()))
    for m in _rs_entity.finditer(code):
        if m["kind"] == "impl":
            owner, until = m["name"], block_end(code, m.end())
            continue
        semi, brace = code.find(";", m.end()), code.find("{", m.end())
        end = semi + 1 if 0 <= semi and (brace < 0 or semi < brace) else block_end(code, m.end())
        method = owner is not None and m.start() < until
        kind = "class" if m["kind"] == "struct" else "method" if method else "function"
        a.add_entity(f"{owner}.{m['name']}" if method and kind == "method" else m["name"], kind, bool(m["pub"]), _line(code, m.start()), _line(code, end - 1))
    a.exports = [e["name"] for e in a.entities if e["exported"]]
    return a


_r_import = re.compile(r"^[ \t]*(?:(?:library|require)\s*\(\s*[\"']?([\w.]+)[\"']?|source\s*\(\s*[\"']([^\"']+)[\"'])", re.M)
_r_entity = re.compile(r"^[ \t]*([\w.]+)\s*(?:<-|=)\s*function\s*\(", re.M)


def r(text: str) -> Artifact:
    a = Artifact()
    code = re.sub(r"#[^\n]*", lambda m: " " * len(m[0]), text)
    for m in _r_import.finditer(code):
        a.add_import(m[1] or m[2], [], _line(code, m.start()))
    for m in _r_entity.finditer(code):
        a.add_entity(m[1], "function", True, _line(code, m.start()), _line(code, max(m.start(), block_end(code, m.end()) - 1)))
    a.exports = [e["name"] for e in a.entities]
    return a


EXTRACTORS = {".py": python, ".ts": typescript, ".tsx": typescript, ".js": typescript, ".jsx": typescript, ".rs": rust, ".r": r} | dict.fromkeys([".c", ".cpp", ".cc", ".cxx"], cpp) | {e: lambda t: cpp(t, True) for e in (".h", ".hpp", ".hxx")}
NAMES = {".py": "python", ".rs": "rust", ".r": "r"} | dict.fromkeys([".ts", ".tsx", ".js", ".jsx"], "typescript") | dict.fromkeys([".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx"], "cpp")


def extract(path: str, text: str) -> tuple[str | None, Artifact, str | None]:
    """(language, artifact, error); a file that can't be parsed gives an empty artifact and its error."""
    dot = path.rfind(".")
    ext = path[dot:].lower() if dot > 0 else ""
    if ext not in EXTRACTORS:
        return None, Artifact(), None
    try:
        return NAMES[ext], EXTRACTORS[ext](text), None
    except (SyntaxError, ValueError, RecursionError) as e:
        return NAMES[ext], Artifact(), f"{type(e).__name__}: {e}"[:200]


def artifacts(sources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One artifact row per source file of a known language; null paths and texts are left out, errors are rows of their own.

    textHash, the text's md5, tells several texts of one path apart.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                language, a, error = extract(p, t)
                if language:
                    out.append({"path": p, "language": language, "error": error, "imports": a.imports, "exports": a.exports, "entities": a.entities, "textHash": hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return sources.select(F.col(path).alias("path"), F.col(text).alias("text")).where(F.col("path").isNotNull() & F.col("text").isNotNull()).mapInArrow(run, SCHEMA)
