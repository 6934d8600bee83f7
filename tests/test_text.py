import json

import pytest
from pyspark.sql import functions as F

from codeweft.functions import bodies
from codeweft.operators import review, scanners, store
from codeweft.plans import text_queries
from codeweft.sources import extract, files, resolve
from codeweft.streaming import watch

PY = '''import os.path
import numpy as np
from . import sib
from ..pkg.mod import thing as alias, other
from x import *

def top(a):
    inner(a).strip()
    def nested():
        hidden()
    return Klass()

@deco
async def _private():
    pass

class Klass(Base):
    def method(self):
        self.help()
    if True:
        def conditional(self): pass
'''


def test_python():
    _, a, error = extract.extract("p/a.py", PY)
    assert error is None
    assert [(e["name"], e["kind"], e["exported"]) for e in a.entities] == [("top", "function", True), ("_private", "function", False), ("Klass", "class", True), ("Klass.method", "method", True)]
    assert [(c["name"], c["kind"]) for c in a.entities[0]["calls"]] == [("strip", "method"), ("inner", "function"), ("Klass", "new")]
    assert [(i["source"], [(n["name"], n["alias"]) for n in i["names"]]) for i in a.imports] == [("os.path", [("os.path", "os")]), ("numpy", [("numpy", "np")]), (".", [("sib", None)]), ("..pkg.mod", [("thing", "alias"), ("other", None)]), ("x", [("*", None)])]
    assert extract.extract("bad.py", "def (")[2].startswith("SyntaxError") and extract.extract("x.md", "text")[0] is None


TS = '''import def, { a as b, type T } from './m';
import type { U } from "../u";
import { type V, type W } from 'w';
import * as ns from 'ns';
// import { no } from 'comment';
export class Klass<T> extends Base {
  private async method(x: number): Promise<void> { this.go(b(x)); if (x) { new Other(); } }
}
export function run(q: string): number { const s = "not a call()"; return helper(q); }
const arrow = (v) => { inner(v); };
function hidden() {}
export { hidden as shown };
'''


def test_typescript():
    _, a, _ = extract.extract("p/a.ts", TS)
    assert [(i["source"], i["typeOnly"], [(n["name"], n["alias"]) for n in i["names"]]) for i in a.imports] == [("./m", False, [("default", "def"), ("a", "b"), ("T", None)]), ("../u", True, [("U", None)]), ("w", True, [("V", None), ("W", None)]), ("ns", False, [("*", "ns")])]
    got = {e["name"]: (e["kind"], e["exported"], [c["name"] for c in e["calls"]]) for e in a.entities}
    assert got == {"Klass": ("class", True, []), "Klass.method": ("method", True, ["go", "b", "Other"]), "run": ("function", True, ["helper"]), "arrow": ("arrow", False, ["inner"]), "hidden": ("function", False, [])}
    assert set(a.exports) == {"Klass", "run", "shown"}


def test_other_languages():
    c = extract.cpp('#include "x.h"\nclass Foo {\n  int a;\n};\nint main(int n) {\n  return f(n);\n}\n', header=True)
    assert [(e["name"], e["kind"]) for e in c.entities] == [("Foo", "class"), ("main", "function")] and c.imports[0]["source"] == "x.h" and c.exports == ["Foo", "main"]
    r = extract.rust("use a::b::{c, d as e};\npub struct S;\nimpl S {\n  pub fn go(&self) {}\n}\nfn free() {}\n")
    assert [(e["name"], e["kind"], e["exported"]) for e in r.entities] == [("S", "class", True), ("S.go", "method", True), ("free", "function", False)]
    assert extract.r('library(dplyr)\nsource("u.R")\nf <- function(x) {\n  x\n}\n').entities[0]["name"] == "f"


def test_edges_from_artifacts(spark, rows):
    src = spark.createDataFrame([("p/a.ts", "import { h as k } from './lib';\nexport function f() { k(); g(); z(); }\nfunction g() {}\n", 1), (None, "x", 1), ("p/b.ts", None, 1)], "path string, text string, imports int")
    arts = extract.artifacts(src)
    assert rows(resolve.call_edges_of(arts), "target") == [("p/a.ts::g",), ("p/a.ts::z",), ("p/lib.ts::h",)]
    assert {r["id"] for r in resolve.entity_nodes(arts).collect()} == {"p/a.ts", "p/a.ts::f", "p/a.ts::g"}


@pytest.mark.parametrize(
    ("file", "source", "want"),
    [("a/b/c.py", ".x", "a/b/x.py"), ("a/b/c.py", "..x.y", "a/x/y.py"), ("a/b/c.py", "...", "..py"), ("a/src/p/c.py", "src.q.r", "a/src/q/r.py"), ("src/c.py", "src.q", "src/q.py"), ("a/c.py", "os.path", "os"), ("a/c.ts", "x/node_modules/y", None)],
)
def test_import_targets(spark, file, source, want):
    got = spark.createDataFrame([(file, source)], "f string, s string").select(resolve.import_target("f", "s")).first()[0]
    assert got == want


def test_scan_store_and_json(spark, tmp_path, rows):
    root = tmp_path / "repo"
    for path, text in {"src/a.py": "from .b import go\n\ndef f():\n    go()\n", "src/b.py": "def go():\n    pass\n", "dist/x.js": "x", "src/env/pyvenv.cfg": "home = /usr", "src/env/c.py": "def no(): pass\n", "src/w.min.js": "x", "README.md": "# r"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    got = dict(rows(files.scan(spark, str(root)), "path", "decision"))
    assert got == {"src/a.py": "parse", "src/b.py": "parse", "src/w.min.js": "skipped-denylist", "README.md": "unsupported"}
    es = store.EdgeStore(spark, f"file://{tmp_path}/store")
    files.scan_into(es, str(root))
    n, e = es.load()
    assert rows(e, "source", "target", "kind") == [("src/a.py", "src/b.py", "import"), ("src/a.py::f", "src/b.py::go", "call")]
    out = str(tmp_path / "edges.json")
    files.export_edge_list(n, e, out, "2025-01-01T00:00:00Z")
    n2, e2 = files.read_edge_list(spark, out)
    assert rows(n2, "id") == rows(n, "id") and rows(e2, "source", "target") == rows(e, "source", "target")
    broken = json.loads(open(out).read()) | {"schemaVersion": 3}
    (tmp_path / "old.json").write_text(json.dumps(broken))
    with pytest.raises(files.SchemaMismatch):
        files.read_edge_list(spark, str(tmp_path / "old.json"))
    files.write_report(e, str(tmp_path / "report"), "Edges")
    assert (tmp_path / "report.md").read_text().startswith("# Edges")


def test_ignore_and_documents(spark, rows):
    assert files.ignore_rules("# c\n\nout/\n!keep\n*.log\n") == ["out", "*.log"]
    f = spark.createDataFrame([("a/x.log", 1), ("a/y.ts", 1), ("tmp/z.ts", 100), ("node_modules/q.ts", 1), ("d.csv", 1)], "path string, size long")
    assert rows(f.where(~files.is_ignored("path", ["*.log", "tmp/*"])), "path") == [("a/y.ts",)]
    docs = spark.createDataFrame([("docs/README.md",), ("docs/src/a/README.md",), ("docs/src/b.md",)], "path string")
    assert rows(files.document_folders(docs, "docs")) == [(".",), ("src/a",)]


def test_blocks():
    t = "class P {\n  open() { a.on('x'); }\n  static async close(a: {b: 1}) { if (x) { y(); } }\n}\nfunction q() { return '}'; } // {\nconst f = () => { z(); };\nexport default interface I { a: 1 }\n"
    assert [b[0] for b in scanners.blocks_of(t)] == ["P.open", "P.close", "P", "q", "I"]
    name, a, b = next(x for x in scanners.blocks_of(t) if x[0] == "P")
    assert t[a:b].startswith("class P {") and t[a:b].endswith("}\n}")
    assert list(scanners.blocks_of("")) == [] and list(scanners.blocks_of("}}{{ class")) == [] and scanners.events_of("'unclosed { ` /*") == []


def test_scanners(spark, rows):
    a = "class P {\n  open() { a.on('x'); b.addEventListener('y', f); }\n  close() { a.off('x'); }\n}\nfunction q() { w.subscribe(z); unsubscribe(); }\nbus.watch(1); // bus.watch(2)\n"
    b = "function h(m: any) { window.postMessage(m); }\nfunction g(m) { x.onmessage = safeParse(m); }"
    wide = "interface W {\n" + "".join(f"  f{i}{'?' if i < 3 else ''}: {{ a: 1, b: 2 }};\n" for i in range(5)) + "}\ntype N = { a: string }\nexport type L = {\n  readonly a: Map<string, number>,\n  'b': () => void\n  [k: string]: any; m(x: 1): void; n<T>(y: T): T\n  o: 1; p: 2 }\n"
    src = spark.createDataFrame([("a", a), ("a", a), ("b", b), ("c", wide), ("d", "w.addEventListener('message', f)"), (None, a), ("e", None), ("f", "")], "fileId string, text string")
    ev = scanners.text_events(src)
    assert rows(scanners.listener_balance(ev)) == [("a", "P.open", 2, 0), ("a", None, 1, 0), ("d", None, 1, 0)]
    assert rows(scanners.transport_sinks(ev)) == [("b", "h", True, True), ("d", None, False, False)]
    assert rows(scanners.wide_declarations(ev)) == [("c", "L", 7, 0), ("c", "W", 5, 3)]
    got = rows(scanners.text_signals(ev))
    assert ("lifecycle", "a::P.open", "2 registered, 0 released") in got and ("transport", "b::h", "untyped=true checked=true") in got and ("interface-decl", "c:W", "5 members, 3 optional") in got and len(got) == 9


def test_recall_gates_and_cap(spark):
    reg = review.registry(spark)
    assert reg.count() == 65 and reg.where("ruleset = 'general'").count() == 34 and reg.where("recallQuery <> 'instruction'").count() == 13
    f = [("clones", f"c{i:02}", "n", ["src/a/x.ts"], i % 2 == 0) for i in range(40)] + [("cycles", "y", "n", ["src/b/y.ts::f"], True)]
    findings = spark.createDataFrame(f, "query string, ref string, note string, files array<string>, keep boolean")
    signals = spark.createDataFrame([("ambient", "s", "n"), ("ambient", "s", "n")], "query string, ref string, note string")
    got = {}
    for r in review.recall(reg, findings, signals, "src/a").collect():
        got.setdefault(r["item"], []).append(r)
    assert len(got["D1"]) == 15 and got["D1"][0]["total"] == 20 and got["DEP1"][0]["graphBlind"] and len(got["FB1"]) == 1 and len(got) == 65
    left = review.unresolved(review.registry(spark, "frontend"), spark.createDataFrame([("FD1", "non-issue", 1), ("FD2", "non-issue", 1), ("FD2", "open", 2)], "id string, status string, n int"))
    assert left.count() == 30


def test_stream_keeps_net_state_and_batches_may_repeat(spark, tmp_path, rows):
    src = tmp_path / "in"
    ev = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.concat(F.lit("p"), F.col("id") % 7).alias("path"), F.when(F.col("id") % 3 == 0, "removed").otherwise("changed").alias("action"), F.col("id").alias("event_id"))
    ev.where("id < 120").write.parquet(str(src / "a"))
    order = ["ts", "event_id"]
    run = lambda: watch.upsert_stream(spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true").parquet(str(src)), f"file://{tmp_path}/state", f"file://{tmp_path}/cp", order).awaitTermination()
    run()
    ev.where("id >= 120").write.parquet(str(src / "b"))
    run()
    assert rows(watch.read_state(spark, f"file://{tmp_path}/state")) == rows(watch.net_state(ev, order))
    bursts = watch.debounced(ev.withColumn("k", F.lit("s")), "2 minutes", ["k"]).collect()
    assert len(bursts) == 1 and bursts[0]["events"] == 200


def test_dom_sources_and_routes(spark, rows):
    src = spark.createDataFrame(
        [("a", "x.dataset.id; y.getAttribute('k')"), ("b", "q.querySelector('z').textContent + w.getAttribute('k')"), ("c", "none"), ("d", "type PageView = 'one' | 'two';\nregisterView('one')")], "fileId string, text string"
    )
    assert rows(scanners.dom_sources(scanners.text_events(src))) == [("a", ".dataset.id"), ("b", "querySelector('z').textContent")]
    assert rows(scanners.dormant_routes(src)) == [("two",)]
    assert review.missing_notes(spark.createDataFrame([("D1", "issue-validated", " "), ("D2", "issue-validated", "why"), ("D3", "non-issue", None)], "id string, status string, note string")).count() == 1


def test_every_text_of_a_path_is_parsed(spark, tmp_path, rows):
    a, b = "import { h } from './lib';\nexport function f() { h(); }\n", "function g() { h(); }\n"
    spark.createDataFrame([("p/a.ts", a), ("p/a.ts", b), ("p/a.ts", b), ("p/b.py", "def ("), ("p/b.py", "x = 1")], "path string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    at = str(tmp_path)
    assert rows(text_queries.x1(spark, at), "path", "name") == [("p/a.ts", "f"), ("p/a.ts", "g")]
    assert rows(text_queries.x5(spark, at), "language", "files", "texts", "errors", "entities") == [("python", 1, 2, 1, 0), ("typescript", 1, 2, 0, 2)]
    assert rows(text_queries.x11(spark, at).where("kind <> 'file'"), "id") == [("p/a.ts::f",), ("p/a.ts::g",)]
    assert text_queries.x11(spark, at).where("kind = 'file' and id = 'p/a.ts'").select("textHash").distinct().count() == 2
    # the call of a text goes by the imports of that text
    assert rows(text_queries.x13(spark, at), "source", "target") == [("p/a.ts::f", "p/lib.ts::h"), ("p/a.ts::g", "p/a.ts::h")]


def test_checklist_has_every_scanner(spark, tmp_path, monkeypatch):
    docs = [("a.ts", "type AppRoute = 'one' | 'two';\nregister('one'); x.budget; let n: string;"), ("b.ts", "hit.schema; el.dataset.id; const m: string = '';")]
    spark.createDataFrame(docs, "path string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    none = spark.createDataFrame([], "query string, ref string, note string, files array<string>, keep boolean")
    monkeypatch.setattr(text_queries, "_findings", lambda s, d: none)
    got = {}
    for r in text_queries.r2(spark, str(tmp_path)).where("not graphBlind").collect():
        got.setdefault(r["item"], []).append((r["ref"], r["note"]))
    assert got["FR1"] == [("string", "2 files")] and got["FD2"] == [("two", "not registered")] and got["FV1"] == [("b.ts", ".dataset.id")]
    assert sorted(got["DEP3"]) == sorted(got["FB1"]) == [("a.ts", "budget"), ("b.ts", "schema")]


def test_parts_of_a_folder(spark, tmp_path, rows):
    root = tmp_path / "repo"
    put = lambda path, text: ((root / path).parent.mkdir(parents=True, exist_ok=True), (root / path).write_text(text))
    for path, text in {"src/a.py": "from .b import go\n\ndef f():\n    go()\n", "src/b.py": "def go():\n    pass\n", "src/in/c.py": "def h():\n    pass\n", "bad.py": "def (", "x.md": "# x"}.items():
        put(path, text)
    es, ms = store.EdgeStore(spark, f"file://{tmp_path}/store"), store.ManifestStore(spark, f"file://{tmp_path}/manifest")
    ids_ = lambda: [r[0] for r in rows(es.load()[0], "id")]
    files.scan_file(es, str(root), "src/in/c.py")
    assert ids_() == ["src/in/c.py", "src/in/c.py::h"]
    for bad in ("bad.py", "x.md", "none.py"):
        with pytest.raises(ValueError, match=bad):
            files.scan_file(es, str(root), bad)
    assert rows(files.scan_folder(es, str(root), "src"), "decision", "files") == [("parse", 2)]
    assert ids_() == ["src/a.py", "src/a.py::f", "src/b.py", "src/b.py::go", "src/in/c.py", "src/in/c.py::h"] and es.load()[1].count() == 2
    assert dict(rows(files.refresh(es, ms, str(root)), "path", "change")) == dict.fromkeys(["src/a.py", "src/b.py", "src/in/c.py", "bad.py", "x.md"], "new")
    put("src/b.py", "def go():\n    pass\n\ndef more():\n    pass\n")
    (root / "src/in/c.py").unlink()
    got = dict(rows(files.refresh(es, ms, str(root), "src"), "path", "change"))
    assert got == {"src/a.py": "unchanged", "src/b.py": "changed", "src/in/c.py": "deleted"} and "src/b.py::more" in ids_() and "src/in/c.py" not in ids_()
    assert sorted(r["path"] for r in ms.load()[0].collect()) == ["bad.py", "src/a.py", "src/b.py", "x.md"]
    watched = files.add_watched(es, spark.createDataFrame([("other.py",)], "path string"), str(root), "src")
    assert rows(watched) == [("other.py",), ("src/a.py",), ("src/b.py",)]
    assert rows(files.remove_watched(es, watched, "src")) == [("other.py",)] and not [i for i in ids_() if i.startswith("src")]
    old = tmp_path / "old.json"
    old.write_text('{"schemaVersion": 3, "resolverVersion": "x", "timestamp": "t", "nodes": [], "edges": []}')
    assert "src/b.py::more" in [r["id"] for r in files.load_or_rescan(es, str(root), str(old))[0].collect()]


def test_bodies(spark):
    a, b = 'function f(){const x = 1; return g(x) + h(2, "a");} // c', "function q(){const y = 2; /* no */ return g(y) + h(7, `z`);}"
    df = spark.createDataFrame([(a,), (b,), (None,), ("",), ("x" * 200000 + " '" + "y" * 200000 + "'",)], "body string")
    got = {r["body"]: r for r in bodies.entity_hashes(df).collect()}
    assert got[a]["normalizedHash"] == got[b]["normalizedHash"] and got[a]["tokenCount"] == 24 == got[b]["tokenCount"]
    assert got[None]["normalizedHash"] is None and got[None]["literalHashes"] == [] and got[""]["tokenCount"] == 0
    form = lambda t: spark.createDataFrame([(t,)], "b string").select(bodies.normalized_body("b").alias("n")).first()["n"]["text"]
    assert form("x.replace(/a[/]\\/b/g, '//no')") == "$ID . $ID ( $LIT , $LIT )" and form("a / b / c") == "$ID / $ID / $ID" and form("type T = A | null;") == "type $ID = $ID | null ;"


@pytest.mark.parametrize(
    ("body", "want"),
    [("const c = 'a'; const arr = ['only'];", []), ("m = ['.git', \"x\\n\", [1, 2]];", [("arr", ".git,x\n,[1,2]")]), ("return p.replace(/\\\\/g, '/');", [("re", "/\\\\/g")]), ("n = 12 / 3; y = x[i] + `t${x}` + `p1`", [("num", "12"), ("str", "p1")]), ("// 'no'\n/* 'no' */ 'yes'", [("str", "yes")]), ("", [])],
)
def test_literal_payloads(body, want):
    assert bodies.literal_payloads(body) == want
