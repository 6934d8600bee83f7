import pytest
from pyspark.sql import functions as F

from codeweft.operators import clones, folders, manifest, metrics


def imports(spark, pairs):
    return spark.createDataFrame([(a, b, False) for a, b in pairs], "source string, target string, typeOnly boolean")


@pytest.mark.parametrize(("ca", "ce", "label", "instability"), [(8, 0, "kernel", 0.0), (1, 8, "unstable-hub", 8 / 9), (3, 5, "unstable-hub", 0.625), (6, 2, "kernel", 0.25)])
def test_hubs(spark, ca, ce, label, instability):
    e = imports(spark, [(f"i{k}", "h") for k in range(ca)] + [("h", f"o{k}") for k in range(ce)] * 2)
    r = metrics.hubs(e).collect()
    assert [(x["id"], x["ca"], x["ce"], x["label"]) for x in r] == [("h", ca, ce, label)] and r[0]["instability"] == pytest.approx(instability)


def test_degree_seven_is_no_hub(spark):
    assert metrics.hubs(imports(spark, [(f"i{k}", "h") for k in range(7)])).count() == 0
    assert metrics.max_fan_in(imports(spark, [])).first()[0] == 0


ENT = "id string, name string, kind string, fileId string, callGraph string"


def width(spark, pairs, files, ents=(), calls=()):
    e = imports(spark, pairs)
    f = spark.createDataFrame([(x,) for x in files], "id string")
    n = spark.createDataFrame(list(ents), ENT)
    c = spark.createDataFrame(list(calls), "source string, target string")
    return {(r["scope"], r["module"]): r for r in metrics.interface_width(f, e, n, c).collect()}


def test_width_one_door_and_even_doors(spark):
    outer = [f"q/o{k}.ts" for k in range(8)]
    one = width(spark, [(o, "p/a.ts") for o in outer], ["p/a.ts", *outer])
    assert one["file", "p/a.ts"]["w"] == 1 and one["folder", "p"]["wEff"] == 1.0 and one["file", "p/a.ts"]["isBarrel"]
    even = width(spark, [(o, f"p/a{k}.ts") for k, o in enumerate(outer)], [f"p/a{k}.ts" for k in range(8)] + outer)
    assert even["folder", "p"]["w"] == 8 and even["folder", "p"]["wEff"] == 8.0 and even["folder", "p"]["treeDepth"] == 0


def test_functions_count_callers_of_other_files_only(spark):
    ents = [("a::f", "f", "function", "a", "semantic"), ("a::g", "g", "function", "a", "semantic"), ("b::h", "h", "function", "b", "semantic")]
    w = width(spark, [], ["a", "b"], ents, [("a::g", "a::f"), ("b::h", "a::f"), ("a::f", "a::g")])
    assert w["function", "a::f"]["w"] == 1 and ("function", "a::g") not in w and w["file", "a"]["moduleDepth"] == 2


@pytest.mark.parametrize(("x", "want"), [([], 0), ([5], 5), ([3] * 5, 3), (list(range(1, 11)), 9.1), ([1, 2, 3], 2.8), (list(range(1, 101)), 90.1), ([1, 10], 9.1), ([10, 1, 5, 3, 7], 8.8)])
def test_ninth_decile(spark, x, want):
    df = spark.createDataFrame([(v,) for v in x], "weight long")
    assert folders.weight_p90(df).first()[0] == pytest.approx(want)


def test_folder_edges_and_tree(spark, rows):
    i = imports(spark, [("a/x.ts", "b/y.ts")] * 3 + [("a/x.ts", "a/z.ts"), ("a/x.ts", "react"), ("r.ts", "a/x.ts")])
    ents = spark.createDataFrame([("a/x.ts::f", "f", "function", "a/x.ts", "semantic"), ("b/y.ts::g", "g", "function", "b/y.ts", "semantic")], ENT)
    calls = spark.createDataFrame([("a/x.ts::f", "b/y.ts::g")], "source string, target string")
    assert rows(folders.folder_edges(i, calls, ents)) == [(".", "a", "import", 1), ("a", "b", "call", 1), ("a", "b", "import", 3)]
    files = spark.createDataFrame([("a/b/x.ts", 10), ("a/y.ts", None), ("r.ts", 3), ("react", 5)], "id string, loc long")
    docs = spark.createDataFrame([("a/b",)], "path string")
    got = {r["path"]: (r["parent"], r["depth"], r["fileCount"], r["totalLOC"], r["documented"]) for r in folders.folder_tree(files, docs).collect()}
    assert got == {"": (None, 0, 3, 13, False), ".": ("", 1, 1, 3, False), "a": ("", 1, 2, 10, False), "a/b": ("a", 2, 1, 10, True)}


def test_status_bubbles(spark, rows):
    s = spark.createDataFrame([(".", "current"), ("a", "current"), ("a/b", "outdated"), ("c", "never")], "folder string, status string")
    assert rows(folders.bubbled_status(s)) == [(".", "never"), ("a", "outdated"), ("a/b", "outdated"), ("c", "never")]


def test_clones(spark):
    rows = [("src/a/x.ts::f", "src/a/x.ts", "h1", 30, ["str:1"]), ("src/b/y.ts::f", "src/b/y.ts", "h1", 30, ["str:1", "str:1", None]), ("src/a/x.ts::g", "src/a/x.ts", "h2", 30, []), ("src/a/x.ts::h", "src/a/x.ts", "h2", 30, None), ("t", "src/c.ts", "h3", 19, None), ("u", "src/d.ts", "h3", 19, None)]
    rows += [("src/m/p.ts::f", "src/m/p.ts", "h4", 25, None), ("tests/p.test.ts::f", "tests/p.test.ts", "h4", 25, None)]
    e = spark.createDataFrame(rows, "id string, fileId string, normalizedHash string, tokenCount long, literalHashes array<string>")
    got = {r["normalizedHash"]: (r["members"], r["severity"]) for r in clones.exact_clones(e).collect()}
    assert got == {"h1": (2, "high"), "h2": (2, "low"), "h4": (2, "low")}
    lit = clones.shared_literals(e).collect()
    assert [(r["literal"], r["members"], r["sharedKind"], r["severity"]) for r in lit] == [("str:1", 2, "string", "high")]
    chain = clones.chain_edges(e.where("normalizedHash = 'h1'"), "normalizedHash", "exact-body").collect()
    assert [(r["source"], r["target"]) for r in chain] == [("src/a/x.ts::f", "src/b/y.ts::f")]


def test_manifest_diff_and_gates(spark, rows):
    m = "path string, mtimeMs double, size long, hash string"
    old = spark.createDataFrame([("src/a", 1.0, 1, "h"), ("src/ab/x", 1.0, 1, "h"), ("src/a/same", 1.0, 1, None), ("src/a/touched", 1.0, 1, "h"), ("src/a/size", 1.0, 1, "h"), ("src/a/nohash", 1.0, 1, None), ("src/a/gone", 1.0, 1, "h")], m)
    new = spark.createDataFrame([("src/a", 1.0, 1, "h"), ("src/a/same", 1.0, 1, "z"), ("src/a/touched", 2.0, 1, "h"), ("src/a/size", 1.0, 2, "k"), ("src/a/nohash", 2.0, 1, "h"), ("src/a/new", 1.0, 1, "h")], m)
    got = dict(rows(manifest.diff_manifest(old, new, "src/a")))
    assert got == {"src/a": "unchanged", "src/a/same": "unchanged", "src/a/touched": "unchanged", "src/a/size": "changed", "src/a/nohash": "changed", "src/a/gone": "deleted", "src/a/new": "new"}
    f = spark.createDataFrame([("x.min.js", 1, 1), ("a.ts", 512 * 1024, 2000), ("b.ts", 512 * 1024 + 1, 1), ("c.ts", 1, 2001), ("d.md", 1, 1), ("types.d.ts", 1, 1)], "path string, size long, lines long")
    got = dict(rows(f.select("path", manifest.scan_decision("path", "size", "lines"))))
    assert got == {"x.min.js": "skipped-denylist", "a.ts": "parse", "b.ts": "skipped-size", "c.ts": "skipped-lines", "d.md": "unsupported", "types.d.ts": "skipped-denylist"}
    t = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",)], "text string").select(manifest.line_count("text")).collect()
    assert [r[0] for r in t] == [0, 1, 2, 2]


def test_calibration_needs_eight_folders(spark):
    cols = "scope string, module string, treeDepth int, w long, wEff double, moduleDepth long, dmr double, isBarrel boolean, inbound long"
    make = lambda n: spark.createDataFrame([("folder", f"a/f{k}", 1, 5, 10.0 if k == 0 else 1.0, 1, 0.1 if k == 0 else 5.0, False, 9) for k in range(n)] + [("function", "f", 0, 1, 1.0, 1, 1.0, False, 9)], cols)
    got = {r["module"]: r["note"] for r in metrics.calibrated(make(8)).collect()}
    assert got["a/f0"] == "shallow-wide" and got["f"] == "wide-utility" and got["a/f1"] is None
    assert metrics.calibrated(make(7)).where(F.col("severity") == "medium").count() == 0
