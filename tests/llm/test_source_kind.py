import random

from codeweft.llm import source_kind

FILE = "id string, label string, kind string, path string, language string, size long, lines long, mtimeMs double, f string"
ENT = "id string, fileId string, normalizedHash string, tokenCount long, literalHashes array<string>"


def tables(spark, n=400):
    random.seed(9)
    verbs, nouns = ["read", "merge", "scan", "plan", "emit", "fold"], ["Graph", "Edge", "Node", "Folder", "Report", "Token", "Cache"]
    files, ents, truth = [], [], {}

    def add(path, kind, k, size, lines, names, tokens):
        files.append((path, "", "file", path, "typescript", size, lines, 0.0, "clash"))
        truth[path] = kind
        for name, t in zip(names, tokens):
            ents.append((f"{path}::{name}", path, "h", t, None))

    for i in range(n):
        names = list({random.choice(verbs) + random.choice(nouns) + random.choice(nouns) for _ in range(random.randrange(1, 6))})
        where = random.choice(["src", "src", "src", "tests", "tools"])
        add(f"packages/p{i % 9}/{where}/hand{i}.ts", "hand", i, 3000, 100, names, [random.randrange(20, 400) for _ in names])
    for i in range(n // 4):
        noted = i % 2 == 0
        k = random.randrange(20, 40)
        add(f"packages/p{i % 9}/src/g{i}{'.generated' if noted else ''}.ts", "generated", i, 4000, 130, [f"getXField{j:03}" for j in range(k)], [50] * k)
        k = random.randrange(2, 9)
        add(f"packages/p{i % 9}/src/m{i}{'.min' if noted else ''}.js", "minified", i, 90000, 2, ["a", "b", "ca", "d", "e", "f", "g", "h"][:k], [9000] * k)
    # copies of libraries look like the rest, but often lack entities, and are not in the language of the package
    for i in range(90):
        names = ["readEdge", "mergeNode"] if i % 3 else []
        where = f"third_party/lib{'abcdef'[i % 6]}" if i % 5 else f"src/area{i % 2}/lib{'abcdef'[i % 6]}-1.{i}.0"
        add(f"packages/p{i % 9}/{where}/v{i}.rs", "vendored", i, 3000, 100, names, [100] * len(names))
    return spark.createDataFrame(files + files[:5], FILE), spark.createDataFrame(ents + ents[:5], ENT), truth


def test_finds_unnoticed_files(spark):
    files, ents, truth = tables(spark)
    rows = source_kind.judged(files, ents).collect()
    got = {r["id"]: r["handwritten"] for r in rows}
    assert len(got) == len(truth) and all(r["handwritten"] == (r["probability"] < source_kind.THRESHOLD) for r in rows)
    wrong = [p for p, k in truth.items() if got[p] != (k == "hand")]
    assert len(wrong) <= 0.01 * len(truth), wrong[:10]


def test_held_out(spark):
    files, ents, truth = tables(spark)
    got = {r["kind"]: r for r in source_kind.held_out(files, ents).collect()}
    assert set(got) == {"hand", "generated", "minified", "vendored"} and got["generated"]["files"] == sum(".generated" in p for p in truth)
    assert all(got[k]["found"] >= 0.9 * got[k]["files"] for k in ("generated", "minified", "vendored")) and got["hand"]["found"] <= 0.02 * got["hand"]["files"]


def test_name_parts(spark):
    path = spark.createDataFrame([("packages/x/src/cindr-v1.2.3/My_file12.min.d.ts",), ("packages/x/a.ts",), ("a.ts",), ("",)], "p string")
    got = [set(r[0]) for r in path.select(source_kind.name_parts(path["p"])).collect()]
    assert got == [{"d:src", "d:cindr", "f:my", "l:file#", "m:min", "m:d"}, {"w:a"}, {"w:a"}, {"w:"}]


def test_notices():
    import re

    yes = {"vendored": ["a/node_modules/x/i.js", "a/lib/foo-1.2.3/b.ts", "a/src/_vendor/x.py", "a/ThirdParty/x.h"], "minified": ["a/x.min.js", "a/x.MIN.js", "web/chunk-ca118205.js"], "generated": ["a/x_pb2.py", "a/__generated__/x.ts", "a/zz_generated_x.ts", "a/x.pb.cc"], "data": ["a/x.dat.js"]}
    rules = {"vendored": (source_kind.VENDOR_NOTICE, source_kind.VERSION_NOTICE), "minified": (source_kind.MINIFIED_NOTICE,), "generated": (source_kind.GENERATED_NOTICE,), "data": (source_kind.DATA_NOTICE,)}
    for kind, paths in yes.items():
        for p in paths:
            assert any(re.search(x, p) for x in rules[kind]), p
    for p in ["a/src/vendor-portal/x.ts", "a/src/codegen/x.ts", "a/src/generate_x.ts", "a/src/regenerator.js", "a/src/bundle_size.ts", "a/src/minimap/x.ts", "a/src/x.min-width.ts", "a/src/distance/x.ts", "a/src/libs/x.ts"]:
        assert not any(re.search(x, p) for xs in rules.values() for x in xs), p


def test_nulls_and_empty(spark):
    files, ents, _ = tables(spark, 40)
    odd = spark.createDataFrame([(None, "", "file", None, None, None, None, None, ""), ("packages/x/src/unknown.ts", None, None, None, None, None, None, None, None)], FILE)
    got = {r["id"] for r in source_kind.judged(files.unionByName(odd), ents.unionByName(spark.createDataFrame([(None, None, None, None, None), ("packages/x/src/unknown.ts::f", "packages/x/src/unknown.ts", None, None, None)], ENT))).collect()}
    assert "packages/x/src/unknown.ts" in got and None not in got
    assert source_kind.judged(files.limit(0), ents).count() == 0
    alone = source_kind.judged(files.where("id like '%/src/hand%'"), ents.limit(0)).collect()
    assert alone and all(r["probability"] is None and r["handwritten"] for r in alone)
    bare = source_kind.judged(files, ents.limit(0)).collect()
    assert len(bare) == files.select("id").distinct().count() and all(r["probability"] is not None for r in bare)
