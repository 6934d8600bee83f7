import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweft.functions import ids
from codeweft.operators import graph, scc
from codeweft.session import staged


def edge_frame(spark, pairs, type_only=()):
    return spark.createDataFrame([(a, b, (a, b) in type_only) for a, b in pairs], "source string, target string, typeOnly boolean")


def members(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["scc"], []).append(r["id"])
    return sorted(sorted(v) for v in out.values())


@pytest.mark.parametrize(
    ("pairs", "want"),
    [
        ([("a", "b"), ("b", "c")], []),
        ([("a", "b"), ("b", "a")], [["a", "b"]]),
        ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], [["a", "b", "c"]]),
        ([("a", "a")], [["a"]]),
        ([("z", "y"), ("y", "z"), ("n", "m"), ("m", "n")], [["m", "n"], ["y", "z"]]),
        ([], []),
    ],
)
def test_pins(spark, pairs, want):
    e = edge_frame(spark, pairs)
    assert members(scc.cyclic_components(e)) == want
    assert members(scc.cyclic_components(e, max_local_edges=0)) == want


def brute(pairs):
    reach = {a: {a} for p in pairs for a in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            for r in reach.values():
                if a in r and b not in r:
                    r.add(b)
                    changed = True
    return {n: min(m for m in reach if m in reach[n] and n in reach[m]) for n in reach}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), max_size=16))
def test_local_components(pairs):
    assert scc.local_components(pairs) == brute(pairs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef")), min_size=1, max_size=14))
def test_local_cycle_is_the_least_shortest(pairs):
    root = min(a for p in pairs for a in p)
    best, level = [], [[root]]
    for _ in range(7):
        level = [[*p, b] for p in level for a, b in set(pairs) if a == p[-1] and (b == root or b not in p)]
        done = sorted(p for p in level if p[-1] == root)
        if done:
            best = done[0]
            break
        level = [p for p in level if p[-1] != root]
    assert scc.local_cycle(pairs, root) == best


def test_distributed_paths_agree_with_local(spark):
    random.seed(11)
    nodes = [f"n{i:02}" for i in range(30)]
    pairs = [tuple(random.sample(nodes, 2)) for _ in range(55)] + [("n03", "n03")]
    e = edge_frame(spark, pairs)
    local, far = scc.cyclic_components(e), scc.cyclic_components(e, max_local_edges=3)
    assert members(local) == members(far)
    c = staged(local)
    near = {r["scc"]: r["path"] for r in scc.shortest_cycles(e, c).collect()}
    assert near == {r["scc"]: r["path"] for r in scc.shortest_cycles(e, c, max_local_edges=0).collect()}


def test_type_only_split(spark):
    e = edge_frame(spark, [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")], {("a", "b")})
    got = {r["scc"]: r for r in scc.import_cycles(e).collect()}
    assert got["a"]["runtimeMembers"] == [] and got["a"]["typeOnlyEdgeCount"] == 1 and got["a"]["totalEdgeCount"] == 2
    assert got["c"]["runtimeMembers"] == ["c", "d"] and got["c"]["path"] == ["c", "d", "c"]
    kinds = {r["scc"]: (r["kind"], r["severity"]) for r in scc.call_cycles(edge_frame(spark, [("f", "f"), ("g", "h"), ("h", "g")])).collect()}
    assert kinds == {"f": ("recursion", "low"), "g": ("call-cycle", "medium")}


NODE = "id string, name string, kind string, fileId string, callGraph string"
EDGE = "source string, target string, kind string, typeOnly boolean, ord long"


def test_dangling_and_repair(spark, rows):
    n = spark.createDataFrame([("p/a.py", "a", "file", "p/a.py", None), ("p/m/__init__.py", "i", "file", "p/m/__init__.py", None), ("p/a.py::f", "f", "function", "p/a.py", "heuristic"), ("p/a.py::g", "g", "function", "p/a.py", "none")], NODE)
    e = spark.createDataFrame(
        [("p/a.py", "p/m.py", "import", False, 1), ("p/a.py", "p/m/__init__.py", "import", True, 2), ("p/a.py", "gone/x.py", "import", False, 3), ("p/a.py", "os", "import", False, 4), ("lost.py", "p/a.py", "import", False, 5), ("p/a.py::f", "p/a.py::g", "call", False, 6), ("p/a.py::f", "p/a.py::f", "call", False, 7)],
        EDGE,
    )
    g = graph.build(n, e)
    assert rows(g.imports, "source", "target", "typeOnly") == [("p/a.py", "os", False), ("p/a.py", "p/m/__init__.py", False), ("p/a.py", "p/m/__init__.py", True)]
    assert rows(g.calls) == [("p/a.py::f", "p/a.py::f")]
    assert rows(g.nodes) == [("os", "external"), ("p/a.py", "file"), ("p/m/__init__.py", "file")]
    watched = spark.createDataFrame([("p/a.py",)], "path string")
    assert rows(graph.build(n, e, watched).imports, "target") == [("os",)]


def test_ids(spark):
    df = spark.createDataFrame([(x,) for x in ("react", "a.ts", ".ts", "p/x", "f.R", "a::b::c", "main.py", "node:fs", "")], "id string")
    got = {r[0]: (r[1], r[2], r[3]) for r in df.select("id", ids.is_external("id"), ids.file_part("id"), ids.name_part("id")).collect()}
    assert got["react"][0] and got[".ts"][0] and got["node:fs"][0] and not got["a.ts"][0] and not got["f.R"][0] and not got["p/x"][0]
    assert got["a::b::c"] == (False, "a", "b::c")
    up = spark.createDataFrame([("a/b/c.ts",), ("r.ts",)], "id string").select(ids.ancestors("id")).collect()
    assert [r[0] for r in up] == [["a", "a/b"], []]
