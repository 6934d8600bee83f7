import datetime as dt

from codeweft.operators import orphans

T = [dt.datetime(2025, 1, d) for d in range(1, 29)]


def test_states_and_interval_ends(spark, rows):
    refs = spark.createDataFrame([("a", T[d], d, "x") for d in (0, 1, 2, 4, 5, 9)] + [("none", T[3], 90, "e"), (None, T[3], 91, "e"), ("a", None, 92, "e"), ("once", T[1], 93, "e"), ("once", T[1], 93, "e")], "key string, at timestamp, ord int, state string")
    parents = spark.createDataFrame(
        [("a", T[1], T[4]), ("a", T[1], T[4]), ("a", T[5], None), ("once", T[1], T[1]), (None, T[0], None), ("x", None, None), ("b", T[0], None)], "key string, opened timestamp, closed timestamp"
    )
    got = rows(orphans.merge_references(refs, parents, tasks=3), "key", "ord", "state")
    want = [("a", 0, "late"), ("a", 1, "found"), ("a", 2, "found"), ("a", 4, "deleted"), ("a", 5, "found"), ("a", 9, "found"), ("a", 92, "late"), ("none", 90, "missing"), ("once", 93, "missing"), ("once", 93, "missing")]
    assert got == sorted(want, key=str)
    assert "state_ref" in orphans.merge_references(refs, parents).columns


def test_empty_tables(spark):
    refs = spark.createDataFrame([("a", T[0], 1)], "key string, at timestamp, ord int")
    parents = spark.createDataFrame([("a", T[0], None)], "key string, opened timestamp, closed timestamp")
    assert orphans.merge_references(refs.limit(0), parents).count() == 0
    assert [r["state"] for r in orphans.merge_references(refs, parents.limit(0)).collect()] == ["missing"]


def test_hot_key_is_split_and_right(spark):
    refs = spark.range(4000).selectExpr("'hot' as key", "timestamp'2025-01-01' + make_interval(0, 0, 0, 0, id) as at", "id as ord")
    parents = spark.createDataFrame([("hot", dt.datetime(2025, 1, 3), dt.datetime(2025, 1, 10))], "key string, opened timestamp, closed timestamp")
    got = dict(orphans.merge_references(refs, parents, tasks=4).groupBy("state").count().collect())
    assert got == {"late": 48, "found": 7 * 24, "deleted": 4000 - 48 - 168}


def test_graph_rules(spark, rows):
    edge = "ord long, source string, target string, kind string, typeOnly boolean, scanned_at timestamp, loaded_at timestamp"
    node = "ord long, id string, name string, kind string, fileId string, callGraph string, scanned_at timestamp, deleted_at timestamp, loaded_at timestamp"
    t = lambda i, target: (i, "s", target, "import", None, T[10], T[11])
    edges = spark.createDataFrame([t(1, "p\\a.ts"), t(2, None), t(3, ""), t(4, "react"), t(5, "main.PY"), t(6, "p/m.py"), t(7, "p/z.py"), t(8, "p/a.ts::f"), t(9, ".ts")], edge)
    nodes = spark.createDataFrame(
        [(1, "p/a.ts", "a", "file", None, None, T[1], None, T[1]), (2, "p/m/__init__.py", "m", "file", "p\\m\\__init__.py", None, T[2], None, T[2]), (3, "p/a.ts::f", "f", "function", "p/a.ts", None, T[0], T[5], T[0]), (4, "p/g", "g", "class", "p/a.ts::f", None, T[3], None, T[3])],
        node,
    )
    shared = spark.createDataFrame([], "id string, name string, kind string, fileId string, callGraph string, scanned_at timestamp")
    got = rows(orphans.orphan_references(edges, nodes, shared), "ref_table", "period", "ord", "key", "state")
    assert got == [("edge_entry", "2025-01", 5, "main.PY", "missing"), ("edge_entry", "2025-01", 7, "p/z.py", "missing"), ("edge_entry", "2025-01", 8, "p/a.ts::f", "deleted"), ("node_entry", "2025-01", 3, "p/a.ts", "late"), ("node_entry", "2025-01", 4, "p/a.ts::f", "missing")]
