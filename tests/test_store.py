import pytest
from pyspark.sql import functions as F

from codeweft.operators import store

NODE = "id string, name string, kind string, fileId string, callGraph string, ord long"
EDGE = "source string, target string, kind string, typeOnly boolean, ord long"


def test_last_node_and_first_edge_win(spark, rows):
    n = spark.createDataFrame([("a", "old", "file", "a", None, 1), ("b", "b", "file", "b", None, 2), ("a", "new", "file", "a", None, 3), (None, "x", "file", "x", None, 4)], NODE)
    assert rows(store.upsert_nodes(n), "id", "name", "pos") == [("a", "new", 1), ("b", "b", 2)]
    e = spark.createDataFrame([("a", "b", "import", True, 1), ("a", "b", "import", False, 2), ("a", "b", "call", None, 3), ("a", None, "import", None, 4), ("a", "c", "import", None, 5)], EDGE)
    assert rows(store.first_edges(e, "import"), "source", "target", "typeOnly") == [("a", "b", True), ("a", "c", False)]


def test_removals(spark, rows):
    n = spark.createDataFrame([("s/a.ts", "", "file", "s/a.ts", None, 1), ("s/ab.ts", "", "file", "s/ab.ts", None, 2), ("n", "", "class", None, None, 3)], NODE)
    e = spark.createDataFrame([("s/a.ts::f", "x", "call", None, 1), ("y", "s/a.ts::f", "call", None, 2), ("s/ab.ts", "y", "import", None, 3)], EDGE)
    kn, ke = store.remove_file(n, e, "s/a.ts")
    assert rows(kn, "id") == [("n",), ("s/ab.ts",)] and rows(ke, "ord") == [(3,)]
    kn, ke = store.remove_folder(n, e, "s/a.ts")
    assert rows(kn, "id") == [("n",), ("s/ab.ts",)] and rows(ke, "ord") == [(2,), (3,)]
    kn, ke = store.remove_folder(n, e, "s")
    assert rows(kn, "id") == [("n",)] and rows(ke, "ord") == [(2,)]


def test_versions_and_transactions(spark, tmp_path, rows):
    es = store.EdgeStore(spark, f"file://{tmp_path}/store")
    n, e = es.load()
    assert n.count() == e.count() == 0
    nodes = spark.createDataFrame([("a", "a", "file", "a", None, 1)], NODE)
    es.save(nodes, spark.createDataFrame([], EDGE))
    es.transaction(lambda n, e: (n.unionByName(n.select(F.lit("b").alias("id"), "name", "kind", "fileId", "callGraph")), e))
    assert rows(es.load()[0], "id") == [("a",), ("b",)] and len(es.versions()) == 2
    with pytest.raises(ZeroDivisionError):
        es.transaction(lambda n, e: 1 / 0)
    assert len(es.versions()) == 2 and es.load()[0].count() == 2


def test_replace_files(spark, rows):
    n = spark.createDataFrame([("f", "f", "file", "f", None), ("g", "g", "file", "g", None), ("f::x", "x", "function", "f", None)], "id string, name string, kind string, fileId string, callGraph string")
    e = spark.createDataFrame([("f", "g", "import", False), ("g", "f", "import", False), ("g", "h", "import", False)], "source string, target string, kind string, typeOnly boolean")
    changed = spark.createDataFrame([("f",)], "path string")
    a, b = store.replace_files(n, e, changed, n.where("id = 'f'"), e.limit(0))
    assert rows(a, "id") == [("f",), ("g",)] and rows(b, "source", "target") == [("g", "h")]


def test_two_writers_lose_nothing(spark, tmp_path, rows):
    one, two = (store.EdgeStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    add = lambda name: lambda n, e: (n.unionByName(spark.createDataFrame([(name, name, "file", name, None)], store.NODE)), e)
    one.transaction(add("a"))
    raced = []

    def slow(n, e):
        if not raced:
            raced.append(two.transaction(add("b")))
        return add("c")(n, e)

    one.transaction(slow)
    assert rows(one.load()[0], "id") == [("a",), ("b",), ("c",)] and one.versions() == two.versions() == ["00000000", "00000001", "00000002"]
    n, e = one.load()
    with pytest.raises(store.Conflict):
        two.save(n, e, base="00000000")
    assert len(one.versions()) == 3 and rows(one.load()[0], "id") == rows(n, "id")


def test_other_stores(spark, tmp_path, rows):
    c = store.CloneStore(spark, f"file://{tmp_path}/clones", tolerant=True)
    assert c.load()[0].count() == 0
    c.save(spark.createDataFrame([("a", "b", "clone", "high", "exact-body")], store.CloneStore.TABLES["edges"]))
    assert rows(c.load()[0], "source", "severity") == [("a", "high")]
    (tmp_path / "clones" / "00000001.done").write_text("nowhere")
    assert c.load()[0].count() == 0
    with pytest.raises(Exception, match="nowhere"):
        store.CloneStore(spark, f"file://{tmp_path}/clones").load()[0].count()
    cache = store.AnalysisCache(spark, f"file://{tmp_path}/cache")
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    entry = spark.createDataFrame([("a", "1", "a::f", "h", 30, ["str:x"]), ("b", "2", None, None, None, None)], store.AnalysisCache.TABLES["entities"])
    assert cache.missing(files).count() == 2
    cache.update(files, entry)
    assert cache.missing(files).count() == 0
    now = spark.createDataFrame([("a", "1"), ("b", "3")], "path string, hash string")
    assert rows(cache.missing(now)) == [("b", "3")]
    cache.update(now, entry.limit(0))
    assert rows(cache.load()[0], "fileId", "id") == [("a", "a::f")]
