"""Registered queries against their SQL on the smallest tables, where those are at hand."""

import glob
import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CHECKED = [
    "m2_first_edges", "m4_remove_folder", "f1_scan_decisions", "f10_watched_graph", "g1_import_graph", "g4_cyclic_components", "g8_import_cycles", "a1_hub_metrics", "a3_interface_width", "a7_width_severity", "a9_folder_edges",
    "a10_folder_tree", "a12_shared_literals", "g13_bubbled_status", "t7_diff_manifest", "x12_import_targets", "t2_last_action", "p3_found", "p4_fan_in", "p5_orphans", "o6_capped_candidates",
]


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return int(v) if type(v).__name__ == "Decimal" and v == int(v) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    r = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    want = Counter(tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in r.fetchall())
    assert sorted(names) == sorted(df.columns) and got == want


def test_register():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 150
    for name, f in q.items():
        assert name in s or f.__doc__ or name.startswith(("p", "x")), f"{name} has neither SQL nor a reason"


def test_entry(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    assert entry.entry(spark).count() > 0
