import itertools
import random

import numpy as np

from codeweft.llm import setjoin


def make(spark, data, values="array<string>"):
    return spark.createDataFrame(data, f"id string, vals {values}, cls string, key long")


def brute(sets, t):
    out = set()
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if len(x & y) / len(x | y) >= t:
            out.add((a, b))
    return out


def test_depth_reaches_the_target():
    d = setjoin.base_depth(0.7)
    assert 1 - (1 - 0.7**d) ** setjoin.TREES >= setjoin.TARGET_RECALL > 1 - (1 - 0.7 ** (d + 1)) ** setjoin.TREES


def test_against_brute_force_with_hot_elements(spark, monkeypatch):
    random.seed(5)
    sets = {}
    for i in range(400):
        base = [f"e{random.randrange(3000)}" for _ in range(random.randrange(4, 14))] + ["hot"] * (i % 3 == 0)
        sets[f"r{i:03}"] = set(base)
        if i % 4 == 0:
            near = set(base)
            for _ in range(random.randrange(0, 3)):
                near ^= {random.choice(base), f"n{random.randrange(100)}"}
            sets[f"s{i:03}"] = near
    sets = {k: v for k, v in sets.items() if len(v) >= 4}
    df = make(spark, [(k, [*v, None, next(iter(v))], "clash", 1) for k, v in sets.items()])
    recs = setjoin.record_sets(df, "id", "vals", 0, 4)
    want = brute(sets, 0.7)
    assert {tuple(r) for r in setjoin.expanded(setjoin.similar_sets(recs, 0.7)).collect()} == want
    links = {r["id"]: r["links"] for r in setjoin.link_counts(setjoin.similar_sets(recs, 0.7)).collect()}
    assert links == {k: sum(k in p for p in want) for k in sets}
    # tiny neighbourhoods force deeper levels, blocks and the exact rest
    monkeypatch.setattr(setjoin, "MAX_NEIGHBOURS", 2)
    assert {tuple(r) for r in setjoin.expanded(setjoin.similar_sets(recs, 0.7)).collect()} == want


def test_pass_over_sorted_rows_in_pieces_of_any_size(monkeypatch):
    """Every pair of rows with a common prefix meets once, or its neighbourhood is resolved deeper; cut anywhere."""
    rng = np.random.default_rng(3)
    n = 900
    key = np.sort(rng.integers(0, 40, n) ** 2 // 60)
    parts = np.stack([rng.integers(0, 3, n) for _ in range(3)])
    deep = (parts[0] - 1 << 48) | (parts[1] << 32) | (parts[2] << 16) | 7
    order = np.lexsort((deep, key))
    key, deep, cls = key[order].astype(np.int64), deep[order].astype(np.int64), np.arange(n, dtype=np.int64)
    monkeypatch.setattr(setjoin, "MAX_NEIGHBOURS", 12)

    def run(cuts):
        t, out = setjoin.Tree(0.7, 12), []
        for a, b in itertools.pairwise([0, *cuts, n]):
            out += t.feed(key[a:b], deep[a:b], cls[a:b])
        out += t.feed(*(np.empty(0, np.int64),) * 3, last=True)
        return sorted(map(tuple, np.concatenate(out, axis=1).T.tolist()))

    want = run([])
    assert run(range(1, n)) == want and run(range(7, n, 7)) == want and run([250, 251, 600]) == want
    pairs = [r[1:3] for r in want if r[0] == setjoin.PAIR]
    assert len(pairs) == len(set(pairs)) and {r[0] for r in want} == {0, 1, 2}
    prefix = lambda i, d: (key[i], *(deep[i] >> (16 * (4 - k)) for k in range(1, d + 1)))
    level = {r[1]: r[2] for r in want if r[0] == setjoin.RESOLVED}
    crowd = {r[2]: r[1] for r in want if r[0] == setjoin.CROWD}
    expect = set()
    for i in range(n):
        for j in range(i + 1, n):
            d = level.get(i, 0)
            if d == level.get(j, 0) and prefix(i, d) == prefix(j, d) and i not in crowd:
                expect.add((i, j))
    assert set(pairs) == expect and all(level[i] == 3 for i in crowd)


def test_nulls_empty_repeats_and_sides(spark):
    a = make(spark, [("x", ["1", "2", "3", "4", None, "1"], "", 0), ("x", ["5"], "", 0), ("y", ["1", "2", "3", "4", "5"], "", 0), ("n", None, "", 0), ("e", [], "", 0), ("few", ["1", "2", "3"], "", 0), (None, ["1", "2", "3", "4", "5"], "", 0), ("z", [None, None], "", 0)])
    b = make(spark, [("s", ["5", "4", "3", "2", "1"], "", 0), ("t", ["1", "2", "3", "4", "5"], "", 0), ("x", ["1", "2", "3", "4"], "", 0)])
    recs = setjoin.record_sets(a, "id", "vals", 0, 4).unionByName(setjoin.record_sets(b, "id", "vals", 1, 4))
    got = {tuple(r) for r in setjoin.expanded(setjoin.similar_sets(recs, 0.7), 1).collect()}
    assert got == {("x", "y"), ("s", "x"), ("s", "y"), ("t", "x"), ("t", "y")} | {("x", "y")}
    assert setjoin.expanded(setjoin.similar_sets(recs.limit(0), 0.7)).count() == 0


def test_long_sets(spark):
    big = [str(i) for i in range(20000)]
    df = make(spark, [("a", big, "", 0), ("b", big[:15000], "", 0), ("c", big[:13000], "", 0)])
    got = {tuple(r) for r in setjoin.expanded(setjoin.similar_sets(setjoin.record_sets(df, "id", "vals", 0, 4), 0.7)).collect()}
    assert got == {("a", "b"), ("b", "c")}
