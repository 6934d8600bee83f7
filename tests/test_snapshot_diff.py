import random

from pyspark.sql import functions as F

from codeweft.operators import snapshot_diff

SCHEMA = "g string, no int, k string, v string, w string, ord long"
ODD = "s string, __side int, at string, side string, w string, ord long"


def changes(spark, data, steps):
    s = snapshot_diff.snapshot_steps(spark.createDataFrame(steps, "g string, no int"), "g", "no")
    return snapshot_diff.snapshot_changes(spark.createDataFrame(data, SCHEMA), s, "g", "no", ["k"], ["v", "w"], F.col("ord"))


def test_labels_nulls_ties_and_gaps(spark, rows):
    data = [
        ("g", 1, "same", "x", None, 1), ("g", 1, "gone", "x", "y", 2), ("g", 1, "turns", "x", None, 3), ("g", 1, None, "x", "y", 4), (None, 1, "same", "x", "y", 5),
        ("g", 2, "ignored", "x", "y", 6), ("g", 4, "same", "x", None, 7), ("g", 4, "turns", None, None, 8), ("g", 4, "new", "", "", 9), ("g", 4, "new", "", "", 9), ("g", 4, "twice", "old", "y", 10), ("g", 4, "twice", "new", "y", 11),
        ("g", 6, "twice", "new", "y", 1), ("h", 3, "only", "x", "y", 12),
    ]
    got = rows(changes(spark, data, [("g", 1), ("g", 4), ("g", 4), ("g", 5), ("g", 6), ("h", 3), (None, 1)]))
    want = [("g", 4, "gone", "removed"), ("g", 4, "turns", "changed"), ("g", 4, "new", "added"), ("g", 4, "twice", "added")]
    want += [("g", 5, k, "removed") for k in ("same", "turns", "new", "twice")] + [("g", 6, "twice", "added")]
    assert got == sorted(want, key=str)


def test_empty(spark):
    assert changes(spark, [], [("g", 1), ("g", 2)]).count() == 0
    assert changes(spark, [("g", 1, "k", "v", "w", 1)], []).count() == 0


def test_against_brute_force_with_a_hot_group(spark, rows):
    random.seed(3)
    data = [(random.choice("aaaab"), random.randrange(5), f"k{random.randrange(30)}", random.choice("xy"), random.choice(["p", None]), i) for i in range(600)]
    steps = [(g, n) for g in "ab" for n in (0, 2, 3, 4)]
    state = {}
    for g, n, k, v, w, o in sorted(data, key=lambda r: r[5]):
        state.setdefault((g, n), {})[k] = (v, w)
    want = []
    for g in "ab":
        for a, b in ((0, 2), (2, 3), (3, 4)):
            x, y = state.get((g, a), {}), state.get((g, b), {})
            want += [(g, b, k, "added" if k not in x else "removed" if k not in y else "changed") for k in x.keys() | y.keys() if x.get(k, 0) != y.get(k, 0)]
    assert rows(changes(spark, data, steps)) == sorted(want, key=str)


def test_a_key_with_most_writings(spark, rows):
    data = [("g", 1 + i % 2, "hot", str(i), None, i) for i in range(3000)] + [("g", 1 + i % 2, f"k{i // 2}", "x", None, i) for i in range(200)]
    assert rows(changes(spark, data, [("g", 1), ("g", 2)])) == [("g", 2, "hot", "changed")]


def test_odd_names(spark, rows):
    r = spark.createDataFrame([("g", 1, "a", "x", "y", 1), ("g", 2, "b", "x", "y", 2)], ODD)
    steps = snapshot_diff.snapshot_steps(spark.createDataFrame([("g", 1), ("g", 2)], "s string, __side int"), "s", "__side")
    got = snapshot_diff.snapshot_changes(r.withColumnRenamed("__side", "no").withColumn("step", F.lit(1)), steps.withColumnRenamed("__side", "no"), "s", "no", ["at"], ["side"], F.col("ord"))
    assert rows(got) == [("g", 2, "a", "removed"), ("g", 2, "b", "added")]
