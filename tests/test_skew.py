import random
from collections import Counter

from pyspark.sql import functions as F

from codeweft.operators import skew


def frame(spark, keys, schema="k string, n int"):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], schema)


def test_plan_splits_heavy_keys_and_balances(spark):
    random.seed(1)
    keys = ["hot"] * 4000 + ["warm"] * 1500 + [f"k{random.randrange(800)}" for _ in range(4500)]
    plan = skew.plan_fragments(frame(spark, keys), "k", tasks=8)
    assert plan.total == 10000
    heavy = {k[0]: at for k, _, at in plan.heavy}
    assert len(heavy["hot"]) == 4 and len(set(heavy["hot"])) == 4 and len(heavy["warm"]) == 2
    assert max(plan.loads) <= 1.15 * 10000 / 8


def test_rows_reach_their_task_and_partition_loads_match(spark):
    keys = ["hot"] * 3000 + [f"k{i % 300}" for i in range(3000)]
    df = frame(spark, keys)
    plan = skew.plan_fragments(df, "k", tasks=6)
    sizes = skew.to_tasks(skew.fragment(df, plan), plan).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 6000
    assert max(r["count"] for r in sizes) < 1.3 * 1000


def test_counts_equal_plain_counts_with_nulls_repeats_and_ties(spark, rows):
    keys = ["a"] * 50 + ["b"] * 50 + [None] * 7 + [""] * 3 + ["c"]
    assert rows(skew.key_counts(frame(spark, keys), "k")) == sorted(((k, n) for k, n in Counter(k for k in keys if k is not None).items()), key=str)


def test_heavy_keys_count_all_rows(spark, rows):
    keys = ["a"] * 3 + [None] * 97 + ["b"]
    df = frame(spark, keys)
    assert rows(skew.heavy_keys(df, "k", 0.02)) == [("a", 3)]
    assert rows(skew.heavy_keys(df.where("k = 'zz'"), "k", 0.02)) == [] and rows(skew.heavy_keys(df.where("k is null"), "k", 0.02)) == []
    many = frame(spark, [f"k{i % 40}" for i in range(400)] + ["one"] * 7)
    assert len(rows(skew.heavy_keys(many, "k", 0.02, tasks=2))) == 40


def test_join_equals_plain_join_with_clashing_columns(spark, rows):
    left = frame(spark, ["hot"] * 200 + ["x", "y", None, "x"])
    right = spark.createDataFrame([("hot", 1, "p"), ("x", 2, "q"), ("x", 3, "r"), (None, 4, "s"), ("unused", 5, "t")], "k string, n int, name string")
    for how in ("left", "inner"):
        want = left.join(right.withColumnRenamed("n", "n_right"), "k", how)
        got = skew.fragment_join(left, right, "k", how, skew.plan_fragments(left, "k", 4))
        assert rows(got, "k", "n", "n_right", "name") == rows(want, "k", "n", "n_right", "name")
    assert skew.fragment_join(left.limit(0), right, "k").count() == 0
    assert skew.fragment_join(left, right.limit(0), "k").count() == 204


def test_report_shows_the_gain(spark):
    r = skew.skew_report(frame(spark, ["hot"] * 5000 + [f"k{i}" for i in range(5000)]), "k", 10).first()
    assert r["hash_max"] >= 5000 and r["planned_max"] <= 1200


def test_hot_hashes(spark):
    df = frame(spark, ["hot"] * 300 + [f"k{i}" for i in range(700)])
    want = [r[0] for r in df.where("k = 'hot'").select(F.xxhash64("k")).distinct().collect()]
    assert skew.hot_hashes(df, ["k"], 8) == want and skew.hot_hashes(df.where("k <> 'hot'"), ["k"], 8) == [] and skew.hot_hashes(df.limit(0), ["k"], 8) == []


def test_shards_are_found_again(spark):
    df = frame(spark, ["hot"] * 500 + ["a", "b"]).repartition(3)
    plan = skew.plan_fragments(df, "k", 4)
    once, twice = ({(r["n"], r["__task"]) for r in skew.fragment(df, plan).collect()} for _ in range(2))
    assert once == twice and len({t for n, t in once if n < 500}) > 1
