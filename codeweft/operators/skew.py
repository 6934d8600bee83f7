"""Per-key work without stragglers: fragment-replicate by estimated load.

The loads of all keys are counted (map-side combined). Keys heavier than half a fair task are split into shards in
proportion to their load; the rest fall into hash buckets. Shards and buckets are bin-packed onto tasks, longest first.
Rows go straight to their task's partition; the matching side is copied only to the tasks that hold a shard of its key.
What the driver sees is bounded by the number of tasks: at most two heavy keys and 16 buckets per task.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.session import parallelism

BUCKETS_PER_TASK = 16
TASK, BUCKET, SHARDS = "__task", "__bucket", "__shards"


@dataclass(frozen=True)
class FragmentPlan:
    """total: rows with a key. heavy: key values with their load and the tasks of their shards. buckets: task of each hash bucket."""

    total: int
    tasks: int
    heavy: tuple[tuple[tuple, int, tuple[int, ...]], ...]
    buckets: tuple[int, ...]
    keys: tuple[str, ...]
    loads: tuple[float, ...]

    def frames(self, spark: SparkSession, types: list[T.DataType]) -> tuple[DataFrame, DataFrame]:
        fields = [T.StructField(f"__k{i}", t) for i, t in enumerate(types)]
        heavy = spark.createDataFrame([(*k, list(at)) for k, _, at in self.heavy], T.StructType([*fields, T.StructField(SHARDS, T.ArrayType(T.IntegerType()))]))
        buckets = spark.createDataFrame([(i, t) for i, t in enumerate(self.buckets)], f"{BUCKET} long, __bucket_task int")
        return F.broadcast(heavy), F.broadcast(buckets)  # both bounded by the number of tasks


def _bucket(keys: tuple[str, ...], n: int) -> Column:
    return F.pmod(F.xxhash64(*map(F.col, keys)), F.lit(n).cast("long"))


def plan_fragments(df: DataFrame, keys: list[str] | str, tasks: int | None = None) -> FragmentPlan:
    """Counts the load of every key of df and packs keys to tasks. Rows with a null in the key have no load.

    df is read once: the loads are combined before they move, and their sum comes from the same exchange.
    """
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    tasks = tasks or parallelism(df.sparkSession)
    n = BUCKETS_PER_TASK * tasks
    has_key = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    loads = df.where(has_key).groupBy(*keys).agg(F.count(F.lit(1)).alias("__load"))
    all_loads = loads.agg(F.coalesce(F.sum("__load"), F.lit(0)).alias("__total"))
    heavy = F.col("__load") * 2 > F.greatest(F.lit(1.0), F.col("__total") / tasks)
    rows = (
        loads.crossJoin(F.broadcast(all_loads))  # one row
        .groupBy(*(F.when(heavy, F.col(k)).alias(f"__k{i}") for i, k in enumerate(keys)), F.when(heavy, F.lit(-1).cast("long")).otherwise(_bucket(keys, n)).alias(BUCKET))
        .agg(F.sum("__load").alias("__load"))
        .collect()
    )
    total = sum(r["__load"] for r in rows)
    fair = max(1.0, total / tasks)
    heavies = sorted(((tuple(r)[: len(keys)], r["__load"]) for r in rows if r[BUCKET] < 0), key=lambda x: (-x[1], str(x[0])))
    by_bucket = {r[BUCKET]: r["__load"] for r in rows if r[BUCKET] >= 0}
    heap = [(0.0, t) for t in range(tasks)]
    placed: list[tuple[tuple, int, tuple[int, ...]]] = []
    for key, load in heavies:
        shards = min(tasks, max(1, round(load / fair + 0.5)))
        took = [heapq.heappop(heap) for _ in range(shards)]
        for at, t in took:
            heapq.heappush(heap, (at + load / shards, t))
        placed.append((key, load, tuple(t for _, t in took)))
    buckets = [0] * n
    for b in sorted(range(n), key=lambda b: (-by_bucket.get(b, 0), b)):
        at, t = heapq.heappop(heap)
        buckets[b] = t
        heapq.heappush(heap, (at + by_bucket.get(b, 0), t))
    return FragmentPlan(total, tasks, tuple(placed), tuple(buckets), keys, tuple(at for at, _ in sorted(heap, key=lambda x: x[1])))


def _placed(df: DataFrame, plan: FragmentPlan, keys: tuple[str, ...]) -> DataFrame:
    heavy, buckets = plan.frames(df.sparkSession, [df.schema[k].dataType for k in keys])
    on = reduce(lambda a, b: a & b, (df[k] == heavy[f"__k{i}"] for i, k in enumerate(keys)))
    out = df.join(heavy, on, "left").drop(*(f"__k{i}" for i in range(len(keys))))
    return out.withColumn(BUCKET, _bucket(keys, len(plan.buckets))).join(buckets, BUCKET, "left").drop(BUCKET)


def fragment(df: DataFrame, plan: FragmentPlan, keys: list[str] | str | None = None, spread: Column | None = None) -> DataFrame:
    """df with its task in __task; spread decides the shard of a heavy key's row.

    By default that is a hash of the row and of its input partition, which a repeated task finds again, whatever the order
    its rows come in; copies of a row in one partition stay together.
    """
    keys = plan.keys if keys is None else (keys,) if isinstance(keys, str) else tuple(keys)
    if spread is None:
        spread = F.xxhash64(F.spark_partition_id(), *(F.col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()))
    out = _placed(df, plan, keys)
    n = F.size(SHARDS)
    return out.withColumn(
        TASK, F.when(F.col(SHARDS).isNotNull(), F.element_at(SHARDS, (F.pmod(F.xxhash64(spread), F.greatest(n, F.lit(1))) + 1).cast("int"))).otherwise(F.col("__bucket_task"))
    ).drop(SHARDS, "__bucket_task")


def replicate(df: DataFrame, plan: FragmentPlan, keys: list[str] | str | None = None) -> DataFrame:
    """The matching side: one copy of a row for each task that holds a shard of its key, one for any other key."""
    keys = plan.keys if keys is None else (keys,) if isinstance(keys, str) else tuple(keys)
    out = _placed(df, plan, keys)
    return out.withColumn(TASK, F.explode(F.coalesce(F.col(SHARDS), F.array("__bucket_task")))).drop(SHARDS, "__bucket_task")


def to_tasks(df: DataFrame, plan: FragmentPlan) -> DataFrame:
    """Each row moved to the partition that is its task."""
    return df.repartitionById(plan.tasks, F.col(TASK))


def fragment_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", plan: FragmentPlan | None = None) -> DataFrame:
    """left joined with right on a key column of the same name in both, in even tasks; right's rows are copied only to the shards of their key.

    how is inner or left. Null keys match nothing; with left they stay, with nulls. Other columns that clash keep left's
    name and get the suffix _right on the right side. Empty tables give empty results.
    """
    if how not in ("inner", "left"):
        raise ValueError("a replicated right side allows inner and left joins only")
    plan = plan or plan_fragments(left, key)
    right = right.select(F.col(key).alias("__rk"), *(F.col(c).alias(f"{c}_right" if c in left.columns else c) for c in right.columns if c != key)).where(F.col("__rk").isNotNull())
    a = to_tasks(fragment(left, plan), plan)
    b = to_tasks(replicate(right, plan, "__rk"), plan).withColumnRenamed(TASK, "__rtask")
    return a.join(b, (a[TASK] == b["__rtask"]) & (a[key] == b["__rk"]), how).drop(TASK, "__rtask", "__rk")


def hot_hashes(df: DataFrame, keys: list[str], tasks: int | None = None) -> list[int]:
    """xxhash64 of every key that holds more than half a task's fair share of the rows: at most two a task.

    One pass counts hash buckets, of which there are 64 a task; only where a bucket is that full are its keys counted.
    """
    tasks = tasks or parallelism(df.sparkSession)
    h = df.select(F.xxhash64(*map(F.col, keys)).alias("h")).withColumn("b", F.pmod("h", F.lit(64 * tasks).cast("long")))
    buckets = {r["b"]: r["n"] for r in h.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = sum(buckets.values()) / (2 * tasks)
    full = [b for b, n in buckets.items() if n > least]
    if not full:
        return []
    counts = h.where(F.col("b").isin(full)).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["h"] for r in counts.where(F.col("n") > least).collect())


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, rows) of every key. A count is combined before it moves, so a hot key arrives as one row a task and needs no plan. Null keys give no row; a key may not be named rows."""
    if key == "rows":
        raise ValueError("the key's name is taken by the count")
    return df.select(key).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))


def heavy_keys(df: DataFrame, key: str, share: float, tasks: int | None = None, total: int | None = None) -> DataFrame:
    """(key, rows) of every key that stands on at least this share of all rows (total), rows with a null key included in the whole.

    They are read off the plan, whose loads are exact: a key with a share of s is heavier than half a task where there are
    over 1 / (2 s) tasks, so the plan is made for at least that many. Fewer than 1 / s keys come out. An empty table gives no row.
    """
    total = df.count() if total is None else total
    plan = plan_fragments(df, key, max(tasks or parallelism(df.sparkSession), math.ceil(0.5 / share) + 1))
    rows = [(k[0], n) for k, n, _ in plan.heavy if n >= share * total]
    return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("rows", T.LongType())]))


def skew_report(df: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """Load of the fullest task under hash partitioning and under the plan: (tasks, total, hash_max, planned_max)."""
    plan = plan_fragments(df, key, tasks)
    spark = df.sparkSession
    hashed = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).groupBy(F.pmod(F.hash(key), F.lit(plan.tasks))).agg(F.sum("n").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("hash_max"))
    return spark.createDataFrame([(plan.tasks, plan.total, float(max(plan.loads)))], "tasks int, total long, planned_max double").crossJoin(hashed)
