"""Change events: debounced batches by quiet time, the last word per path, and a stream that keeps the store's net state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SOURCE_QUIET, EDGE_QUIET, DOC_QUIET = "1 second", "500 milliseconds", "300 milliseconds"


def debounced(events: DataFrame, gap: str, keys: list[str]) -> DataFrame:
    """(keys, started, ended, events, paths): bursts of events of one key that no pause of the gap interrupts. Works on streams with a watermark."""
    w = F.session_window("ts", gap)
    return events.groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("path").alias("paths")).select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events", "paths")


def last_action(events: DataFrame, gap: str, order: list[str]) -> DataFrame:
    """(path, started, action): the last action of each burst on a path."""
    w = F.session_window("ts", gap)
    return events.groupBy("path", w.alias("w")).agg(F.max_by("action", F.struct(*order)).alias("action")).select("path", F.col("w.start").alias("started"), "action")


def net_state(events: DataFrame, order: list[str]) -> DataFrame:
    """(path, action): each path's last action over all events."""
    return events.groupBy("path").agg(F.max_by("action", F.struct(*order)).alias("action"))


def existing(state: DataFrame, removed: str = "removed") -> DataFrame:
    return state.where(F.col("action") != removed).select("path")


def upsert_stream(events: DataFrame, target: str, checkpoint: str, order: list[str], trigger: dict | None = None, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keeps net_state at target, as versions of a small parquet table, from a stream of events.

    A batch is written as its own version and counts when complete, so a batch that is delivered again gives the same
    table. after is called with each batch's net changes, as for refreshing the store.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        news = batch.groupBy("path").agg(F.max(F.struct(*order, "action")).alias("v"))
        last = _version(spark, target, before=number)
        rows = news if last is None else news.unionByName(spark.read.parquet(last))
        rows.groupBy("path").agg(F.max("v").alias("v")).write.mode("overwrite").parquet(f"{target}/v{number:012d}")
        if after:
            after(net_state(batch, order), number)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _version(spark: SparkSession, target: str, before: int | None = None) -> str | None:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(root))
    done = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS")) and (before is None or int(n[1:]) < before)]
    return f"{target}/{done[-1]}" if done else None


def read_state(spark: SparkSession, target: str) -> DataFrame:
    """(path, action) as the stream left it."""
    return spark.read.parquet(_version(spark, target)).select("path", F.col("v.action").alias("action"))
