"""Session helpers: table loading, staged tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast (times at most ~200 bytes a row).
BROADCAST_ROWS = 200_000

_staged: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on this machine alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="codeweft-")
        shared_dir.own = path
    return path


def drop_staged(since: int = 0) -> None:
    """Deletes staged tables, from the one that was written as number `since`; results that still read them are lost."""
    for spark, path in _staged[since:]:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001, the session may be gone already
            pass
    del _staged[since:]


def staged_tables() -> int:
    """How many tables are staged so far: a mark for drop_staged, for sessions that run many queries."""
    return len(_staged)


atexit.register(drop_staged)


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, hinted for broadcast if it has at most so many rows; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """df with the place of each row in the order of by, from 1, as name: every range of the order counts its own rows, and starts after the ranges before."""
    spark = df.sparkSession
    parts = staged(df.repartitionByRange(parallelism(spark), *by).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a partition
    before, starts = 0, []
    for r in sorted(counts):
        starts.append((r["__part"], before))
        before += r["n"]
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*by)) + F.col("__before")
    return parts.join(F.broadcast(spark.createDataFrame(starts, "__part int, __before long")), "__part").withColumn(name, place).drop("__part", "__before")
