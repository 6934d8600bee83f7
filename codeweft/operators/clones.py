"""Duplicate code: clusters of equal bodies and of shared literals, ranked by the distance between their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import ids

MIN_TOKENS = 20
# Literal tags and the kinds they stand for.
LITERAL_KINDS = {"str": "string", "arr": "array", "re": "regex", "num": "numeric"}


def is_test_file(c: Column | str) -> Column:
    c = ids.col(c)
    return c.startswith("tests/") | c.contains("/tests/") | c.contains("__tests__/") | c.rlike(r"\.(test|spec)\.")


def module_of(c: Column | str) -> Column:
    """First path segment; under src, the first two."""
    c = ids.col(c)
    return F.when(c.startswith("src/"), F.substring_index(c, "/", 2)).otherwise(F.substring_index(c, "/", 1))


def shared_kind(c: Column | str) -> Column:
    tag = F.substring_index(ids.col(c), ":", 1)
    out = F.lit(None).cast("string")
    for k, v in LITERAL_KINDS.items():
        out = F.when(tag == k, v).otherwise(out)
    return out


def _severity(files: Column, modules: Column) -> Column:
    return F.when(files <= 1, "low").when(modules <= 1, "medium").otherwise("high")


def _clusters(rows: DataFrame, key: str) -> DataFrame:
    """Clusters of (key, id, fileId) with two or more ids: size, files, severity by the distance of their non-test files."""
    source = F.when(~is_test_file("fileId"), F.col("fileId"))
    per_file = rows.groupBy(key, "fileId").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    c = per_file.groupBy(key).agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("files"), F.min("first").alias("first"), F.count(source).alias("__f"), F.countDistinct(F.when(~is_test_file("fileId"), module_of("fileId"))).alias("__m"))
    return c.where(F.col("members") >= 2).select(key, "members", "files", "first", _severity(F.col("__f"), F.col("__m")).alias("severity"))


def exact_clones(entities: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(normalizedHash, members, files, first, severity) of equal bodies of at least min_tokens tokens. entities: id, fileId, normalizedHash, tokenCount; one row per id."""
    return _clusters(entities.where((F.col("tokenCount") >= min_tokens) & F.col("normalizedHash").isNotNull()), "normalizedHash")


def literal_rows(entities: DataFrame) -> DataFrame:
    """(literal, id, fileId), each literal once per entity."""
    return entities.select("id", "fileId", F.explode(F.array_distinct("literalHashes")).alias("literal")).where(F.col("literal").isNotNull()).distinct()


def shared_literals(entities: DataFrame) -> DataFrame:
    """(literal, sharedKind, members, files, first, severity) of literals in two entities or more, of any size."""
    return _clusters(literal_rows(entities), "literal").withColumn("sharedKind", shared_kind("literal"))


def chain_edges(rows: DataFrame, key: str, clone_type: str) -> DataFrame:
    """(source, target, cloneType, key): each member of a cluster with the next, by id: n - 1 edges, no clique."""
    w = Window.partitionBy(key).orderBy("id")
    return rows.select(key, F.col("id").alias("source"), F.lead("id").over(w).alias("target")).where(F.col("target").isNotNull()).withColumn("cloneType", F.lit(clone_type))


def ranked(clusters: DataFrame) -> DataFrame:
    """Worst first: severity, then the first member."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return clusters.withColumn("rank", rank).orderBy("rank", "first")


def disambiguated(entities: DataFrame) -> DataFrame:
    """(fileId, name, startByte, id): repeated names in a file get @startByte from the second occurrence on."""
    w = Window.partitionBy("fileId", "name").orderBy("startByte")
    again = F.row_number().over(w) > 1
    return entities.select("fileId", "name", "startByte", F.when(again, F.concat("fileId", F.lit(ids.SEP), "name", F.lit("@"), "startByte")).otherwise(ids.entity_id("fileId", "name")).alias("id"))
