"""Rule-driven review evidence: the registry, recall by query with gates and caps, and completeness."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions import ids

CAP, CAPPED, BUILT = 15, ("FI1", "D1"), ("cycles", "clones", "interface-width")
RESOLVED = ("issue-validated", "non-issue")


class Item(NamedTuple):
    id: str
    ruleset: str
    scope: str
    recallStrength: str
    recallQuery: str


# The review items.
ITEMS = [
    Item(id="D1", ruleset="general", scope="file", recallStrength="●●●", recallQuery="clones"),
    Item(id="D2", ruleset="general", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="D3", ruleset="general", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="D4", ruleset="general", scope="repo", recallStrength="●○○", recallQuery="instruction"),
    Item(id="DC1", ruleset="general", scope="repo", recallStrength="●●○", recallQuery="instruction"),
    Item(id="DC2", ruleset="general", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="DC3", ruleset="general", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="DEP1", ruleset="general", scope="repo", recallStrength="●●●", recallQuery="cycles"),
    Item(id="DEP2", ruleset="general", scope="repo", recallStrength="●●○", recallQuery="instruction"),
    Item(id="DEP3", ruleset="general", scope="file", recallStrength="●●○", recallQuery="ambient"),
    Item(id="DEP4", ruleset="general", scope="folder", recallStrength="●●○", recallQuery="instruction"),
    Item(id="ENC1", ruleset="general", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="ENC2", ruleset="general", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="ENC3", ruleset="general", scope="file", recallStrength="●●●", recallQuery="interface-width"),
    Item(id="ENC4", ruleset="general", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="ENC5", ruleset="general", scope="file", recallStrength="●●○", recallQuery="interface-decl"),
    Item(id="ST1", ruleset="general", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="ST2", ruleset="general", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="ST3", ruleset="general", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="ST4", ruleset="general", scope="file", recallStrength="●●○", recallQuery="lifecycle"),
    Item(id="ST5", ruleset="general", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="ST6", ruleset="general", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="CO1", ruleset="general", scope="folder", recallStrength="●○○", recallQuery="instruction"),
    Item(id="CO2", ruleset="general", scope="folder", recallStrength="●●○", recallQuery="instruction"),
    Item(id="CO3", ruleset="general", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="CO4", ruleset="general", scope="repo", recallStrength="●●○", recallQuery="instruction"),
    Item(id="ER1", ruleset="general", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="ER2", ruleset="general", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="ER3", ruleset="general", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="ER4", ruleset="general", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="LC1", ruleset="general", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="LC2", ruleset="general", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="LC3", ruleset="general", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="LC4", ruleset="general", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="FD1", ruleset="frontend", scope="repo", recallStrength="●●○", recallQuery="instruction"),
    Item(id="FD2", ruleset="frontend", scope="repo", recallStrength="●●○", recallQuery="routes"),
    Item(id="FD3", ruleset="frontend", scope="repo", recallStrength="●●○", recallQuery="instruction"),
    Item(id="FD4", ruleset="frontend", scope="repo", recallStrength="●●○", recallQuery="instruction"),
    Item(id="FB1", ruleset="frontend", scope="file", recallStrength="●●○", recallQuery="ambient"),
    Item(id="FB2", ruleset="frontend", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="FB3", ruleset="frontend", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="FR1", ruleset="frontend", scope="folder", recallStrength="●●○", recallQuery="payload-owners"),
    Item(id="FR2", ruleset="frontend", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="FI1", ruleset="frontend", scope="file", recallStrength="●●●", recallQuery="interface-width"),
    Item(id="FP1", ruleset="frontend", scope="file", recallStrength="●●○", recallQuery="transport"),
    Item(id="FP2", ruleset="frontend", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="FL1", ruleset="frontend", scope="file", recallStrength="●●○", recallQuery="lifecycle"),
    Item(id="FL2", ruleset="frontend", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="FL3", ruleset="frontend", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="FL4", ruleset="frontend", scope="folder", recallStrength="●○○", recallQuery="instruction"),
    Item(id="FM1", ruleset="frontend", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="FM2", ruleset="frontend", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="FM3", ruleset="frontend", scope="file", recallStrength="●●○", recallQuery="instruction"),
    Item(id="FM4", ruleset="frontend", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="FV1", ruleset="frontend", scope="file", recallStrength="●●○", recallQuery="dom-source"),
    Item(id="FV2", ruleset="frontend", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="FV3", ruleset="frontend", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="FV4", ruleset="frontend", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="FV5", ruleset="frontend", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="FS1", ruleset="frontend", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="FS2", ruleset="frontend", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="FS3", ruleset="frontend", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="FA1", ruleset="frontend", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="FA2", ruleset="frontend", scope="file", recallStrength="●○○", recallQuery="instruction"),
    Item(id="FA3", ruleset="frontend", scope="file", recallStrength="●○○", recallQuery="instruction"),
]


def registry(spark: SparkSession, ruleset: str = "both") -> DataFrame:
    """(place, id, ruleset, scope, recallStrength, recallQuery) of the review items, in order."""
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(ITEMS)], "place int, id string, ruleset string, scope string, recallStrength string, recallQuery string")
    return df if ruleset == "both" else df.where(F.col("ruleset") == ruleset)


def under_review(files: str, path: str, is_file: bool) -> Column:
    """Whether any of a finding's files lies at the file or in the folder under review."""
    p = path.strip().replace("\\", "/")
    p = p.rstrip("/") if len(p) > 1 else p
    return F.exists(files, (lambda f: ids.file_part(f) == p) if is_file else (lambda f: ids.under(ids.file_part(f), p)))


def recall(reg: DataFrame, findings: DataFrame, signals: DataFrame, path: str = "", is_file: bool = False) -> DataFrame:
    """(item, ref, note, place, total, graphBlind): the candidates of every item; one row with null ref for an item without any.

    findings: query, ref, note, files ARRAY, keep BOOLEAN, of the graph queries; signals: query, ref, note, of the scanners.
    The capped items take only findings worth keeping and show 15 of their candidates. An item is blind if neither a graph
    query nor a signal gave it anything.
    """
    graph = findings.where(under_review("files", path, is_file)).join(F.broadcast(reg.where(F.col("recallQuery").isin(*BUILT))), F.col("query") == F.col("recallQuery"))
    graph = graph.where(~F.col("id").isin(*CAPPED) | F.col("keep")).select(F.col("id").alias("item"), "ref", "note")
    signal = signals.join(F.broadcast(reg), F.col("query") == F.col("recallQuery")).select(F.col("id").alias("item"), "ref", "note")
    c = graph.unionByName(signal).distinct()
    w = Window.partitionBy("item")
    c = c.withColumn("place", F.row_number().over(w.orderBy("ref", "note"))).withColumn("total", F.count(F.lit(1)).over(w)).where(~F.col("item").isin(*CAPPED) | (F.col("place") <= CAP))
    return reg.select(F.col("id").alias("item")).join(c, "item", "left").withColumn("graphBlind", F.col("ref").isNull())


def unresolved(reg: DataFrame, submitted: DataFrame) -> DataFrame:
    """(id, place) of items without a resolved verdict. submitted: id, status, n; the last one of an id (greatest n) counts."""
    last = submitted.groupBy("id").agg(F.max_by("status", "n").alias("status")).where(F.col("status").isin(*RESOLVED))
    return reg.join(last.select("id"), "id", "left_anti").select("id", "place")


def missing_notes(submitted: DataFrame) -> DataFrame:
    """Validated issues without a note."""
    return submitted.where((F.col("status") == "issue-validated") & (F.length(F.trim(F.coalesce("note", F.lit("")))) == 0))
