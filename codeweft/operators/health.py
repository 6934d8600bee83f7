"""The health vector of a graph, and the gate over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators import clones, manifest, metrics, scc
from codeweft.operators.graph import Graph, without_barrels, without_external_calls
from codeweft.session import staged

GATES = {"import-cycle": "importCyclesRuntime", "call-cycle": "callCyclesMutual", "recursion": "callCyclesRecursion", "clone": "cloneClustersTotal", "hub": "hubOutliers", "interface-width": "interfaceWidthShallowWide"}


def health_vector(g: Graph, entities: DataFrame, files: DataFrame) -> DataFrame:
    """One row of twelve measures. A runtime cycle needs two members that stay cyclic without type-only imports."""
    imports = staged(g.imports)
    inner = imports.where(F.col("source").isNotNull())
    file_imports = Graph(g.nodes, inner, g.entities, g.calls).file_imports
    calls = staged(g.calls)
    cycles = scc.import_cycles(without_barrels(imports)).agg(
        F.count(F.when(F.size("runtimeMembers") >= 2, 1)).alias("importCyclesRuntime"), F.count(F.lit(1)).alias("importCyclesInclTypeOnly")
    )
    calling = scc.call_cycles(without_external_calls(calls)).agg(F.count(F.when(F.col("kind") == "call-cycle", 1)).alias("callCyclesMutual"), F.count(F.when(F.col("kind") == "recursion", 1)).alias("callCyclesRecursion"))
    hub = metrics.hubs(file_imports).agg(F.count(F.lit(1)).alias("hubOutliers"), F.count(F.when(F.col("label") == "unstable-hub", 1)).alias("hubUnstable"))
    both = clones.exact_clones(entities).select("severity").unionByName(clones.shared_literals(entities).select("severity"))
    cloned = both.agg(F.count(F.when(F.col("severity") == "high", 1)).alias("cloneClustersHigh"), F.count(F.lit(1)).alias("cloneClustersTotal"))
    doors = metrics.entry_points(file_imports, g.entities, calls)
    width = metrics.calibrated(metrics.with_inbound(metrics.interface_width(g.files, file_imports, g.entities, calls), doors))
    wide = width.agg(F.coalesce(F.max(F.when(F.col("scope") == "folder", F.col("wEff"))), F.lit(0.0)).alias("maxEffectiveWidth"), F.count(F.when(F.col("severity") == "medium", 1)).alias("interfaceWidthShallowWide"))
    out = cycles
    for one in (calling, metrics.max_fan_in(file_imports), hub, cloned, wide, manifest.over_budget(files)):
        out = out.crossJoin(one)  # rows of one
    return out


def gate(kind: str) -> Column:
    """Whether the vector has findings of a kind; unknown kinds never fail."""
    return F.col(GATES[kind]) > 0 if kind in GATES else F.lit(False)
