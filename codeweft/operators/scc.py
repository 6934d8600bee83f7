"""Strongly connected components and cycles over edge tables.

Edges are trimmed of nodes that lie on no cycle, the rest is split into weakly connected components, and each small component
goes through an iterative depth-first search in one task. A component with more edges than MAX_LOCAL_EDGES stays distributed:
labels are spread forward to a fixed point, and back from each label's own node.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import staged

MAX_LOCAL_EDGES = 200_000
TRIM_ROUNDS = 30


def trimmed(edges: DataFrame, rounds: int = TRIM_ROUNDS) -> DataFrame:
    """Distinct edges without loops, repeatedly freed of edges whose source has no predecessor or whose target no successor; what is left holds all cycles."""
    e = staged(edges.select("source", "target").where(F.col("source") != F.col("target")).distinct())
    n = e.count()
    for _ in range(rounds):
        if not n:
            break
        e = staged(e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi"))
        n, last = e.count(), n
        if n == last:
            break
    return e


def weak_components(edges: DataFrame) -> DataFrame:
    """(id, component): every endpoint with the least id of its weakly connected component, by alternating star operations."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where(F.col("source") != F.col("target"))
    e = staged(both.select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct())
    while True:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = sym.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = staged(small)
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def local_components(edges: list[tuple[str, str]]) -> dict[str, str]:
    """Node to the least member of its strongly connected component."""
    out: dict[str, list[str]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order, low, stack, held, found, n = {}, {}, [], set(), {}, 0
    for root in out:
        if root in order:
            continue
        todo = [(root, iter(out[root]))]
        order[root] = low[root] = n
        n += 1
        stack.append(root)
        held.add(root)
        while todo:
            v, rest = todo[-1]
            for w in rest:
                if w not in order:
                    order[w] = low[w] = n
                    n += 1
                    stack.append(w)
                    held.add(w)
                    todo.append((w, iter(out[w])))
                    break
                if w in held:
                    low[v] = min(low[v], order[w])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                if low[v] == order[v]:
                    members = []
                    while not members or members[-1] != v:
                        members.append(stack.pop())
                        held.discard(members[-1])
                    least = min(members)
                    found.update((m, least) for m in members)
    return found


def _coloured(edges: DataFrame) -> DataFrame:
    """(id, scc) of all nodes, by joins only: for components too large for one task."""
    done, e = None, edges
    while not e.isEmpty():
        nodes = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        colour = staged(nodes.select("id", F.col("id").alias("c")))
        while True:  # the least id that reaches each node
            step = e.join(colour.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.min("c").alias("m"))
            new = staged(colour.join(step, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c")))
            if new.join(colour.withColumnRenamed("c", "o"), "id").where(F.col("c") != F.col("o")).isEmpty():
                break
            colour = new
        inside = staged(e.join(colour.select(F.col("id").alias("source"), "c"), "source").join(colour.select(F.col("id").alias("target"), F.col("c").alias("d")), "target").where(F.col("c") == F.col("d")).select("source", "target", "c"))
        mine = staged(colour.where(F.col("id") == F.col("c")))
        edge = mine
        while True:  # nodes of a colour that reach the colour's own node
            edge = staged(inside.join(edge.select(F.col("id").alias("target"), "c"), ["target", "c"]).select(F.col("source").alias("id"), "c").distinct().join(mine, ["id", "c"], "left_anti"))
            if edge.isEmpty():
                break
            mine = staged(mine.unionByName(edge))
        one = mine.select("id", F.col("c").alias("scc"))
        done = one if done is None else staged(done.unionByName(one))
        e = staged(e.join(mine.select(F.col("id").alias("source")), "source", "left_anti").join(mine.select(F.col("id").alias("target")), "target", "left_anti"))
        left = nodes.join(done.select("id"), "id", "left_anti").join(e.select(F.explode(F.array("source", "target")).alias("id")), "id", "left_anti")
        done = done.unionByName(left.select("id", F.col("id").alias("scc")))
    return done


def components(edges: DataFrame, max_local_edges: int = MAX_LOCAL_EDGES) -> DataFrame:
    """(id, scc) of every node in a component of two or more, scc being the least member."""
    plain = edges.select("source", "target").where(F.col("source") != F.col("target")).distinct()
    if plain.limit(max_local_edges + 1).count() <= max_local_edges:
        placed = plain.withColumn("component", F.lit(""))  # all of it fits one task
    else:
        e = trimmed(edges)
        weak = weak_components(e) if not e.isEmpty() else e.select(F.col("source").alias("id"), F.col("target").alias("component"))
        placed = e.join(weak.withColumnRenamed("id", "source"), "source")
    placed = staged(placed)
    size = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    local = placed.join(size.where(F.col("n") <= max_local_edges), "component", "left_semi")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found = local_components(list(zip(pdf["source"], pdf["target"])))
        return pd.DataFrame({"id": list(found), "scc": list(found.values())}, dtype=object)

    out = local.groupBy("component").applyInPandas(search, "id string, scc string")
    large = placed.join(size.where(F.col("n") > max_local_edges), "component", "left_semi")
    if not large.isEmpty():
        out = out.unionByName(_coloured(large.select("source", "target")))
    several = out.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return out.join(several, "scc", "left_semi").select("id", "scc")


def cyclic_components(edges: DataFrame, max_local_edges: int = MAX_LOCAL_EDGES) -> DataFrame:
    """(id, scc): members of components that hold a cycle: two or more nodes, or a loop."""
    several = staged(components(edges, max_local_edges))
    loops = edges.where(F.col("source") == F.col("target")).select(F.col("source").alias("id")).distinct()
    return several.unionByName(loops.join(several, "id", "left_anti").select("id", F.col("id").alias("scc")))


def all_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, scc) of every node, single ones included."""
    return nodes.select("id").join(components(edges), "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))


def edges_in_cycles(edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """The edges, as often as they occur, whose ends share a cyclic component."""
    s = cyclic.select(F.col("id").alias("source"), "scc")
    t = cyclic.select(F.col("id").alias("target"), F.col("scc").alias("scc_t"))
    return edges.join(s, "source").join(t, "target").where(F.col("scc") == F.col("scc_t")).drop("scc_t")


def local_cycle(edges: list[tuple[str, str]], root: str) -> list[str]:
    """The least of the shortest closed walks from root."""
    out: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, []).append(b)
    before, level = {}, [root]
    while level:
        after = []
        for v in level:
            if root in out.get(v, ()):
                path = [root, v] if v != root else [root]
                while v != root and before[v] != root:
                    v = before[v]
                    path.insert(1, v)
                return [*path, root]
            for w in out.get(v, ()):
                if w != root and w not in before:
                    before[w] = v
                    after.append(w)
        level = after
    return []


def shortest_cycles(edges: DataFrame, cyclic: DataFrame, max_local_edges: int = MAX_LOCAL_EDGES) -> DataFrame:
    """(scc, path): the least of the shortest closed walks from each component's least member, as node ids.

    Small components are walked in one task each; in large ones paths grow by a join for every hop, and of all paths to a
    node only the least is kept.
    """
    inner = staged(edges_in_cycles(edges.select("source", "target").distinct(), cyclic).select("scc", "source", "target"))
    size = inner.groupBy("scc").agg(F.count(F.lit(1)).alias("n"))
    large = staged(size.where(F.col("n") > max_local_edges).select("scc"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        root = pdf["scc"].iloc[0]
        return pd.DataFrame({"scc": [root], "path": [local_cycle(list(zip(pdf["source"], pdf["target"])), root)]})

    local = inner.join(large, "scc", "left_anti").groupBy("scc").applyInPandas(walk, "scc string, path array<string>")
    if large.isEmpty():
        return local
    inner, cyclic = inner.join(large, "scc", "left_semi"), cyclic.join(large, "scc", "left_semi")
    front = staged(cyclic.select("scc").distinct().select("scc", F.col("scc").alias("at"), F.array("scc").alias("path")))
    seen, closed = front.select("scc", "at"), None
    while not front.isEmpty():
        step = staged(front.join(inner.withColumnRenamed("source", "at"), ["scc", "at"]).select("scc", F.col("target").alias("at"), F.concat("path", F.array("target")).alias("path")).groupBy("scc", "at").agg(F.min("path").alias("path")))
        back = step.where(F.col("at") == F.col("scc")).select("scc", "path")
        closed = staged(back if closed is None else closed.unionByName(back))
        front = staged(step.join(closed.select("scc"), "scc", "left_anti").join(seen, ["scc", "at"], "left_anti"))
        seen = staged(seen.unionByName(front.select("scc", "at")))
    return local.unionByName(closed)


def import_cycles(imports: DataFrame) -> DataFrame:
    """(scc, members, path, totalEdgeCount, typeOnlyEdgeCount, runtimeMembers) per import cycle; imports without barrels, duplicates counted."""
    cyclic = staged(cyclic_components(imports))
    runtime = cyclic_components(imports.where(~F.col("typeOnly"))).select("id", F.lit(True).alias("rt"))
    members = cyclic.join(runtime, "id", "left").groupBy("scc").agg(F.array_sort(F.collect_set("id")).alias("members"), F.array_sort(F.collect_set(F.when(F.col("rt"), F.col("id")))).alias("runtimeMembers"))
    counts = edges_in_cycles(imports, cyclic).groupBy("scc").agg(F.count(F.lit(1)).alias("totalEdgeCount"), F.count(F.when(F.col("typeOnly"), 1)).alias("typeOnlyEdgeCount"))
    return members.join(counts, "scc").join(shortest_cycles(imports, cyclic), "scc", "left").select("scc", "members", F.coalesce("path", "members").alias("path"), "totalEdgeCount", "typeOnlyEdgeCount", "runtimeMembers")


def call_cycles(calls: DataFrame) -> DataFrame:
    """(scc, members, kind, severity): mutual cycles (medium) and single recursion (low)."""
    m = cyclic_components(calls).groupBy("scc").agg(F.array_sort(F.collect_set("id")).alias("members"))
    one = F.size("members") == 1
    return m.select("scc", "members", F.when(one, "recursion").otherwise("call-cycle").alias("kind"), F.when(one, "low").otherwise("medium").alias("severity"))
