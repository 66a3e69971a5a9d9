"""Topological order and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.plans.graph import LineageGraph
from provgraph.plans.iterate import Rounds, numbered


def levels(graph: LineageGraph) -> DataFrame:
    """(id, level): the longest directed path that ends there, for the nodes
    that no cycle precedes. Peels nodes without incoming edges round by round;
    undirected edges do not count. The graph's own edges are read twice, and
    those that the first round leaves are written."""
    rounds = Rounds(graph.nodes.sparkSession)
    e = graph.edges.filter("directed").select("source_id", "target_id")
    left = rounds.save(graph.nodes.select("id"))
    out, level = None, 0
    while True:
        free = rounds.save(left.join(e.select(F.col("target_id").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(level).alias("level")))
        if free.isEmpty():
            return rounds.finish(free if out is None else out)
        out = free if out is None else out.union(free)
        left = rounds.save(left.join(free, "id", "left_anti"))
        e = rounds.save(e.join(free.select(F.col("id").alias("source_id")), "source_id", "left_anti"))
        level += 1


def has_cycle(graph: LineageGraph) -> DataFrame:
    """One row (has_cycle, topo_length)."""
    rows = graph.nodes.select(F.lit(0).alias("k")).union(levels(graph).select(F.lit(1)))
    count = lambda k: F.count(F.when(F.col("k") == k, 1))
    return rows.agg((count(0) > count(1)).alias("has_cycle"), count(1).alias("topo_length"))


def topological_order(graph: LineageGraph) -> DataFrame:
    """(id, ord): the lexicographically smallest order; a prefix if there is a
    cycle. Up to ``limits.nodes`` nodes one task keeps the heap, which gets ids
    and edges only; larger graphs are ordered by ``_by_records``."""
    if graph.nodes.limit(graph.limits.nodes + 1).count() > graph.limits.nodes:
        return _by_records(graph)
    rows = graph.nodes.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).union(graph.edges.filter("directed").select("source_id", "target_id"))

    def run(table):
        import heapq

        import pandas as pd

        ends = table.dropna()
        out, into = {}, dict.fromkeys(table["a"], 0)
        for a, b in zip(ends["a"], ends["b"]):
            out.setdefault(a, []).append(b)
            into[b] += 1
        ready, done = sorted(k for k, v in into.items() if not v), []
        while ready:
            done.append(heapq.heappop(ready))
            for b in out.get(done[-1], []):
                into[b] -= 1
                if not into[b]:
                    heapq.heappush(ready, b)
        return pd.DataFrame({"id": done, "ord": range(len(done))})

    return rows.groupBy().applyInPandas(run, "id string, ord int")


def level_order(graph: LineageGraph) -> DataFrame:
    """(id, level, ord): a topological order of any size, by level and id; the
    nodes that no cycle precedes."""
    return numbered(levels(graph), ["level", "id"], "ord")


def _by_records(graph: LineageGraph) -> DataFrame:
    """The lexicographically smallest order of a graph of any size.

    Let ``top`` of a node be the greatest id among itself and all before it.
    The heap gives nodes by rising top: as long as one of a lesser top waits,
    one of that top is free and less than any of a greater one. Of those that
    share a top the node of that id comes first, as it is before the others,
    and they follow in the same way among themselves. So a node's place is that
    of the list of its tops. Where every edge rises, that is the node's id.
    """
    rounds = Rounds(graph.nodes.sparkSession)
    e = graph.edges.filter("directed").select("source_id", "target_id")
    if e.filter("source_id >= target_id").isEmpty():
        return numbered(graph.nodes.select("id"), ["id"], "ord")
    left = rounds.save(levels(graph).select("id", F.array().cast("array<string>").alias("tops")))
    done = None
    while not left.isEmpty():
        at = left.select(F.col("id").alias("source_id"), F.col("tops").alias("s")), left.select(F.col("id").alias("target_id"), F.col("tops").alias("t"))
        e = rounds.save(e.join(at[0], "source_id").join(at[1], "target_id").filter("s = t").select("source_id", "target_id").distinct())
        # greatest ids go along the edges, those alone that have changed
        best = front = left.select("id", F.col("id").alias("top"))
        while not front.isEmpty():
            met = front.withColumnRenamed("id", "source_id").join(e, "source_id").groupBy(F.col("target_id").alias("id")).agg(F.max("top").alias("new"))
            front = rounds.save(met.join(best, "id").filter("new > top").select("id", F.col("new").alias("top")))
            best = rounds.save(best.union(front).groupBy("id").agg(F.max("top").alias("top")))
        placed = rounds.save(left.join(best, "id").select("id", F.concat("tops", F.array("top")).alias("tops")))
        here = F.element_at("tops", -1) == F.col("id")
        done = placed.filter(here) if done is None else done.union(placed.filter(here))
        left = placed.filter(~here)
    return numbered(left if done is None else done, ["tops"], "ord").select("id", "ord")
