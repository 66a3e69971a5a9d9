"""Breadth-first and depth-first traversal, lineage and impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provgraph.errors import SubgraphTooLarge
from provgraph.plans.graph import LineageGraph
from provgraph.plans.iterate import Rounds
from provgraph.schema import clamp


def reach_sides(graph: LineageGraph, starts: DataFrame, depth: int, sides=("out", "in"), relations=(), types=()) -> DataFrame:
    """(side, root, node_id, depth): least hops from each start along each
    side, for any number of starts, all sides in one loop.

    One join of the frontier with the adjacency and one anti-join with what
    was visited a round; each round is written, so the plan stays short. The
    edges are read each round and not written anew: a small frontier is
    broadcast by Spark, so that they are not shuffled either. Graphs whose
    edges are dear to make are saved first (``LineageGraph.saved``).
    """
    rounds, types = Rounds(starts.sparkSession), list(types)
    way = lambda d: graph.adjacency(d, relations).select(F.lit(d).alias("side"), "src", "dst")
    a = reduce(DataFrame.union, [way(d) for d in sides])
    root = F.col(starts.columns[0])
    front = rounds.save(starts.select(F.explode(F.array(*map(F.lit, sides))).alias("side"), root.alias("root"), root.alias("node_id"), F.lit(0).alias("depth")))
    visits, keys = front, ["side", "root", "node_id"]
    for level in range(1, clamp(depth, graph.limits.depth) + 1):
        met = front.withColumnRenamed("side", "s").join(a, (F.col("s") == F.col("side")) & (F.col("node_id") == F.col("src")))
        met = met.select("side", "root", F.col("dst").alias("node_id")).distinct()
        if types:  # of what is met, not of all edges
            met = met.join(graph.nodes.filter(F.col("type").isin(types)).select(F.col("id").alias("node_id")), "node_id", "left_semi").select(*keys)
        front = rounds.save(met.join(visits, keys, "left_anti").select(*keys, F.lit(level).alias("depth")))
        if front.isEmpty():
            break
        visits = visits.union(front)
    return visits


def reach(graph: LineageGraph, starts: DataFrame, depth: int, direction: str = "out", relations=(), types=()) -> DataFrame:
    """(root, node_id, depth): least hops from each start."""
    return reach_sides(graph, starts, depth, (direction,), relations, types).drop("side")


def _one(graph: LineageGraph, node_id: str) -> DataFrame:
    return graph.nodes.filter(F.col("id") == node_id).select("id")


def bfs(graph: LineageGraph, start: str, depth: int = 0, direction: str = "out", relations=(), types=(), max_nodes: int = 0) -> tuple[DataFrame, bool]:
    """((node_id, depth, ord), truncated): the first ``max_nodes`` nodes in
    queue order: by level, then by the parent's order and the edge's id.

    Ordering numbers at most max_nodes rows a level, the only rows that one
    task ever holds.
    """
    graph.require(start)
    most, depth = clamp(max_nodes, graph.limits.nodes), clamp(depth, graph.limits.depth)
    rounds = Rounds(graph.nodes.sparkSession)
    a = graph.adjacency(direction, relations, types).select("src", "dst", "edge_id")
    front = visits = rounds.save(_one(graph, start).select(F.col("id").alias("node_id"), F.lit(0).alias("depth"), F.lit(0).alias("ord")))
    seen = 1
    for level in range(1, depth + 1):
        met = front.join(a, F.col("node_id") == F.col("src")).groupBy("dst").agg(F.min(F.struct("ord", "edge_id")).alias("p"))
        met = met.join(visits.select(F.col("node_id").alias("dst")), "dst", "left_anti").orderBy("p").limit(most - seen + 1)
        place = F.row_number().over(Window.orderBy("p")) + seen - 1
        front = rounds.save(met.select(F.col("dst").alias("node_id"), F.lit(level).alias("depth"), place.alias("ord")))
        n = front.count()
        visits = visits.union(front)
        seen += n
        if not n or seen > most:
            break
    return visits.filter(F.col("ord") < most), seen > most


def neighbours(graph: LineageGraph, node_id: str, hops: int = 1, relations=()) -> DataFrame:
    graph.require(node_id)
    return reach(graph, _one(graph, node_id), max(1, hops), "both", relations).drop("root")


def dfs(graph: LineageGraph, start: str, depth: int = 0, direction: str = "out", relations=(), types=(), max_nodes: int = 0) -> DataFrame:
    """(node_id, depth, ord, cycle_detected, truncated) in depth-first order,
    children by edge id; at most ``max_nodes`` nodes.

    The order is sequential by nature, so one task walks it. Its input is
    bounded: at most ``limits.nodes`` nodes may be within reach, or the call
    raises and asks for a smaller depth or a filter; and of each node's edges
    max_nodes + 1 at most count, as no more of its children can be met before
    one that is new.
    """
    graph.require(start)
    most, depth = clamp(max_nodes, graph.limits.nodes), clamp(depth, graph.limits.depth)
    inside = reach(graph, _one(graph, start), depth, direction, relations, types).select("node_id")
    if (n := inside.limit(graph.limits.nodes + 1).count()) > graph.limits.nodes:
        raise SubgraphTooLarge(f"at least {n} nodes within reach; at most {graph.limits.nodes}")
    a = graph.adjacency(direction, relations, types).join(inside.withColumnRenamed("node_id", "src"), "src", "left_semi")
    a = a.groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"))
    a = a.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("edge_id"))).filter(F.col("n") <= most + 1).select("src", "dst", "edge_id")

    def walk(rows):
        import pandas as pd

        out: dict[str, list] = {}
        rows = rows[rows["edge_id"].notna()]
        for s, d, _ in sorted(zip(rows["src"], rows["dst"], rows["edge_id"]), key=lambda r: r[2]):
            out.setdefault(s, []).append(d)
        depths, path, cycle, full = {start: 0}, {start}, False, False
        stack = [(start, iter(out.get(start, []) if depth > 0 else []))]
        while stack and not full:
            node, children = stack[-1]
            for d in children:
                if d in path:
                    cycle = True
                elif d not in depths:
                    if len(depths) >= most:
                        full = True
                        break
                    depths[d] = len(stack)
                    path.add(d)
                    stack.append((d, iter(out.get(d, []) if len(stack) < depth else [])))
                    break
            else:
                path.discard(node)
                stack.pop()
        return pd.DataFrame({"node_id": list(depths), "depth": list(depths.values()), "ord": range(len(depths)), "cycle_detected": cycle, "truncated": full})

    # a row without an edge, so that a start without edges is walked as well
    one = a.union(a.sparkSession.createDataFrame([(start, None, None)], "src string, dst string, edge_id string"))
    return one.groupBy().applyInPandas(walk, "node_id string, depth int, ord int, cycle_detected boolean, truncated boolean")


def lineage(graph: LineageGraph, root: str, depth: int = 0, relations=()) -> DataFrame:
    """(node_id, name, type, level): upstream levels below 0, downstream above;
    a node on both sides has its downstream level."""
    graph.require(root)
    sign = F.when(F.col("side") == "in", -F.col("depth")).otherwise(F.col("depth"))
    both = reach_sides(graph, _one(graph, root), depth, ("in", "out"), relations).groupBy("node_id").agg(F.max(sign).alias("level"))
    return both.join(graph.nodes.select(F.col("id").alias("node_id"), "name", "type"), "node_id").select("node_id", "name", "type", "level")


def lineage_view(graph: LineageGraph, root: str, depth: int = 0, relations=(), max_nodes: int = 0) -> dict[str, DataFrame]:
    """levels (node_id, name, type, level), edges among them, and one row of
    totals (upstream_count, downstream_count, truncated).

    Either side holds at most ``max_nodes`` nodes, the root included, in
    breadth-first order; a node on both sides counts on both.
    """
    up, cut_up = bfs(graph, root, depth, "in", relations, max_nodes=max_nodes)
    down, cut_down = bfs(graph, root, depth, "out", relations, max_nodes=max_nodes)
    sides = up.select(F.lit("in").alias("side"), "node_id", (-F.col("depth")).alias("level")).union(down.select(F.lit("out"), "node_id", "depth"))
    both = sides.groupBy("node_id").agg(F.max("level").alias("level"))
    levels = both.join(graph.nodes.select(F.col("id").alias("node_id"), "name", "type"), "node_id").select("node_id", "name", "type", "level")
    count = lambda side: F.count(F.when((F.col("side") == side) & (F.col("node_id") != root), 1))
    totals = sides.agg(count("in").alias("upstream_count"), count("out").alias("downstream_count")).withColumn("truncated", F.lit(cut_up or cut_down))
    return {"levels": levels, "edges": graph.induced(both.select("node_id"), relations), "totals": totals}


def impact(graph: LineageGraph, node_id: str, depth: int = 0) -> DataFrame:
    """One row: direct and total counts of both sides, greatest depth below,
    and whether a side holds more than the graph's limit of nodes."""
    return impact_of(lineage_sides(graph, node_id, depth), graph.limits.nodes)


def impact_of(sides: DataFrame, most: int) -> DataFrame:
    """The same from (side, node_id, depth): of each side the first ``most``
    nodes, the root among them, by depth count."""
    levels = sides.groupBy("side", "depth").agg(F.count(F.lit(1)).alias("n"))  # a row a level
    below = F.sum("n").over(Window.partitionBy("side").orderBy("depth"))
    levels = levels.withColumn("upto", below).withColumn("kept", F.least("n", F.greatest(F.lit(0), most - F.col("upto") + F.col("n"))))
    count = lambda side, direct: F.coalesce(F.sum(F.when((F.col("side") == side) & ((F.col("depth") == 1) if direct else (F.col("depth") > 0)), F.col("kept"))), F.lit(0))
    deepest = F.coalesce(F.max(F.when((F.col("side") == "out") & (F.col("kept") > 0), F.col("depth"))), F.lit(0))
    return levels.agg(count("out", True).alias("direct_downstream"), count("out", False).alias("total_downstream"), count("in", True).alias("direct_upstream"), count("in", False).alias("total_upstream"), deepest.alias("max_depth"), F.coalesce(F.max(F.col("upto") > most), F.lit(False)).alias("truncated"))


def lineage_sides(graph: LineageGraph, node_id: str, depth: int = 0) -> DataFrame:
    """(side, node_id, depth)"""
    graph.require(node_id)
    return reach_sides(graph, _one(graph, node_id), depth).drop("root")


def impact_by_type(graph: LineageGraph, node_id: str, depth: int = 0) -> DataFrame:
    """(type, n) of what is downstream."""
    graph.require(node_id)
    below = reach(graph, _one(graph, node_id), depth, "out").filter("depth > 0")
    return below.join(graph.nodes.select(F.col("id").alias("node_id"), "type"), "node_id").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
