"""Weighted shortest path and simple paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.plans.graph import LineageGraph
from provgraph.plans.iterate import Rounds
from provgraph.schema import clamp


#: Rounds whose improvements are kept apart before they are merged.
MERGE = 8
#: Counted rows of nodes and costs, some MB at most, that are broadcast.
SMALL = 50_000


def distances(graph: LineageGraph, start: str, goal: str | None = None, direction: str = "out", relations=(), types=()) -> tuple[DataFrame, DataFrame]:
    """((node_id, cost, hop), adjacency): least cost from ``start`` by rounds
    of relaxation, and the fewest edges by which it is reached; what costs more
    than the goal's best is cut off.

    A round writes what it improved; those few tables together are the costs
    so far, and every ``MERGE`` rounds they become one. As a round adds one
    edge to every way, the first round that finds a node's least cost is the
    fewest edges. An edge that weighs more than the goal's best is on no way
    that counts and is left out; once no more than a quarter is left, those are
    written, and later rounds and the caller read them alone.
    """
    rounds, left = Rounds(graph.nodes.sparkSession), Rounds(graph.nodes.sparkSession)
    a = graph.adjacency(direction, relations, types)
    front = rounds.save(graph.nodes.filter(F.col("id") == start).select(F.col("id").alias("node_id"), F.lit(0.0).alias("cost"), F.lit(0).alias("hop")))
    held, turn, bound, looked, size = front, 0, None, None, 0
    least = lambda df: df.groupBy("node_id").agg(F.min(F.struct("cost", "hop")).alias("l")).select("node_id", "l.*")
    # one row: how many improved, and the goal's cost if it did
    state = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("node_id") == goal, F.col("cost")) if goal is not None else F.lit(None)).alias("c")).first()
    seen = state(front)
    while seen.n:
        turn += 1
        if seen.c is not None:
            bound = seen.c
        if bound is not None and (looked is None or bound < looked / 2):
            size, looked, n = size or a.count(), bound, a.filter(F.col("weight") <= bound).count()
            if n <= size / 4:
                a, size = left.save(a.filter(F.col("weight") <= bound)), n
        counts = a if bound is None else a.filter(F.col("weight") <= bound)
        tried = small(front, seen.n).join(counts, F.col("node_id") == F.col("src")).groupBy("dst").agg(F.min(F.col("cost") + F.col("weight")).alias("new"))
        if bound is not None:
            tried = tried.filter(F.col("new") <= bound)
        front = tried.join(least(held), F.col("dst") == F.col("node_id"), "left").filter(F.col("cost").isNull() | (F.col("new") < F.col("cost")))
        front = rounds.save(front.select(F.col("dst").alias("node_id"), F.col("new").alias("cost"), F.lit(turn).alias("hop")))
        held, seen = held.union(front), state(front)
        if turn % MERGE == 0:
            held = rounds.save(least(held))
    return rounds.finish(least(held)), a if bound is None else a.filter(F.col("weight") <= bound)


def small(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows, to be broadcast where those are few."""
    return F.broadcast(df) if n <= SMALL else df


def shortest_path(graph: LineageGraph, start: str, goal: str, direction: str = "out", relations=(), types=(), max_visit: int = 0) -> DataFrame:
    """One row (found, cost, hops, node_ids, edge_ids, visited_count,
    truncated).

    A node's predecessor is the least (distance, node, edge) of those by which
    its distance is reached, so that ties have one answer. Nodes are visited by
    (cost, id), the goal last; a goal that is not among the first ``max_visit``
    counts as not found, and the row as truncated.
    """
    graph.require(start, goal)
    most = clamp(max_visit, graph.limits.nodes)
    best, a = distances(graph, start, goal, direction, relations, types)
    rounds = Rounds(graph.nodes.sparkSession)
    cost = best.filter(F.col("node_id") == goal).select("cost").collect()  # one row
    before = best.filter((F.col("cost") < cost[0].cost) | ((F.col("cost") == cost[0].cost) & (F.col("node_id") <= goal))) if cost else best
    seen = before.count()
    truncated = seen > most or (not cost and seen == most)
    visited = F.lit(min(seen, most)).cast("long").alias("visited_count")
    n = best.count()
    d, t = (small(best.select(F.col("node_id").alias(end), F.col("cost").alias(f"{way}_cost"), *also), n) for end, way, also in (("src", "from", ["hop"]), ("dst", "to", [])))
    tight = a.join(d, "src").join(t, "dst").filter((F.col("from_cost") + F.col("weight") == F.col("to_cost")) & (F.col("dst") != start))
    tight = rounds.save(tight)
    if tight.filter("from_cost = to_cost").isEmpty():
        # only along edges of weight 0 cost alone could lead in circles: fewest hops first
        tight = tight.withColumn("hop", F.lit(0))
    pred = rounds.save(tight.groupBy("dst").agg(F.min(F.struct("from_cost", "hop", "src", "edge_id")).alias("p")).select("dst", "p.src", "p.edge_id"))
    empty = F.array().cast("array<string>")
    path = best.filter(F.col("node_id") == goal).select("node_id", "cost", F.array("node_id").alias("node_ids"), empty.alias("edge_ids"))
    path = rounds.save(path)
    while not path.filter(F.col("node_id") != start).isEmpty():
        path = path.join(pred, F.col("node_id") == F.col("dst")).select(F.col("src").alias("node_id"), "cost", F.concat(F.array("src"), "node_ids").alias("node_ids"), F.concat(F.array("edge_id"), "edge_ids").alias("edge_ids"))
        path = rounds.save(path)
    row = path.filter(F.lit(not truncated)).select(F.lit(True).alias("found"), "cost", F.size("edge_ids").alias("hops"), "node_ids", "edge_ids")
    none = graph.nodes.sparkSession.range(1).select(F.lit(False), F.lit(None).cast("double"), F.lit(0), empty, empty)
    return row.union(none.filter(F.lit(truncated or not cost))).select("*", visited, F.lit(truncated).alias("truncated"))


def all_paths(graph: LineageGraph, start: str, goal: str, depth: int = 0, max_paths: int = 0, direction: str = "out", relations=(), types=()) -> tuple[DataFrame, bool]:
    """((node_ids, edge_ids, cost, hops), truncated): simple paths of at most
    ``depth`` edges; the first max_paths by edge ids, then by cost and hops."""
    found = path_view(graph, start, goal, depth, max_paths, direction, relations, types)
    return found["paths"], found["truncated"]


def path_view(graph: LineageGraph, start: str, goal: str, depth: int = 0, max_paths: int = 0, direction: str = "out", relations=(), types=()) -> dict:
    """paths (node_ids, edge_ids, cost, hops), the nodes and edges on any of
    them, whether there are more paths (truncated), and explored_edges.

    A path grows only to nodes from which the goal is near enough. Once there
    are more than ``max_paths`` paths, what comes after the last of them in
    order of edge ids is dropped, in each round, so that the bound holds while
    paths grow and not only at the end.
    """
    graph.require(start, goal)
    most, depth = clamp(max_paths, graph.limits.paths), clamp(depth, graph.limits.depth)
    rounds = Rounds(graph.nodes.sparkSession)
    back = {"out": "in", "in": "out", "both": "both"}[direction]
    # a filter on types tests what is reached: on the way back, all but the goal
    a = graph.adjacency(direction, relations, types)
    near = _hops_to(graph, goal, depth, back, relations, rounds).withColumnsRenamed({"node_id": "g", "depth": "left"})
    a = a.join(near, F.col("dst") == F.col("g"))
    open_ = graph.nodes.filter(F.col("id") == start).select(F.col("id").alias("cur"), F.array("id").alias("node_ids"), F.array().cast("array<string>").alias("edge_ids"), F.lit(0.0).alias("cost"))
    open_ = rounds.save(open_)
    done, last, explored = open_.filter(F.col("cur") == goal), None, 0
    for level in range(1, 1 if start == goal else depth + 1):
        met = open_.join(a, F.col("cur") == F.col("src")).filter(F.col("left") <= depth - level)
        grown = met.select(F.col("dst").alias("cur"), F.array_contains("node_ids", F.col("dst")).alias("again"), F.concat("node_ids", F.array("dst")).alias("node_ids"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"), (F.col("cost") + F.col("weight")).alias("cost"))
        grown = rounds.save(grown)
        explored += grown.count()
        grown = grown.filter("not again").drop("again")
        if last is not None:
            grown = grown.filter(F.col("edge_ids") <= F.array(*map(F.lit, last)))
        done = done.union(grown.filter(F.col("cur") == goal))
        open_ = grown.filter(F.col("cur") != goal)
        if open_.isEmpty():
            break
        first = done.select("edge_ids").orderBy("edge_ids").offset(most).limit(1).collect()  # one row
        last = first[0].edge_ids if first else None
    first = rounds.save(done.orderBy("edge_ids").limit(most + 1))
    kept = first.orderBy("edge_ids").limit(most)
    paths = kept.select("node_ids", "edge_ids", "cost", F.size("edge_ids").alias("hops")).orderBy("cost", "hops", "node_ids", "edge_ids")
    on = lambda column, rows: rows.join(kept.select(F.explode(column).alias("id")).distinct(), "id", "left_semi")
    return {"paths": paths, "nodes": on("node_ids", graph.nodes), "edges": on("edge_ids", graph.edges), "truncated": first.count() > most, "explored_edges": explored}


def _hops_to(graph: LineageGraph, goal: str, depth: int, direction: str, relations, rounds: Rounds) -> DataFrame:
    from provgraph.operators.traverse import reach

    return rounds.save(reach(graph, graph.nodes.filter(F.col("id") == goal).select("id"), depth, direction, relations).select("node_id", "depth"))
