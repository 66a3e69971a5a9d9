"""Shortest path by relaxation from both ends.

Labels (least cost known, and the edge by which it came) spread from the start
along the edges and from the goal against them, both in one loop. A round
relaxes, of each side, the open labels of the lowest bucket of costs; others
wait, as cheaper ones may still come. A node with labels of both sides bounds
the cost of the path by their sum.

Stop: let f and b be the least open costs of either side. A node nearer to the
start than f has its true label and was relaxed, since on a shortest way to it
the first node of which this is not so would be open at a cost below f; so with
b at the other end. On a path cheaper than f + b the first node that is not
nearer to the start than f is nearer to the goal than b, and has both true
labels. So once no open costs sum up to less than the least bound, the bound
is the cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.operators.paths import MERGE
from provgraph.plans.graph import LineageGraph
from provgraph.plans.iterate import Rounds

LABEL = ["side", "node_id", "cost", "hops", "near", "edge_id"]


def _best(labels: DataFrame) -> DataFrame:
    """One label of each node and side: least cost, then fewest edges, then
    least neighbour and edge."""
    order = F.struct("cost", "hops", "near", "edge_id")
    return labels.groupBy("side", "node_id").agg(F.min(order).alias("l")).select("side", "node_id", "l.*")


def two_ended(graph: LineageGraph, start: str, goal: str, direction: str = "out", relations=(), types=(), width: float = 0.0) -> tuple[DataFrame, int]:
    """(one row (found, cost, hops, node_ids, edge_ids), rounds).

    width: of a bucket; by default twice the mean weight. It changes the number
    of rounds and how much is relaxed in vain, never the cost.
    """
    graph.require(start, goal)
    spark, rounds = graph.nodes.sparkSession, Rounds(graph.nodes.sparkSession)
    a = graph.adjacency(direction, relations, types)
    away = a.select(F.lit("f").alias("s"), "src", "dst", F.col("edge_id").alias("e"), "weight")
    both = away.union(a.select(F.lit("b"), "dst", "src", "edge_id", "weight"))
    width = width or 2 * (a.agg(F.avg("weight")).first()[0] or 1.0)
    labels = spark.createDataFrame([("f", start, 0.0, 0, None, None), ("b", goal, 0.0, 0, None, None)], "side string, node_id string, cost double, hops int, near string, edge_id string")
    held, open_, turn, bound = rounds.save(labels), None, 0, None
    open_ = held
    while True:
        # two rows: the least open cost of each side
        least = {r.side: r.c for r in open_.groupBy("side").agg(F.min("cost").alias("c")).collect()}
        if len(least) < 2 or (bound is not None and least["f"] + least["b"] >= bound):
            break
        turn += 1
        limit = F.when(F.col("side") == "f", least["f"] + width).otherwise(least["b"] + width)
        now = open_.filter(F.col("cost") < limit)
        met = now.join(both, (F.col("side") == F.col("s")) & (F.col("node_id") == F.col("src")))
        tried = met.select("side", F.col("dst").alias("node_id"), (F.col("cost") + F.col("weight")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("node_id").alias("near"), F.col("e").alias("edge_id"))
        if bound is not None:
            tried = tried.filter(F.col("cost") <= bound)
        known = held.groupBy("side", "node_id").agg(F.min(F.struct("cost", "hops", "near", "edge_id")).alias("k"))
        fresh = _best(tried).join(known, ["side", "node_id"], "left")
        fresh = fresh.filter(F.col("k").isNull() | (F.struct("cost", "hops", "near", "edge_id") < F.col("k"))).select(*LABEL)
        fresh = rounds.save(fresh)
        held = held.union(fresh)
        if turn % MERGE == 0:
            held = rounds.save(_best(held))
        # open: what came now, and what waits unless something better came
        waiting = open_.filter(F.col("cost") >= limit).join(fresh.select("side", "node_id"), ["side", "node_id"], "left_anti")
        open_ = rounds.save(waiting.select(*LABEL).union(fresh))
        bound = _meeting(held).agg(F.min("total")).first()[0]
    row = _path(_best(held), start, goal, rounds) if bound is not None else _none(spark)
    return row, turn


def _meeting(held: DataFrame) -> DataFrame:
    """(node_id, total): nodes that both sides have labels of."""
    cost = lambda side: F.min(F.when(F.col("side") == side, F.col("cost")))
    sums = held.groupBy("node_id").agg(cost("f").alias("f"), cost("b").alias("b"))
    return sums.filter("f is not null and b is not null").select("node_id", (F.col("f") + F.col("b")).alias("total"))


def _none(spark) -> DataFrame:
    empty = F.array().cast("array<string>")
    return spark.range(1).select(F.lit(False).alias("found"), F.lit(None).cast("double").alias("cost"), F.lit(0).alias("hops"), empty.alias("node_ids"), empty.alias("edge_ids"))


def _path(labels: DataFrame, start: str, goal: str, rounds: Rounds) -> DataFrame:
    """The row of the path through the meeting node of least sum, then id; it
    is followed to both ends at once."""
    labels = rounds.save(labels)
    middle = _meeting(labels).orderBy("total", "node_id").limit(1)
    empty = F.array().cast("array<string>")
    path = middle.select("total", F.col("node_id").alias("head"), F.col("node_id").alias("tail"), F.array("node_id").alias("node_ids"), empty.alias("edge_ids"))
    path = rounds.save(path)
    side = lambda s: labels.filter(F.col("side") == s).select(F.col("node_id").alias(s), F.col("near").alias(f"{s}_near"), F.col("edge_id").alias(f"{s}_edge"))
    while not path.filter((F.col("head") != start) | (F.col("tail") != goal)).isEmpty():
        both = path.join(side("f"), F.col("head") == F.col("f"), "left").join(side("b"), F.col("tail") == F.col("b"), "left")
        one = lambda c: F.array_compact(F.array(c))
        path = rounds.save(both.select("total", F.coalesce("f_near", "head").alias("head"), F.coalesce("b_near", "tail").alias("tail"), F.concat(one("f_near"), "node_ids", one("b_near")).alias("node_ids"), F.concat(one("f_edge"), "edge_ids", one("b_edge")).alias("edge_ids")))
    return path.select(F.lit(True).alias("found"), F.col("total").alias("cost"), F.size("edge_ids").alias("hops"), "node_ids", "edge_ids")
