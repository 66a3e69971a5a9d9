"""Traversal from many roots at once, a bit for each root.

Roots are numbered; 64 of them share a word. A node's row of a word says in 64
bits which of those roots have reached it, so that a round joins and shuffles
one row for each (node, word) and not for each (node, root), and what meets in
a node is merged by ``bit_or``, map-side first. What is new of a word is its
bits without those seen before. Counts are taken from the bits; pairs of root
and node are only made when they are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.plans.graph import LineageGraph
from provgraph.plans.iterate import Rounds, numbered
from provgraph.schema import clamp


def _bit(place: str):
    return F.expr(f"shiftleft(1L, cast({place} as int))")


@dataclass(frozen=True)
class ManyReach:
    """levels (node_id, word, bits, depth): the roots that first reach a node
    at a depth; roots (root, word, bit)."""

    levels: DataFrame
    roots: DataFrame

    def counts(self) -> DataFrame:
        """(root, depth, n): how many nodes each root first reaches at a depth;
        depth 0 is the root itself."""
        ones = [F.sum(F.expr(f"shiftrightunsigned(bits, {i}) & 1")).alias(f"b{i}") for i in range(64)]
        wide = self.levels.groupBy("word", "depth").agg(*ones)
        n = F.posexplode(F.array(*[F.col(f"b{i}") for i in range(64)])).alias("bit", "n")
        return wide.select("word", "depth", n).filter("n > 0").join(self.roots, ["word", "bit"]).select("root", "depth", "n")

    def pairs(self) -> DataFrame:
        """(root, node_id, depth)"""
        set_bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("bit_get", F.col("bits"), i) == 1)
        rows = self.levels.select("node_id", "word", "depth", F.explode(set_bits).alias("bit"))
        return rows.join(self.roots, ["word", "bit"]).select("root", "node_id", "depth")


def reach_many(graph: LineageGraph, roots: DataFrame, depth: int = 0, direction: str = "out", relations=(), types=()) -> ManyReach:
    """What each of any number of roots (one column of ids) reaches, as
    ``traverse.reach`` would say for each."""
    rounds = Rounds(graph.nodes.sparkSession)
    asked = roots.select(F.col(roots.columns[0]).alias("root")).distinct()
    known = rounds.save(numbered(asked, ["root"], "n").select("root", F.expr("n div 64").alias("word"), (F.col("n") % 64).cast("int").alias("bit")))
    a = graph.adjacency(direction, relations, types).select("src", "dst")
    front = known.groupBy(F.col("root").alias("node_id"), "word").agg(F.bit_or(_bit("bit")).alias("bits"))
    front = rounds.save(front.withColumn("depth", F.lit(0)))
    levels = front
    for level in range(1, clamp(depth, graph.limits.depth) + 1):
        met = front.join(a, F.col("node_id") == F.col("src")).groupBy(F.col("dst").alias("node_id"), "word").agg(F.bit_or("bits").alias("bits"))
        seen = levels.groupBy(F.col("node_id").alias("v"), F.col("word").alias("w")).agg(F.bit_or("bits").alias("seen"))
        fresh = met.join(seen, (F.col("node_id") == F.col("v")) & (F.col("word") == F.col("w")), "left")
        fresh = fresh.withColumn("bits", F.expr("bits & ~coalesce(seen, 0L)")).filter("bits != 0")
        front = rounds.save(fresh.select("node_id", "word", "bits", F.lit(level).alias("depth")))
        if front.isEmpty():
            break
        levels = levels.union(front)
    return ManyReach(levels, known)


def impact_many(graph: LineageGraph, roots: DataFrame, depth: int = 0) -> DataFrame:
    """(root, direct_downstream, total_downstream, max_depth) of many nodes."""
    n = reach_many(graph, roots, depth).counts()
    some = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    return n.groupBy("root").agg(some(F.col("depth") == 1).alias("direct_downstream"), some(F.col("depth") > 0).alias("total_downstream"), F.max("depth").alias("max_depth"))
