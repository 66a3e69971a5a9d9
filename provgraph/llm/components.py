"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, c) for every node of ``edges`` (a, b): nodes of one component, and
    they alone, share c.

    Each round maps a node to the neighbour, or itself, of least hash (drawn
    anew each round, so that no order of ids is slow) and contracts the edges.
    The number of nodes falls by a constant factor a round whatever the shape;
    the edge table never grows, and hubs are met by sums and minima only. No
    node set comes to the driver: only the count of edges left. Labels are
    written each round, so that plans stay as short as one round's.
    """
    tidy = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()
    edges = scratch.save(tidy(edges))
    labels, turn = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("c", F.col("v")), 0
    while not edges.isEmpty():
        rank = lambda x, t=turn: F.struct(F.xxhash64(x, F.lit(t)).alias("h"), F.col(x).alias("v"))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        lead = both.groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a")))["v"].alias("to"))
        lead = scratch.save(lead.select(F.col("a").alias("from"), "to").filter("from != to"))
        labels = scratch.save(labels.join(lead, F.col("c") == F.col("from"), "left").select("v", F.coalesce("to", "c").alias("c")))
        for end in ("a", "b"):
            edges = edges.join(lead, F.col(end) == F.col("from"), "left").withColumn(end, F.coalesce("to", end)).select("a", "b")
        edges = scratch.save(tidy(edges))
        turn += 1
    return labels
