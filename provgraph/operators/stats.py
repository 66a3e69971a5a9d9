"""Counts, degrees and the top-k view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.plans.graph import LineageGraph


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def degree(graph: LineageGraph, direction: str = "both") -> DataFrame:
    """(id, degree) of every node; both counts an edge once."""
    found = graph.adjacency(direction).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return graph.nodes.select("id").join(found, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def stats(graph: LineageGraph) -> DataFrame:
    """One row: sizes, mean and greatest degree, isolated nodes."""
    rows = degree(graph).select("degree").union(graph.edges.select(F.lit(None).cast("long")))  # null: an edge
    counts = rows.agg(F.count("degree").alias("node_count"), F.count(F.when(F.col("degree").isNull(), 1)).alias("edge_count"), F.coalesce(F.max("degree"), F.lit(0)).cast("long").alias("max_degree"), F.count(F.when(F.col("degree") == 0, 1)).alias("isolated_count"))
    mean = F.when(F.col("node_count") == 0, 0.0).otherwise(2.0 * F.col("edge_count") / F.col("node_count"))
    return counts.select("node_count", "edge_count", mean.alias("avg_degree"), "max_degree", "isolated_count")


def isolated(graph: LineageGraph) -> DataFrame:
    return graph.nodes.select("id").join(graph.adjacency("both").select(F.col("src").alias("id")), "id", "left_anti")


def top_nodes(graph: LineageGraph, types=(), limit: int = 0) -> DataFrame:
    """(id, degree): the nodes of greatest degree, ties by id; undirected
    edges count twice at either end here."""
    nodes = graph.nodes.filter(F.col("type").isin(*types)) if types else graph.nodes
    ends = graph.adjacency("out").select("src").union(graph.adjacency("in").select("src")).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    ranked = nodes.select("id").join(ends, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    return ranked.orderBy(F.desc("degree"), "id").limit(limit or graph.limits.topology)


def topology(graph: LineageGraph, types=(), relations=(), limit: int = 0) -> dict[str, DataFrame]:
    """nodes, edges among them, and one row of totals; the total of edges
    follows the relation filter only."""
    top = top_nodes(graph, types, limit)
    nodes = graph.nodes.join(top.select("id"), "id", "left_semi")
    kind = graph.nodes.filter(F.col("type").isin(*types)) if types else graph.nodes
    rel = graph.edges.filter(F.col("relation").isin(*relations)) if relations else graph.edges
    both = kind.select(F.lit(True).alias("node")).union(rel.select(F.lit(False)))
    totals = both.agg(F.count(F.when(F.col("node"), 1)).alias("total_nodes"), F.count(F.when(~F.col("node"), 1)).alias("total_edges"))
    totals = totals.withColumn("truncated", F.col("total_nodes") > (limit or graph.limits.topology))
    return {"nodes": nodes, "edges": graph.induced(top.select("id"), relations), "totals": totals}


def roots_and_leaves(graph: LineageGraph) -> tuple[DataFrame, DataFrame]:
    """Nodes without incoming, and without outgoing adjacency; by name, id."""
    without = lambda d: graph.nodes.join(graph.adjacency(d).select(F.col("src").alias("id")).distinct(), "id", "left_anti").select("id", "name", "type").orderBy("name", "id")
    return without("in"), without("out")
