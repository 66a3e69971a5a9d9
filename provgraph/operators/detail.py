"""Composed views: one node with all that is known of it, and the graph's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.functions.scalars import LABELS
from provgraph.operators import order, traverse
from provgraph.operators.search import property_keys
from provgraph.operators.stats import roots_and_leaves, stats, topology
from provgraph.plans.graph import LineageGraph
from provgraph.schema import EVENT_TYPES, NODE_TYPES, RELATIONS


def node_detail(graph: LineageGraph, log: DataFrame, node_id: str) -> dict[str, DataFrame]:
    """summary: one row (the node, in_degree, out_degree, impact's columns,
    event_count); by_type: what is downstream by type; incident: its edges.

    Impact goes as deep as the graph's limit.
    """
    node = graph.node(node_id)
    ends = graph.incident_edges(node_id)
    # an undirected edge can be walked both ways
    into, out = ((F.col(end) == node_id) | ~F.col("directed") for end in ("target_id", "source_id"))
    degrees = ends.agg(F.count(F.when(into, 1)).alias("in_degree"), F.count(F.when(out, 1)).alias("out_degree"))
    events = log.filter(F.col("entity_id") == node_id).agg(F.count(F.lit(1)).alias("event_count"))
    sides = traverse.lineage_sides(graph, node_id)
    summary = node.select("id", "name", "type", "properties")
    for one_row in (degrees, traverse.impact_of(sides, graph.limits.nodes), events):
        summary = summary.join(F.broadcast(one_row))
    below = sides.filter("side = 'out' and depth > 0").select("node_id")
    by_type = graph.nodes.join(below, F.col("id") == F.col("node_id"), "left_semi").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return {"summary": summary, "by_type": by_type, "incident": ends}


def structure(graph: LineageGraph, most: int = 50) -> dict[str, DataFrame]:
    """summary: one row (stats' columns, has_cycle, topo_length); the first
    ``most`` roots and leaves."""
    roots, leaves = roots_and_leaves(graph)
    summary = stats(graph).join(F.broadcast(order.has_cycle(graph)))
    return {"summary": summary, "roots": roots.limit(most), "leaves": leaves.limit(most)}


def history_view(graph: LineageGraph, log: DataFrame, at, limit: int = 0) -> dict[str, DataFrame]:
    """The graph of an instant as it is shown: the ``limit`` nodes of greatest
    degree, the edges among them, totals (total_nodes, total_edges,
    truncated), and replay (events_applied, last_seq) of the log until then."""
    applied = log.filter(F.col("occurred_at") <= at).agg(F.count(F.lit(1)).alias("events_applied"), F.coalesce(F.max("seq"), F.lit(0)).alias("last_seq"))
    return topology(graph, limit=limit) | {"replay": applied}


def fixed_facts(limits) -> list[tuple[str, str, str]]:
    """(kind, value, label) of the closed sets and the limits."""
    rows = [("node_type", v, v) for v in NODE_TYPES] + [("relation", v, v) for v in RELATIONS] + [("event_type", v, LABELS[v]) for v in EVENT_TYPES]
    return rows + [("limit", name, str(value)) for name, value in vars(limits).items()]


def metadata(graph: LineageGraph) -> DataFrame:
    """(kind, value, label): the closed sets, the property keys in use, the
    limits and the sizes, for filters and forms."""
    spark = graph.nodes.sparkSession
    rows = spark.createDataFrame(fixed_facts(graph.limits), "kind string, value string, label string")
    keys = property_keys(graph.nodes).select(F.lit("property_key"), "key", "key")
    sizes = stats(graph)
    sizes = sizes.select(F.inline(F.array(*[F.struct(F.lit("stat").alias("kind"), F.lit(c).alias("value"), F.col(c).cast("string").alias("label")) for c in sizes.columns])))
    return rows.union(keys).union(sizes)
