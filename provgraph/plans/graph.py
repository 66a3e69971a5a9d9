"""The property graph as two DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.errors import EdgeNotFound, NodeNotFound, ValidationError
from provgraph.plans.iterate import Rounds
from provgraph.schema import Limits


@dataclass(frozen=True)
class LineageGraph:
    """Nodes (id, name, type, properties) and edges (id, source_id, target_id,
    relation, weight, directed, properties)."""

    nodes: DataFrame
    edges: DataFrame
    limits: Limits = field(default_factory=Limits)

    def saved(self) -> LineageGraph:
        """The same graph with its edges written once, for those whose edges
        take joins or sums to make."""
        return LineageGraph(self.nodes, Rounds(self.nodes.sparkSession).save(self.edges), self.limits)

    def adjacency(self, direction: str = "out", relations: Iterable[str] = (), types: Iterable[str] = ()) -> DataFrame:
        """(src, dst, edge_id, relation, weight); the filters are applied here
        once, before any loop. ``types`` tests the node that is reached."""
        e = self.edges
        if relations := list(relations):
            e = e.filter(F.col("relation").isin(relations))
        cols = [F.col("id").alias("edge_id"), "relation", "weight"]
        fwd = e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), *cols, "directed")
        rev = e.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), *cols, "directed")
        if direction == "out":
            a = fwd.union(rev.filter("not directed"))
        elif direction == "in":
            a = rev.union(fwd.filter("not directed"))
        elif direction == "both":
            a = fwd.union(rev)
        else:
            raise ValidationError(f"unknown direction {direction!r}")
        a = a.drop("directed")
        if types := list(types):
            a = a.join(self.nodes.filter(F.col("type").isin(types)).select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "edge_id", "relation", "weight")
        return a

    def require(self, *ids: str) -> None:
        """Raise for the first id that is no node."""
        found = {r.id for r in self.nodes.filter(F.col("id").isin(*ids)).select("id").collect()}  # as many as asked
        for i in ids:
            if i not in found:
                raise NodeNotFound(i)

    def node(self, node_id: str) -> DataFrame:
        self.require(node_id)
        return self.nodes.filter(F.col("id") == node_id)

    def edge(self, edge_id: str) -> DataFrame:
        row = self.edges.filter(F.col("id") == edge_id)
        if row.isEmpty():
            raise EdgeNotFound(edge_id)
        return row

    def incident_edges(self, node_id: str) -> DataFrame:
        return self.edges.filter((F.col("source_id") == node_id) | (F.col("target_id") == node_id)).orderBy("id")

    def induced(self, ids: DataFrame, relations: Iterable[str] = ()) -> DataFrame:
        """Edges with both ends in ``ids`` (one column); relations alone are
        filtered."""
        e = self.edges
        if relations := list(relations):
            e = e.filter(F.col("relation").isin(relations))
        name = ids.columns[0]
        for end in ("source_id", "target_id"):
            e = e.join(ids.select(F.col(name).alias(end)), end, "left_semi")
        return e.select(*self.edges.columns)
