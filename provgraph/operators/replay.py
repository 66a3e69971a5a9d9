"""Folding the log into nodes and edges, now or at an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provgraph.errors import ValidationError
from provgraph.schema import EDGE_PAYLOAD, NODE_PAYLOAD


def fold(log: DataFrame, until=None, strict: bool = False, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the log's events not later than ``until``.

    An entity is as its last event by seq says. A node's delete takes along
    edges put before it. Strict: an edge put without both ends alive raises;
    otherwise edges without both ends are left out. ``nodes`` and ``edges``
    are a state that the log continues.
    """
    rows = log if until is None else log.filter(F.col("occurred_at") <= until)
    if strict and violations(rows, nodes).limit(1).count():
        raise ValidationError("an edge was put while one of its ends was not there")
    last = F.max_by(F.struct("event_type", "payload", "occurred_at"), "seq").alias("e")
    ended = rows.groupBy("entity_type", "entity_id").agg(last, F.max("seq").alias("seq"))
    node = F.from_json("e.payload", NODE_PAYLOAD)
    edge = F.from_json("e.payload", EDGE_PAYLOAD)
    alive = ended.filter(~F.col("e.event_type").endswith("_deleted"))
    new_nodes = alive.filter("entity_type = 'node'").select(node.alias("n"), F.col("e.occurred_at").alias("updated_at")).select("n.*", "updated_at")
    put = alive.filter("entity_type = 'edge'").select(edge.alias("n"), F.col("e.occurred_at").alias("updated_at"), "seq").select("n.*", "updated_at", "seq")
    put = put.withColumn("directed", F.coalesce("directed", F.lit(False)))
    if nodes is not None:
        touched = ended.select(F.col("entity_id").alias("id"), "entity_type")
        kept = lambda df, kind: df.join(touched.filter(F.col("entity_type") == kind), "id", "left_anti")
        new_nodes = new_nodes.unionByName(kept(nodes, "node").select(new_nodes.columns))
        put = put.unionByName(kept(edges, "edge").withColumn("seq", F.lit(0).cast("bigint")).select(put.columns))
    gone = rows.filter("event_type = 'node_deleted'").groupBy("entity_id").agg(F.max("seq").alias("gone"))
    for end in ("source_id", "target_id"):
        named = gone.withColumnsRenamed({"entity_id": "g", "gone": "at"})
        put = put.join(named, (F.col(end) == F.col("g")) & (F.col("at") > F.col("seq")), "left_anti")
        if not strict:
            put = put.join(new_nodes.select(F.col("id").alias(end)), end, "left_semi")
    return new_nodes, put.select("id", "source_id", "target_id", "relation", "weight", "directed", "properties", "updated_at")


def violations(log: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(seq, edge_id, node_id): edge puts whose end was not alive then."""
    put = log.filter("event_type in ('edge_created', 'edge_updated')").select("seq", "entity_id", F.from_json("payload", EDGE_PAYLOAD).alias("n"))
    asked = put.select(F.explode(F.array("n.source_id", "n.target_id")).alias("node_id"), "seq", F.col("entity_id").alias("edge_id"))
    known = log.filter("entity_type = 'node'").select(F.col("entity_id").alias("node_id"), "seq", (F.col("event_type") != "node_deleted").alias("alive"))
    if nodes is not None:
        known = known.union(nodes.select("id", F.lit(0).cast("bigint"), F.lit(True)))
    # the spans of numbers in which a node is alive come of its own events alone;
    # the puts that name it meet them by a join, so that a hot end can be split
    w = Window.partitionBy("node_id").orderBy("seq")
    turns = known.withColumn("was", F.lag("alive").over(w)).filter("was is null or was != alive").withColumn("until", F.lead("seq").over(w))
    spans = turns.filter("alive").select(F.col("node_id").alias("n"), F.col("seq").alias("since"), "until")
    inside = (F.col("node_id") == F.col("n")) & (F.col("seq") > F.col("since")) & F.coalesce(F.col("seq") < F.col("until"), F.lit(True))
    return asked.join(spans, inside, "left_anti").select("seq", "edge_id", "node_id")


def restore(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A snapshot's tables, or ValidationError if any row breaks a rule, an
    edge lacks an end, or an id or relation stands there twice: rather no
    graph than a part of one."""
    from provgraph.functions.validation import dangling_edges, duplicate_edges, edge_rules, node_rules, require_valid

    require_valid(nodes, node_rules())
    require_valid(edges, edge_rules())
    for found, what in (
        (nodes.groupBy("id").count().filter("count > 1"), "a node's id stands there twice"),
        (edges.groupBy("id").count().filter("count > 1"), "an edge's id stands there twice"),
        (dangling_edges(edges, nodes), "an edge lacks an end"),
        (duplicate_edges(edges), "two edges state one relation"),
    ):
        if not found.isEmpty():
            raise ValidationError(what)
    return nodes, edges


def replay_live(store, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The current state, from the latest checkpoint on if there is one."""
    last = store.latest_checkpoint()
    if last is None:
        return fold(store.events(), strict=strict)
    seq, nodes, edges = last
    return fold(store.range(seq), None, strict, nodes, edges)


def snapshot_at(log: DataFrame, at, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """The state at an instant; always from the first event, since order of
    numbers and of times may differ."""
    return fold(log, at, strict)
