"""Adjacency matrix in long form, two-hop counts and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.errors import SubgraphTooLarge
from provgraph.plans.graph import LineageGraph
from provgraph.plans.iterate import Rounds


def subgraph(graph: LineageGraph, ids=None) -> LineageGraph:
    """The graph of some nodes (all without ids); an unknown id raises."""
    if not ids:
        return graph
    ids = sorted(set(ids))
    graph.require(*ids)
    nodes = graph.nodes.filter(F.col("id").isin(ids))
    return LineageGraph(nodes, graph.induced(nodes.select("id")), graph.limits)


def cells(graph: LineageGraph) -> DataFrame:
    """(i, j, weight) of non-zero cells. Of parallel edges one counts: above
    the diagonal the last by id; below it the last directed one, or else the
    last undirected."""
    e = graph.edges
    one = e.select(F.col("source_id").alias("i"), F.col("target_id").alias("j"), "id", "weight", "directed")
    both = one.union(e.filter("not directed").select("target_id", "source_id", "id", "weight", "directed"))
    rank = F.struct(F.when(F.col("i") < F.col("j"), 0).otherwise(F.col("directed").cast("int")).alias("first"), "id")
    return both.groupBy("i", "j").agg(F.max_by("weight", rank).alias("weight"))


def dense(graph: LineageGraph) -> DataFrame:
    """(i, row): a row of weights for each node, by id; small graphs only."""
    n = graph.nodes.count()
    if n > graph.limits.matrix:
        raise SubgraphTooLarge(f"{n} nodes; at most {graph.limits.matrix}")
    ids = [r.id for r in graph.nodes.select("id").orderBy("id").collect()]  # limits.matrix at most
    held = cells(graph).groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "weight"))).alias("m"))
    row = F.array(*[F.coalesce(F.try_element_at("m", F.lit(j)), F.lit(0.0)) for j in ids])
    return graph.nodes.select("id").join(held, F.col("id") == F.col("i"), "left").select(F.col("id").alias("i"), row.alias("row")).orderBy("i")


def density(graph: LineageGraph) -> DataFrame:
    """One row (node_count, edge_count, density)."""
    rows = graph.nodes.select(F.lit(True).alias("node")).union(graph.edges.select(F.lit(False)))
    counts = rows.agg(F.count(F.when(F.col("node"), 1)).alias("node_count"), F.count(F.when(~F.col("node"), 1)).alias("edge_count"))
    pairs = F.col("node_count") * (F.col("node_count") - 1)
    return counts.withColumn("density", F.when(F.col("node_count") <= 1, 0.0).otherwise(F.col("edge_count") / pairs))


def two_hop(graph: LineageGraph) -> DataFrame:
    """(i, j, n): number of nodes k with cells (i, k) and (k, j).

    A node's successors travel as lists, in parts, to those that precede it;
    they are spread and counted where all of an i's lists are, so that no row
    of a way (i, k, j) is shuffled.
    """
    c = cells(graph).select("i", "j")
    lists = c.groupBy(F.col("i").alias("k"), F.pmod(F.xxhash64("j"), F.lit(16)).alias("part")).agg(F.collect_list("j").alias("js"))
    met = c.withColumnRenamed("j", "k").join(lists, "k").select("i", "js").repartition("i")
    return met.select("i", F.explode("js").alias("j")).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def _contract(live: DataFrame, rounds: Rounds) -> DataFrame | None:
    """(from, to): where each end of some pairs (a, b) of different nodes, told
    apart and written, ends when what is linked is contracted by random
    neighbours; the number of nodes falls by a constant factor a round, for
    chains as well as for stars. None without pairs."""
    leads: list[DataFrame] = []
    while not live.isEmpty():
        rank = lambda x, t=len(leads): F.struct(F.xxhash64(x, F.lit(t)).alias("h"), F.col(x).alias("v"))
        both = live.union(live.select("b", "a"))
        lead = rounds.save(both.groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a")))["v"].alias("to")).withColumnRenamed("a", "from"))
        leads.append(lead)
        live = _moved(live, lead, rounds)
    if not leads:
        return None
    # where each round's nodes end, from the last round back: each table has
    # the nodes of its round alone, which grow by a constant factor
    ends = leads.pop()
    while leads:
        further = ends.withColumnsRenamed({"from": "f", "to": "end"})
        ends = leads.pop().join(further, F.col("to") == F.col("f"), "left").select("from", F.coalesce("end", "to").alias("to"))
        ends = rounds.save(ends) if len(leads) % 2 else ends
    return rounds.save(ends)


def _moved(pairs: DataFrame, lead: DataFrame, rounds: Rounds) -> DataFrame:
    """The pairs between what their ends lead to, where that differs."""
    moved = pairs.join(lead.withColumnsRenamed({"from": "f", "to": "ta"}), F.col("a") == F.col("f")).join(lead.withColumnsRenamed({"from": "g", "to": "tb"}), F.col("b") == F.col("g"))
    return rounds.save(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a != b").distinct())


def _labels(graph: LineageGraph, rounds: Rounds) -> DataFrame:
    """(id, c): nodes that are linked have the same c.

    First the pairs of each node's least and greatest neighbour are contracted,
    one a node at most, and a node goes where its least neighbour goes; that
    joins most of what is joined. Of the edges only those are looked at again
    that have an end outside of the largest part so far.
    """
    nodes = graph.nodes.select("id")
    pairs = graph.edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).filter("a != b")
    near = pairs.union(pairs.select("b", "a")).groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    near = rounds.save(near)
    if near.isEmpty():
        return nodes.withColumn("c", F.col("id"))
    ends = near.select(F.col("a").alias("from"), F.col("lo").alias("to"))
    ends = _further(ends, _contract(rounds.save(near.filter("lo != hi").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()), rounds))
    ends = rounds.save(ends)
    largest = ends.groupBy("to").count().orderBy(F.desc("count"), "to").first()["to"]
    outside = rounds.save(ends.filter(F.col("to") != largest).select("from"))
    if not outside.isEmpty():
        at = lambda end: pairs.join(outside.withColumnRenamed("from", end), end, "left_semi").select("a", "b")
        ends = _further(ends, _contract(_moved(at("a").union(at("b")), ends, rounds), rounds))
    return rounds.save(nodes.join(ends, F.col("id") == F.col("from"), "left").select("id", F.coalesce("to", "id").alias("c")))


def _further(ends: DataFrame, more: DataFrame | None) -> DataFrame:
    """(from, to), and on to where ``more`` says that these lead."""
    if more is None:
        return ends
    more = more.withColumnsRenamed({"from": "f", "to": "end"})
    return ends.join(more, F.col("to") == F.col("f"), "left").select("from", F.coalesce("end", "to").alias("to"))


def components(graph: LineageGraph) -> DataFrame:
    """(id, component): weakly connected; named by the smallest id in it."""
    rounds = Rounds(graph.nodes.sparkSession)
    labels = _labels(graph, rounds)
    names = labels.groupBy("c").agg(F.min("id").alias("component"))
    return rounds.finish(labels.join(names, "c").select("id", "component"))


def component_sizes(graph: LineageGraph) -> DataFrame:
    """(component, size), largest first."""
    rounds = Rounds(graph.nodes.sparkSession)
    sizes = _labels(graph, rounds).groupBy("c").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("size"))
    return rounds.finish(sizes.select("component", "size")).orderBy(F.desc("size"), "component")


def analysis(graph: LineageGraph, ids=None) -> dict[str, DataFrame]:
    """The subgraph of some nodes (all without ids): nodes by id, cells,
    two_hop, components (id, component), and one row of sizes.

    More than ``limits.matrix`` nodes raise: of a part of them density and
    components would be wrong.
    """
    part = subgraph(graph, ids)
    if (n := part.nodes.limit(part.limits.matrix + 1).count()) > part.limits.matrix:
        raise SubgraphTooLarge(f"at least {n} nodes; at most {part.limits.matrix}")
    labels = components(part)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.agg(F.count(F.lit(1)).alias("component_count"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_component"))
    return {"nodes": part.nodes.select("id", "name").orderBy("id"), "cells": cells(part), "two_hop": two_hop(part), "components": labels, "summary": density(part).join(F.broadcast(sizes))}
