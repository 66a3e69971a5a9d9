"""Graphs and an event log derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: (table, key column, letter of the id, node type)
ENTITIES = (("region", "r_regionkey", "R", "server"), ("nation", "n_nationkey", "N", "database"), ("customer", "c_custkey", "C", "person"), ("supplier", "s_suppkey", "S", "application"), ("part", "p_partkey", "P", "api"), ("orders", "o_orderkey", "O", "account"))


def key_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the foreign-key graph: one for each row of six tables."""
    out = None
    for table, key, letter, kind in ENTITIES:
        rows = read(spark, folder, table).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.concat(F.lit(table + " "), F.col(key).cast("string")).alias("name"), F.lit(kind).alias("type"), F.concat(F.lit('{"key":'), F.col(key).cast("string"), F.lit("}")).alias("properties"))
        out = rows if out is None else out.union(rows)
    return out


def key_pairs(spark: SparkSession, folder: str, repeats: bool = False) -> DataFrame:
    """(a, a_key, b, b_key, relation): the foreign keys, letters and numbers
    of both ends. With ``repeats`` an order or a supplier may stand with one
    part in many rows, which spares telling all pairs apart."""
    n, c, s, o, li = (read(spark, folder, t) for t in ("nation", "customer", "supplier", "orders", "lineitem"))
    pair = lambda df, a, key, b, other, relation: df.select(F.lit(a).alias("a"), F.col(key).alias("a_key"), F.lit(b).alias("b"), F.col(other).alias("b_key"), F.lit(relation).alias("relation"))
    some = lambda x, y: li.select(x, y) if repeats else li.select(x, y).distinct()
    pairs = pair(n, "N", "n_nationkey", "R", "n_regionkey", "deploys_on")
    pairs = pairs.union(pair(c, "C", "c_custkey", "N", "c_nationkey", "depends_on")).union(pair(s, "S", "s_suppkey", "N", "s_nationkey", "depends_on"))
    pairs = pairs.union(pair(o, "C", "o_custkey", "O", "o_orderkey", "owns"))
    pairs = pairs.union(pair(some("l_orderkey", "l_partkey"), "O", "l_orderkey", "P", "l_partkey", "reads_from"))
    return pairs.union(pair(some("l_suppkey", "l_partkey"), "S", "l_suppkey", "P", "l_partkey", "writes_to"))


def edges_of(pairs: DataFrame) -> DataFrame:
    """The edges that pairs of keys stand for; directed, weight 1."""
    end = lambda letter, key: F.concat(letter, F.col(key).cast("string"))
    edges = pairs.select(end("a", "a_key").alias("source_id"), end("b", "b_key").alias("target_id"), "relation")
    return edges.select(F.concat_ws("-", "source_id", "relation", "target_id").alias("id"), "*", F.lit(1.0).alias("weight"), F.lit(True).alias("directed"), F.lit("{}").alias("properties"))


def key_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the foreign-key graph; directed, weight 1, without cycles."""
    return edges_of(key_pairs(spark, folder))


def flow_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the flow graph: from each event's user to the next event's.

    ``lead`` over the whole table would be one task; events are numbered
    without gaps, so the successor is found by an equi-join on the number.
    """
    e = read(spark, folder, "events").select("event_id", F.col("user_id").alias("u"), F.col("event_type").alias("et"), F.col("value").alias("w"))
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("u").alias("v"))
    t = e.join(after, "event_id").filter("u != v")
    free = F.col("et") == "signup"
    relation = F.when(F.col("et") == "click", "calls").when(F.col("et") == "view", "reads_from").when(F.col("et") == "purchase", "transfers_to").when(F.col("et") == "error", "depends_on").otherwise("associates_with")
    m = t.select(F.when(free, F.least("u", "v")).otherwise(F.col("u")).alias("s"), F.when(free, F.greatest("u", "v")).otherwise(F.col("v")).alias("d"), relation.alias("relation"), (~free).alias("directed"), "w")
    m = m.groupBy("s", "d", "relation", "directed").agg(F.min("w").alias("weight"))
    user = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    m = m.select(user("s").alias("source_id"), user("d").alias("target_id"), "relation", "weight", "directed")
    return m.select(F.concat_ws("-", "source_id", "relation", "target_id").alias("id"), "*", F.lit("{}").alias("properties"))


def flow_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One account for each user of the events."""
    u = read(spark, folder, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id")).distinct()
    return u.select("id", F.col("id").alias("name"), F.lit("account").alias("type"), F.lit("{}").alias("properties"))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """A log of node and edge changes, one for each event."""
    e = read(spark, folder, "events")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    other = F.concat(F.lit("u"), ((F.col("user_id") + 1) % 50).cast("string"))
    kind = F.when(F.col("event_type") == "signup", "node_created").when(F.col("event_type") == "view", "node_updated").when(F.col("event_type") == "error", "node_deleted")
    kind = kind.when(F.col("event_type") == "click", "edge_updated").when(F.col("event_id") % 4 == 3, "edge_deleted").otherwise("edge_created")
    is_node = kind.startswith("node")
    node = F.concat(F.lit('{"id":"'), user, F.lit('","name":"'), user, F.lit('","type":"account","properties":'), F.col("props"), F.lit("}"))
    edge = F.concat(F.lit('{"id":"'), user, F.lit("-"), other, F.lit('","source_id":"'), user, F.lit('","target_id":"'), other, F.lit('","relation":"transfers_to","weight":'), F.col("value").cast("string"), F.lit(',"directed":true,"properties":'), F.col("props"), F.lit("}"))
    return e.select(
        (F.col("event_id") + 1).alias("seq"), kind.alias("event_type"), F.when(is_node, "node").otherwise("edge").alias("entity_type"),
        F.when(is_node, user).otherwise(F.concat(user, F.lit("-"), other)).alias("entity_id"),
        F.when(kind.endswith("_deleted"), F.lit(None)).when(is_node, node).otherwise(edge).alias("payload"),
        F.lit(None).cast("string").alias("before"), F.lit("system").alias("actor"), F.lit("").alias("reason"), F.col("ts").alias("occurred_at"),
    )
