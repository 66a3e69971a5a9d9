"""Differences between two states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.errors import ValidationError
from provgraph.operators.replay import snapshot_at


def properties(entities: DataFrame) -> DataFrame:
    """(id, key, kind, text, number) of every property; numbers compare by
    value, nested objects by their text with sorted keys."""
    rows = entities.select("id", F.explode(F.from_json(F.coalesce("properties", F.lit("{}")), "map<string,variant>")).alias("key", "v"))
    kind = F.schema_of_variant("v")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return rows.select("id", "key", F.when(number, "number").otherwise(kind).alias("kind"), F.to_json("v").alias("text"), F.when(number, F.try_variant_get("v", "$", "double")).alias("number"))


def diff_entities(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): added or removed."""
    a, b = before.select("id"), after.select("id")
    return b.join(a, "id", "left_anti").withColumn("change", F.lit("added")).union(a.join(b, "id", "left_anti").withColumn("change", F.lit("removed")))


def diff_fields(before: DataFrame, after: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(id, field, before, after) of entities in both states; property fields
    are called properties.<key>. Times and endpoints are not compared."""
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, "id").select("id", *[F.col(f"{s}.{f}").cast("string").alias(f"{s}_{f}") for f in fields for s in "ab"])
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("before"), F.col(f"b_{f}").alias("after")) for f in fields])
    plain = both.select("id", F.inline(listed)).filter(~F.col("before").eqNullSafe(F.col("after")))
    ids = both.select("id")
    p, q = properties(before).join(ids, "id", "left_semi").alias("p"), properties(after).join(ids, "id", "left_semi").alias("q")
    j = p.join(q, ["id", "key"], "full_outer")
    same = F.col("p.kind").eqNullSafe(F.col("q.kind")) & F.when(F.col("p.kind") == "number", F.col("p.number").eqNullSafe(F.col("q.number"))).otherwise(F.col("p.text").eqNullSafe(F.col("q.text")))
    changed = j.filter(~same).select("id", F.concat(F.lit("properties."), "key").alias("field"), F.col("p.text").alias("before"), F.col("q.text").alias("after"))
    return plain.union(changed)


NODE_FIELDS, EDGE_FIELDS = ("name", "type"), ("relation", "weight", "directed")


def diff(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> dict[str, DataFrame]:
    """nodes and edges (id, change), and node_fields and edge_fields."""
    return {
        "nodes": diff_entities(before[0], after[0]),
        "edges": diff_entities(before[1], after[1]),
        "node_fields": diff_fields(before[0], after[0], NODE_FIELDS),
        "edge_fields": diff_fields(before[1], after[1], EDGE_FIELDS),
    }


def summary(d: dict[str, DataFrame]) -> DataFrame:
    """One row of six counts and their sum."""
    part = lambda kind: d[kind + "s"].select(F.concat(F.lit(kind + "s_"), "change").alias("what"), "id").union(d[kind + "_fields"].select(F.lit(kind + "s_modified"), "id"))
    names = [f"{k}s_{c}" for k in ("node", "edge") for c in ("added", "removed", "modified")]
    rows = part("node").union(part("edge")).distinct()
    counts = rows.agg(*[F.count(F.when(F.col("what") == n, 1)).alias(n) for n in names])
    return counts.withColumn("total", reduce(lambda a, b: a + b, map(F.col, names)))


def diff_between(log: DataFrame, start, end, strict: bool = True) -> dict[str, DataFrame]:
    if start > end:
        raise ValidationError("start is after end")
    return diff(snapshot_at(log, start, strict), snapshot_at(log, end, strict))
