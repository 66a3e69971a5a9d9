"""Every version of every entity with the span of instants at which it holds.

Numbers order the log, and times select from it: at an instant the version of
an entity is its event of greatest seq among those that are not later. So an
event holds from its own time until the least time of any event of the same
entity with a greater seq, and never if that comes first; an edge holds at
most until the least time of a later delete of one of its ends. The spans are
laid out by time: a version goes to the coarsest grid cell needed for its
length, so that an instant meets two cells of each length (and, of versions
that never end, those that began), whatever the order of numbers and times.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provgraph.errors import ValidationError
from provgraph.plans.graph import LineageGraph
from provgraph.schema import EDGE_PAYLOAD, NODE_PAYLOAD

SPANS = "entity_type string, id string, seq bigint, deleted boolean, payload string, since timestamp_ntz, until timestamp_ntz, length int, cell bigint"
#: Cells of the finest grid over the whole time of a log, and events of an
#: entity that one task puts in order.
CELLS, CHUNK = 256, 1_000_000
#: Files of a cell.
FILES = 8
#: Length of versions that never end.
OPEN = -1


def _least_after(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with the least ``since`` of those of the same keys that have a
    greater seq.

    Within stretches of ``CHUNK`` numbers by a window, beyond them by the
    stretches' own least times, so that no entity's history is one task's.
    """
    rows = rows.withColumn("chunk", F.floor(F.col("seq") / CHUNK))
    inside = Window.partitionBy(*keys, "chunk").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    beyond = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    stretches = rows.groupBy(*keys, "chunk").agg(F.min("since").alias("first")).withColumn("far", F.min("first").over(beyond)).drop("first")
    near = rows.withColumn("near", F.min("since").over(inside))
    return near.join(stretches.filter("far is not null"), [*keys, "chunk"], "left").withColumn(name, F.least("near", "far")).drop("near", "far", "chunk")


def spans_of(log: DataFrame) -> DataFrame:
    """(entity_type, id, seq, deleted, payload, since, until): until is null
    for a version that never ends; versions that never hold are left out."""
    rows = log.select("entity_type", F.col("entity_id").alias("id"), "seq", F.col("event_type").endswith("_deleted").alias("deleted"), "payload", F.col("occurred_at").alias("since"))
    # the payloads are not sorted: their rows meet the spans at the end
    ends = _least_after(rows.drop("payload"), ["entity_type", "id"], "until")
    ends = ends.filter("until is null or until > since")
    held = ends.join(rows.select("seq", "payload"), "seq")
    edges = held.filter("entity_type = 'edge' and not deleted").withColumn("n", F.from_json("payload", EDGE_PAYLOAD))
    # from one delete of a node to the next, the least time of what comes after
    deletes = rows.filter("entity_type = 'node' and deleted").select("id", "seq", "since")
    after = Window.partitionBy("id").orderBy("seq")
    gone = _least_after(deletes, ["id"], "later").select("id", F.lag("seq").over(after).alias("low"), F.col("seq").alias("high"), F.least("since", "later").alias("gone"))
    for end in ("source_id", "target_id"):
        here = gone.withColumnsRenamed({"id": "g", "low": "l", "high": "h", "gone": f"gone_{end}"})
        met = (F.col(f"n.{end}") == F.col("g")) & (F.col("seq") < F.col("h")) & F.coalesce(F.col("seq") > F.col("l"), F.lit(True))
        edges = edges.join(here, met, "left").drop("g", "l", "h")
    edges = edges.withColumn("until", F.least("until", "gone_source_id", "gone_target_id")).filter("until is null or until > since")
    rest = held.filter("entity_type = 'node' or deleted")
    return rest.unionByName(edges.select(*rest.columns)).select("entity_type", "id", "seq", "deleted", "payload", "since", "until")


class Versions:
    """The spans of a log in a folder, in grid cells by time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, log: DataFrame, cells: int = CELLS, files: int = FILES) -> Versions:
        """Write the spans of a log, over a grid of about ``cells`` cells;
        an earlier table is replaced."""
        first, last = log.agg(F.min("occurred_at"), F.max("occurred_at")).first()
        micros = 0 if first is None else _passed(first, last)
        unit = max(1, -(-micros // cells))
        grid = self.spark.createDataFrame([(first, unit)], "first timestamp_ntz, unit bigint")
        grid.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/grid")
        spans = spans_of(log).filter("not deleted").withColumn("span", _micros("until", "since"))
        # the least length whose cells are as long as the span
        length = F.greatest(F.lit(0), F.ceil(F.log2(F.col("span") / unit))).cast("int")
        spans = spans.withColumn("length", length).withColumn("length", F.when(F.expr(f"shiftleft({unit}L, length) < span"), F.col("length") + 1).otherwise(F.col("length")))
        spans = spans.withColumn("length", F.when(F.col("span").isNull(), OPEN).otherwise(F.col("length"))).withColumn("first", F.lit(first).cast("timestamp_ntz")).withColumn("passed", _micros("since", "first"))
        spans = spans.withColumn("cell", F.expr(f"passed div shiftleft({unit}L, greatest(length, 0))")).drop("span", "first", "passed")
        # a cell of any number of spans is dealt by a hash of their ids
        dealt = spans.repartition("length", "cell", F.pmod(F.xxhash64("id"), F.lit(files)))
        dealt.sortWithinPartitions("length", "cell", "since").write.mode("overwrite").partitionBy("length", "cell").parquet(f"{self.path}/spans")
        return self

    def spans(self) -> DataFrame:
        return self.spark.read.schema(SPANS).parquet(f"{self.path}/spans")

    def holding(self, at) -> DataFrame:
        """The versions that hold at an instant, from the cells that may have
        some: only those are listed and read."""
        first, unit = self.spark.read.parquet(f"{self.path}/grid").first()
        if first is None:
            return self.spans().filter("false")
        lengths = range(40)
        own = [_passed(first, at) // (unit << n) for n in lengths]
        may = [(F.col("length") == n) & F.col("cell").isin(cell, cell - 1) for n, cell in zip(lengths, own)]
        may.append((F.col("length") == OPEN) & (F.col("cell") <= own[0]))
        now = (F.col("since") <= F.lit(at)) & (F.col("until").isNull() | (F.col("until") > F.lit(at)))
        return self.spans().filter(reduce(Column.__or__, may) & now).drop("length", "cell")

    def at(self, at) -> LineageGraph:
        """The graph at an instant; edges without both ends are left out."""
        held = self.holding(at)
        fields = lambda kind, ddl: held.filter(F.col("entity_type") == kind).select(F.from_json("payload", ddl).alias("n"), F.col("since").alias("updated_at")).select("n.*", "updated_at")
        nodes = fields("node", NODE_PAYLOAD)
        edges = fields("edge", EDGE_PAYLOAD).withColumn("directed", F.coalesce("directed", F.lit(False)))
        for end in ("source_id", "target_id"):
            edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
        return LineageGraph(nodes, edges.select("id", "source_id", "target_id", "relation", "weight", "directed", "properties", "updated_at"))

    def changed(self, start, end) -> tuple[LineageGraph, LineageGraph]:
        """The graphs at two instants."""
        if start > end:
            raise ValidationError("start is after end")
        return self.at(start), self.at(end)


def _passed(first: dt.datetime, at: dt.datetime) -> int:
    return (at - first) // dt.timedelta(microseconds=1)


def _micros(later: str, earlier: str) -> Column:
    """Microseconds between two times without a zone; null for null."""
    return F.expr(f"cast(cast(cast({later} - {earlier} as interval second) as decimal(20, 6)) * 1000000 as bigint)")
