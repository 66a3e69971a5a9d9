"""The current graph as maintained tables, brought forward by each batch.

Four tables of immutable runs, named by a manifest's commits:

* ``nodes`` (id, seq, gone, alive and the node's fields) and ``edges`` (id,
  seq, alive and the edge's fields): what the last event of each entity said.
  ``gone`` is the number of a node's last delete.
* ``ends`` (node_id, id): every edge that was ever put on a node, so that a
  node's edges are found without reading the others; ``postings`` (term, id):
  every node that ever had a property's value. Both only name candidates,
  whose rows tell.

A batch of events adds a run to each; a row with a greater seq wins over one
of the same id. Edges that a node's delete takes along become rows that are
not alive, found by ``ends``. Runs are merged when the last is more than half
as large as the one before, so there are few, and a row is written again a
logarithmic number of times. A run is partitioned by a hash of its key, into
parts of about ``ROWS`` rows in order of the key: a look-up reads one part of
each run, whatever the length of the log and, but for the part, the size of
the graph.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.errors import Conflict
from provgraph.operators.search import search
from provgraph.plans.graph import LineageGraph
from provgraph.schema import EDGE_PAYLOAD, NODE_PAYLOAD
from provgraph.sources.manifest import Files, Manifest

STATE = "seq bigint, gone bigint, alive boolean, updated_at timestamp_ntz"
TABLES = {"nodes": f"{NODE_PAYLOAD}, {STATE}", "edges": f"{EDGE_PAYLOAD}, {STATE}", "ends": "node_id string, id string", "postings": "term string, id string"}
KEYS = {"nodes": "id", "edges": "id", "ends": "node_id", "postings": "term"}
#: Parts of a run over which one key may spread: a property value or a node may
#: have any number of rows.
SPREAD = {"nodes": 1, "edges": 1, "ends": 8, "postings": 8}
#: Rows of a part of a run, and ids that are looked up one by one at most.
ROWS, FEW = 1_000_000, 200


def _latest(rows: DataFrame, table: str) -> DataFrame:
    """One row of each key: that of greatest seq."""
    if table in ("ends", "postings"):
        return rows.distinct()
    columns = rows.columns
    # of one seq, which a cascade and a repeated batch can give, what is gone
    order = F.struct("seq", ~F.col("alive"))
    found = rows.groupBy("id").agg(F.max_by(F.struct(*columns), order).alias("r"), F.max("gone").alias("g"))
    return found.select(*[F.col("g").alias(c) if c == "gone" else F.col(f"r.{c}") for c in columns])


def _part(table: str, key: Column, other: Column, buckets: int) -> Column:
    """The part of a run that a row belongs to."""
    shift = F.pmod(F.xxhash64(other), F.lit(SPREAD[table]))
    return F.pmod(F.pmod(F.xxhash64(key), F.lit(buckets)) + shift, F.lit(buckets)).cast("int")


def _term(key: Column, value: Column) -> Column:
    return F.concat(key, F.lit("\x1f"), value)


class Projection:
    """The graph of a log, under ``log.path``/projection unless said. Without
    a log it is brought forward by ``apply`` alone, and needs a session."""

    def __init__(self, log, path: str = "", spark: SparkSession | None = None):
        self.log, self.spark = log, spark or log.spark
        self.path = (path or f"{log.path}/projection").rstrip("/")
        self.manifest, self.files = Manifest(self.spark, f"{self.path}/commits"), Files(self.spark, self.path)

    def seq(self) -> int:
        """The number of the last event that the tables hold."""
        return self.manifest.state()[2].get("seq", 0)

    def _runs(self, table: str, entries: dict | None = None) -> list[dict]:
        entries = self.manifest.state()[1] if entries is None else entries
        return [e for e in entries.values() if e["table"] == table]

    def _read(self, table: str, run: dict) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[table]}, bucket int").parquet(f"{self.path}/{run['name']}")

    def rows(self, table: str, entries: dict | None = None) -> DataFrame:
        """The current rows of a table, of entities that are gone as well."""
        runs = [self._read(table, r).drop("bucket") for r in self._runs(table, entries)]
        if not runs:
            return self.spark.createDataFrame([], TABLES[table])
        all_rows = runs[0]
        for more in runs[1:]:
            all_rows = all_rows.union(more)
        return all_rows if len(runs) == 1 else _latest(all_rows, table)

    def pick(self, table: str, ids: DataFrame | list[str], entries: dict | None = None) -> DataFrame:
        """The current rows of some keys (one column, or a list). A few are
        looked up in their parts; many are met by a join."""
        key = KEYS[table]
        if isinstance(ids, DataFrame):
            asked = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
            few = [r[0] for r in asked.limit(FEW + 1).collect()]
        else:
            few, asked = list(ids), None
            if len(few) > FEW:
                asked = self.spark.createDataFrame([(i,) for i in few], f"{key} string")
        found = self.spark.createDataFrame([], TABLES[table])
        for run in self._runs(table, entries):
            rows = self._read(table, run)
            if len(few) <= FEW:
                home = lambda i: F.pmod(F.xxhash64(F.lit(i)), F.lit(run["buckets"]))  # noqa: E731, B023
                parts = [F.pmod(home(i) + k, F.lit(run["buckets"])).cast("int") for i in few for k in range(min(SPREAD[table], run["buckets"]))]
                rows = rows.filter(F.col("bucket").isin(*parts) & F.col(key).isin(*few)) if few else rows.filter("false")
            else:
                rows = rows.join(asked, key, "left_semi")
            found = found.unionByName(rows.drop("bucket"))
        return _latest(found, table)

    def node(self, node_id: str) -> DataFrame:
        return self.pick("nodes", [node_id]).filter("alive")

    def edge(self, edge_id: str) -> DataFrame:
        return self._standing(self.pick("edges", [edge_id]).filter("alive"))

    def incident(self, node_ids: DataFrame | list[str], entries: dict | None = None) -> DataFrame:
        """The edges, not deleted, that have an end among some nodes."""
        if not isinstance(node_ids, DataFrame):
            node_ids = self.spark.createDataFrame([(i,) for i in node_ids], "n string")
        named = node_ids.select(F.col(node_ids.columns[0]).alias("end"))
        edges = self.pick("edges", self.pick("ends", named, entries).select("id"), entries).filter("alive")
        by_end = edges.withColumn("end", F.explode(F.array_distinct(F.array("source_id", "target_id"))))
        return by_end.join(named, "end", "left_semi").drop("end").dropDuplicates(["id"])

    def standing_at(self, node_id: str) -> DataFrame:
        """A node's edges of which the other end is there as well."""
        return self._standing(self.incident([node_id]))

    def search(self, key: str, value: str) -> DataFrame:
        """What ``operators.search.search`` finds for a property's value, from
        the nodes that ever had it."""
        ids = self.pick("postings", [f"{key.strip()}\x1f{value.strip()}"]).select("id")
        return search(self.pick("nodes", ids).filter("alive").drop("seq", "gone", "alive"), key=key, value=value)

    def between(self, source_id: str, target_id: str) -> DataFrame:
        """The edges from one node to another, or back."""
        here, there = F.col("source_id"), F.col("target_id")
        both = ((here == source_id) & (there == target_id)) | ((here == target_id) & (there == source_id))
        return self._standing(self.incident([source_id]).filter(both))

    def _standing(self, edges: DataFrame) -> DataFrame:
        """Those edges of which both ends are there."""
        ends = self.pick("nodes", edges.select(F.explode(F.array("source_id", "target_id")))).filter("alive")
        for end in ("source_id", "target_id"):
            edges = edges.join(ends.select(F.col("id").alias(end)), end, "left_semi")
        return edges

    def graph(self) -> LineageGraph:
        """Nodes and edges as the log leaves them; edges of which an end is not
        there are left out, as the fold does that is not strict."""
        return self.snapshot()[1]

    def snapshot(self) -> tuple[int, LineageGraph]:
        """The graph, and the number of the last event that it holds."""
        _, entries, facts = self.manifest.state()
        nodes = self.rows("nodes", entries).filter("alive").drop("seq", "gone", "alive")
        edges = self.rows("edges", entries).filter("alive").drop("seq", "gone", "alive")
        for end in ("source_id", "target_id"):
            edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
        return facts.get("seq", 0), LineageGraph(nodes, edges.select("id", "source_id", "target_id", "relation", "weight", "directed", "properties", "updated_at"))

    def catch_up(self) -> int:
        """Apply what the log holds beyond the tables; the last number. Only
        files that reach beyond it are read. Without tables, or after they were
        lost, that is the whole log."""
        last = self.log.max_seq()
        if (held := self.seq()) < last:
            self.apply(self.log.range(held).filter(F.col("seq") <= last), last, last - held)
        return last

    def apply(self, events: DataFrame, last_seq: int, rows: int, token: str = "") -> bool:
        """Merge a batch of about ``rows`` events and say that the tables hold
        the log to ``last_seq``. A batch of a ``token`` that was the last to be
        applied is passed over (False), so that it can be tried again.

        Events need not come in order of seq: of each entity the greatest
        counts, and a delete takes along what was put before it, whichever
        comes first.
        """
        version, entries, facts = self.manifest.state()
        if token and facts.get("token") == token:
            return False
        delta = self._delta(events, entries)
        added, dropped = [], []
        for table, fresh in delta.items():
            runs, size = self._runs(table, entries), rows * (2 if SPREAD[table] > 1 else 1)
            while runs and runs[-1]["rows"] <= 2 * size:
                run = runs.pop()
                fresh, size = fresh.unionByName(self._read(table, run).drop("bucket")), size + run["rows"]
                dropped.append(run["name"])
            if len(runs) < len(self._runs(table, entries)):
                fresh = _latest(fresh, table)
            added.append(self._write(table, fresh, size))
        try:
            self.manifest.commit(version, entries, {"seq": max(last_seq, facts.get("seq", 0)), "token": token}, added, dropped)
        except Conflict:
            for run in added:
                self.files.delete(run["name"])
            # another has brought the tables forward; is the batch among it?
            if not token and self.seq() >= last_seq:
                return False
            raise
        return True

    def _write(self, table: str, rows: DataFrame, size: int) -> dict:
        run = {"name": f"{table}-{uuid.uuid4().hex}", "table": table, "rows": size, "buckets": max(1, -(-size // ROWS))}
        key = KEYS[table]
        dealt = rows.withColumn("bucket", _part(table, F.col(key), F.col("id"), run["buckets"]))
        dealt.repartition(run["buckets"], "bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{self.path}/{run['name']}")
        return run | {"rows": self._read(table, run).count()}  # from the files' footers

    def _delta(self, events: DataFrame, entries: dict) -> dict[str, DataFrame]:
        """The rows that a batch adds to each table."""
        last = F.max_by(F.struct("event_type", "payload", "occurred_at", "seq"), "seq").alias("e")
        gone = F.max(F.when(F.col("event_type") == "node_deleted", F.col("seq"))).alias("gone")
        ended = events.groupBy("entity_type", "entity_id").agg(last, gone)
        alive = ~F.col("e.event_type").endswith("_deleted")
        state = [F.col("e.seq").alias("seq"), "gone", alive.alias("alive"), F.col("e.occurred_at").alias("updated_at")]

        def fields(kind: str, ddl: str) -> DataFrame:
            rows = ended.filter(F.col("entity_type") == kind).select("entity_id", F.from_json("e.payload", ddl).alias("n"), *state)
            names = [f.split()[0] for f in ddl.split(", ")]
            return rows.select(F.col("entity_id").alias("id"), *[F.col(f"n.{c}").alias(c) for c in names if c != "id"], "seq", "gone", "alive", "updated_at")

        nodes, edges = fields("node", NODE_PAYLOAD), fields("edge", EDGE_PAYLOAD)
        edges = edges.withColumn("directed", F.coalesce("directed", F.lit(False)))
        ends = edges.filter("alive").select(F.explode(F.array("source_id", "target_id")).alias("node_id"), "id")
        values = nodes.filter("alive").select("id", F.explode(F.from_json("properties", "map<string,string>")).alias("k", "v"))
        postings = values.filter("v is not null").select(_term(F.col("k"), F.col("v")).alias("term"), "id")
        # deletes of the batch, and those of before, whichever is later
        deletes = nodes.filter("gone is not null").select(F.col("id").alias("n"), F.col("gone").alias("at"))
        known = self.pick("nodes", ends.select("node_id"), entries).filter("gone is not null").select(F.col("id").alias("n"), F.col("gone").alias("at")) if self._runs("nodes", entries) else deletes.limit(0)
        edges = _taken_along(edges, deletes.union(known))
        old = self.incident(deletes.select("n"), entries) if self._runs("edges", entries) else self.spark.createDataFrame([], TABLES["edges"])
        lost = _taken_along(old, deletes).filter("not alive")
        both = edges.unionByName(lost.select(*edges.columns))
        columns: Callable[[str], list] = lambda table: [f.split()[0] for f in TABLES[table].split(", ")]
        return {"nodes": nodes.select(*columns("nodes")), "edges": _latest(both, "edges").select(*columns("edges")), "ends": ends.distinct().select(*columns("ends")), "postings": postings.distinct()}


def _taken_along(edges: DataFrame, deletes: DataFrame) -> DataFrame:
    """``edges``, those dead of which a later delete (n, at) took an end."""
    deletes = deletes.groupBy("n").agg(F.max("at").alias("at"))
    for end in ("source_id", "target_id"):
        named = deletes.withColumnsRenamed({"n": f"n_{end}", "at": f"at_{end}"})
        edges = edges.join(named, F.col(end) == F.col(f"n_{end}"), "left")
    # its own seq stays: a later event of the edge still wins, a repeated one does not
    taken = F.greatest("at_source_id", "at_target_id") > F.col("seq")
    return edges.withColumn("alive", F.col("alive") & ~F.coalesce(taken, F.lit(False))).drop("n_source_id", "at_source_id", "n_target_id", "at_target_id")
