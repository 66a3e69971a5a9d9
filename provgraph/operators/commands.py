"""Write commands: each checks the state and gives the events to append."""

from __future__ import annotations

import json
import uuid
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.errors import Conflict, EdgeExists, EdgeNotFound, NodeExists, NodeNotFound, ValidationError
from provgraph.functions.validation import edge_rules, node_rules, require_valid
from provgraph.operators.projection import Projection
from provgraph.plans.graph import LineageGraph
from provgraph.plans.iterate import numbered
from provgraph.schema import EDGE_PAYLOAD, NODE_PAYLOAD

BATCH = "position int, event_type string, entity_type string, entity_id string, payload string, before string, actor string, reason string"


def again(command):
    """Check and write anew if another writer came between the two."""

    @wraps(command)
    def tried(self, *args, **named):
        for _ in range(self.attempts - 1):
            try:
                return command(self, *args, **named)
            except Conflict:
                pass
        return command(self, *args, **named)

    return tried


class Commands:
    """Commands over an event log.

    A command is checked against the maintained projection, appended to the
    log on condition that nothing else was appended since, and applied to the
    projection: the log comes first, and a projection that lags or is lost is
    brought forward from it. What a command reads does not grow with the log.
    """

    def __init__(self, log, checkpoint_interval: int = 500, attempts: int = 5):
        self.log, self.interval, self.attempts = log, checkpoint_interval, attempts
        self.projection = Projection(log)
        self._seen = 0

    def graph(self) -> LineageGraph:
        self._now()
        return self.projection.graph()

    def _now(self) -> Projection:
        """The projection, brought forward."""
        self._seen = self.projection.catch_up()
        return self.projection

    def _append(self, events: list[tuple], actor: str, reason: str) -> int:
        rows = [(i, kind, kind.split("_")[0], entity, payload, before, actor or "anonymous", (reason or "")[:512]) for i, (kind, entity, payload, before) in enumerate(events)]
        return self._write(self.log.spark.createDataFrame(rows, BATCH))

    def _write(self, batch: DataFrame) -> int:
        last = self.log.append(batch, expected=self._seen)
        self.projection.catch_up()
        self.log.maybe_checkpoint(self.interval, self.projection)
        return last

    def _node(self, node_id: str) -> dict:
        row = self._now().node(node_id).first()
        if row is None:
            raise NodeNotFound(node_id)
        return self._entity(row, ("id", "name", "type"))

    def _edge(self, edge_id: str) -> dict:
        row = self._now().edge(edge_id).first()
        if row is None:
            raise EdgeNotFound(edge_id)
        return self._entity(row, EDGE_FIELDS)

    @staticmethod
    def _text(entity: dict) -> str:
        return json.dumps(entity, ensure_ascii=False, sort_keys=True)

    @staticmethod
    def _entity(row, fields) -> dict:
        return {f: row[f] for f in fields} | {"properties": json.loads(row["properties"] or "{}")}

    def _check(self, entity: dict, ddl: str, rules) -> None:
        row = {k: json.dumps(v, ensure_ascii=False) if k == "properties" else v for k, v in entity.items()}
        names = [part.split()[0] for part in ddl.split(", ")]
        require_valid(self.log.spark.createDataFrame([tuple(row.get(n) for n in names)], ddl), rules)

    @again
    def create_node(self, name: str, type: str, properties: dict | None = None, id: str = "", actor: str = "", reason: str = "") -> str:
        entity = {"id": id.strip() or str(uuid.uuid4()), "name": (name or "").strip(), "type": type, "properties": properties or {}}
        self._check(entity, NODE_PAYLOAD, node_rules())
        if not self._now().node(entity["id"]).isEmpty():
            raise NodeExists(entity["id"])
        self._append([("node_created", entity["id"], self._text(entity), None)], actor, reason)
        return entity["id"]

    @again
    def update_node(self, id: str, name: str | None = None, type: str | None = None, properties: dict | None = None, replace: bool = False, actor: str = "", reason: str = "") -> None:
        old = self._node(id)
        new = old | {k: v for k, v in (("name", name and name.strip()), ("type", type)) if v is not None}
        new["properties"] = _merged(old["properties"], properties, replace)
        self._check(new, NODE_PAYLOAD, node_rules())
        self._append([("node_updated", id, self._text(new), self._text(old))], actor, reason)

    @again
    def delete_node(self, id: str, actor: str = "", reason: str = "") -> None:
        """Edge deletes by id first, then the node's, in one batch; the edges
        of a hub stay a table."""
        old = self._node(id)
        edges = self.projection.standing_at(id)
        edges = numbered(edges.select(*EDGE_FIELDS, "properties"), ["id"], "position")
        before = F.struct(*EDGE_FIELDS, F.from_json(F.coalesce("properties", F.lit("{}")), "map<string,variant>").alias("properties"))
        gone = edges.select(F.col("position").cast("int"), F.lit("edge_deleted").alias("event_type"), F.lit("edge").alias("entity_type"), F.col("id").alias("entity_id"), F.lit(None).cast("string").alias("payload"), F.to_json(before).alias("before"))
        last = gone.agg(F.count(F.lit(1)).cast("int").alias("position")).select("position", F.lit("node_deleted"), F.lit("node"), F.lit(id), F.lit(None).cast("string"), F.lit(self._text(old)))
        self._write(gone.union(last).withColumns({"actor": F.lit(actor or "anonymous"), "reason": F.lit((reason or "")[:512])}))

    @again
    def create_edge(self, source_id: str, target_id: str, relation: str, weight: float = 1.0, directed: bool = True, properties: dict | None = None, id: str = "", actor: str = "", reason: str = "") -> str:
        entity = {"id": id.strip() or str(uuid.uuid4()), "source_id": source_id, "target_id": target_id, "relation": relation, "weight": float(weight), "directed": directed, "properties": properties or {}}
        self._check(entity, EDGE_PAYLOAD, edge_rules())
        for end in (source_id, target_id):
            self._node(end)
        self._unique(entity)
        self._append([("edge_created", entity["id"], self._text(entity), None)], actor, reason)
        return entity["id"]

    @again
    def update_edge(self, id: str, relation: str | None = None, weight: float | None = None, directed: bool | None = None, properties: dict | None = None, replace: bool = False, actor: str = "", reason: str = "") -> None:
        """Ends never change."""
        old = self._edge(id)
        new = old | {k: v for k, v in (("relation", relation), ("weight", weight), ("directed", directed)) if v is not None}
        new["properties"] = _merged(old["properties"], properties, replace)
        self._check(new, EDGE_PAYLOAD, edge_rules())
        self._unique(new, id)
        self._append([("edge_updated", id, self._text(new), self._text(old))], actor, reason)

    @again
    def delete_edge(self, id: str, actor: str = "", reason: str = "") -> None:
        old = self._edge(id)
        self._append([("edge_deleted", id, None, self._text(old))], actor, reason)

    def _unique(self, new: dict, own: str = "") -> None:
        """No other edge has the id of ``new``, or states what it states."""
        if new["id"] != own and not self.projection.edge(new["id"]).isEmpty():
            raise EdgeExists(new["id"])
        s, t = new["source_id"], new["target_id"]
        turned = F.col("source_id") != s
        same = self.projection.between(s, t).filter((F.col("relation") == new["relation"]) & (~turned | ~F.col("directed") | F.lit(not new["directed"])))
        if not same.filter(F.col("id") != own).isEmpty():
            raise EdgeExists(new["id"])


EDGE_FIELDS = ("id", "source_id", "target_id", "relation", "weight", "directed")


def _merged(old: dict, new: dict | None, replace: bool) -> dict:
    if new is None:
        return old
    if not isinstance(new, dict):
        raise ValidationError("properties are no object")
    return new if replace else {k: v for k, v in (old | new).items() if not (k in new and v is None)}
