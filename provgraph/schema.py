"""Schemas, closed sets and limits."""

from __future__ import annotations

from dataclasses import dataclass

# The closed sets of the data model.
NODE_TYPES = ("server", "database", "application", "api", "person", "account", "middleware", "storage")
RELATIONS = ("deploys_on", "calls", "reads_from", "writes_to", "depends_on", "owns", "transfers_to", "associates_with")
EVENT_TYPES = ("node_created", "node_updated", "node_deleted", "edge_created", "edge_updated", "edge_deleted")

NODES = "id string, name string, type string, properties string, created_at timestamp_ntz, updated_at timestamp_ntz"
EDGES = "id string, source_id string, target_id string, relation string, weight double, directed boolean, properties string, created_at timestamp_ntz, updated_at timestamp_ntz"
EVENTS = "seq bigint, event_type string, entity_type string, entity_id string, payload string, before string, actor string, reason string, occurred_at timestamp_ntz"
CHECKPOINTS = "id string, last_seq bigint, node_count bigint, edge_count bigint, created_at timestamp_ntz"
NODE_PAYLOAD = "id string, name string, type string, properties string"
EDGE_PAYLOAD = "id string, source_id string, target_id string, relation string, weight double, directed boolean, properties string"


@dataclass(frozen=True)
class Limits:
    """Bounds of one query; 0 or a greater argument means the bound."""

    depth: int = 10
    nodes: int = 20_000
    paths: int = 1000
    matrix: int = 500
    topology: int = 500


def clamp(value: int | None, most: int) -> int:
    return most if not value or value < 0 or value > most else value
