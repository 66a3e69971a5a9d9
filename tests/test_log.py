"""The event log: fold, diff, commands, checkpoints, stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from provgraph.errors import EdgeExists, NodeExists, NodeNotFound, QueryTimeout, ValidationError
from provgraph.functions import scalars
from provgraph.functions.validation import event_rules, event_violations, violations
from provgraph.operators import diff, replay
from provgraph.operators.commands import Commands
from provgraph.operators.projection import Projection
from provgraph.plans.timeout import time_limit
from provgraph.schema import EVENTS
from provgraph.sources.eventlog import EventLog, bounds, event_page, list_events

T1 = dt.datetime(2026, 1, 1, 8)
HOUR = dt.timedelta(hours=1)


def node(i, **p):
    return json.dumps({"id": i, "name": i, "type": "application", "properties": p})


def edge(i, a, b):
    return json.dumps({"id": i, "source_id": a, "target_id": b, "relation": "reads_from", "weight": 1, "directed": True, "properties": {}})


def log(spark, rows):
    return spark.createDataFrame([(i + 1, kind, kind.split("_")[0], e, p, None, "t", "", at) for i, (kind, e, p, at) in enumerate(rows)], EVENTS)


# a till pays into a vault until the payment is withdrawn; a guard owns the vault
PAID = [
    ("node_created", "till", node("till"), T1), ("node_created", "vault", node("vault"), T1), ("node_created", "guard", node("guard"), T1), ("edge_created", "pays", edge("pays", "till", "vault"), T1),
    ("edge_created", "keeps", edge("keeps", "guard", "vault"), T1), ("node_updated", "vault", node("vault", limit=500), T1 + HOUR / 2), ("edge_deleted", "pays", None, T1 + 3 * HOUR),
]


def ids(df):
    return {r.id for r in df.collect()}


def test_time_travel_and_diff(spark):
    events = log(spark, PAID)
    sizes = [tuple(x.count() for x in replay.snapshot_at(events, t)) for t in (T1 - HOUR, T1, T1 + HOUR, T1 + 3 * HOUR)]
    assert sizes == [(0, 0), (3, 2), (3, 2), (3, 1)]
    d = diff.diff_between(events, T1, T1 + 3 * HOUR)
    assert [(r.id, r.field, r.before, r.after) for r in d["node_fields"].collect()] == [("vault", "properties.limit", None, "500")]
    assert [(r.id, r.change) for r in d["edges"].collect()] == [("pays", "removed")]
    s = diff.summary(d).first()
    assert (s.edges_removed, s.nodes_modified, s.total) == (1, 1, 2)
    assert diff.summary(diff.diff_between(events, T1, T1)).first().total == 0
    shuffled = events.orderBy(F.rand(3))
    assert ids(replay.fold(shuffled)[0]) == {"till", "vault", "guard"}
    with pytest.raises(ValidationError):
        diff.diff_between(events, T1 + HOUR, T1)


def test_nested_properties_compare_by_value(spark):
    a = spark.createDataFrame([("x", "x", "api", '{"o":{"b":1,"a":2},"n":1,"s":"5"}')], "id string, name string, type string, properties string")
    b = spark.createDataFrame([("x", "x", "api", '{"n":1.0,"o":{"a":2,"b":1},"s":5}')], "id string, name string, type string, properties string")
    assert [r.field for r in diff.diff_fields(a, b, ("name",)).collect()] == ["properties.s"]


def test_cascade_and_strict(spark):
    again = [*PAID[:5], ("node_deleted", "vault", None, T1), ("node_created", "vault", node("vault"), T1)]
    nodes, edges = replay.fold(log(spark, again))
    assert ids(nodes) == {"till", "vault", "guard"} and ids(edges) == set()
    early = log(spark, [PAID[3], *PAID[:3]])
    assert {r.node_id for r in replay.violations(early).collect()} == {"till", "vault"}
    with pytest.raises(ValidationError):
        replay.snapshot_at(early, T1)
    bad = log(spark, [("node_created", "x", "{", T1), ("node_created", "x", node("y"), T1), ("edge_created", "e", edge("e", "a", "a"), T1), ("node_renamed", "x", node("x"), T1), ("node_created", "x", None, T1), *PAID])
    assert [r.violation for r in event_violations(bad).orderBy("seq").collect()] == ["payload unreadable", "payload id differs", "self loop", "unknown event type", "no payload"]


def test_log_keeps_an_edge_of_weight_zero(spark, tmp_path):
    free = edge("pays", "till", "vault").replace('"weight": 1', '"weight": 0.0')
    rows = log(spark, [*PAID[:3], ("edge_created", "pays", free, T1)])
    assert violations(rows, event_rules()).isEmpty() and [r.violation for r in event_violations(rows).collect()] == ["bad weight"]
    store = EventLog(spark, tmp_path.as_uri())
    assert store.append(rows) == 4
    held = Projection(store)
    held.catch_up()
    assert [(r.id, r.weight) for r in held.graph().edges.collect()] == [("pays", 0.0)]
    with pytest.raises(ValidationError):
        store.append(log(spark, [("edge_created", "pays", "{", T1)]))
    assert store.max_seq() == 4


def test_restore_takes_all_or_nothing(spark):
    nodes, edges = replay.fold(log(spark, PAID))
    assert replay.restore(nodes, edges) == (nodes, edges)
    for n, e in ((nodes.filter("id != 'guard'"), edges), (nodes.union(nodes), edges), (nodes, edges.union(edges)), (nodes.withColumn("type", F.lit("ship")), edges), (nodes, edges.withColumn("weight", F.lit(-1.0))), (nodes, edges.union(edges.withColumn("id", F.lit("twin"))))):
        with pytest.raises(ValidationError):
            replay.restore(n, e)


def test_pages_and_checkpoints(spark, tmp_path):
    store = EventLog(spark, tmp_path.as_uri())
    store.append(log(spark, PAID).withColumn("position", F.col("seq").cast("int")))
    page = event_page(store.events(), limit=900, offset=2, types=("node_created", "edge_created"))
    assert (page["total"], page["limit"], page["offset"]) == (5, 500, 2) and [r.seq for r in page["items"].collect()] == [3, 2, 1]
    assert event_page(store.events(), limit=0)["limit"] == 50
    state = replay.fold(store.events())
    assert store.latest_checkpoint() is None
    store.save_checkpoint(*state, 5)
    first = store.checkpoints().first()
    store.save_checkpoint(*state, 7)
    assert store.latest_checkpoint()[0] == 7 and store.checkpoint_seqs() == [5, 7]
    assert store.latest_checkpoint(first.created_at)[0] == 5
    # a snapshot that lost a part, one whose file is broken, one that a crash left without its row
    newest = store.checkpoints().filter("last_seq = 7").first()
    folder = tmp_path / "checkpoints" / newest.id / "nodes"
    for file in folder.glob("*.parquet"):
        file.write_bytes(b"no parquet")
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    (tmp_path / "checkpoints" / "half" / "nodes").mkdir(parents=True)
    assert store.latest_checkpoint()[0] == 5
    for x, y in zip(state, replay.replay_live(store)):
        assert ids(x) == ids(y)


def test_commands_and_checkpoints(spark, tmp_path):
    store = EventLog(spark, tmp_path.as_uri())
    c = Commands(store, checkpoint_interval=0)
    a, b = c.create_node("A", "api", {"ip": "1"}, id="a"), c.create_node("B", "database", id="b")
    c.create_edge(a, b, "reads_from", directed=False, id="e1")
    with pytest.raises(NodeExists):
        c.create_node("A", "api", id="a")
    with pytest.raises(EdgeExists):
        c.create_edge(b, a, "reads_from")
    with pytest.raises(NodeNotFound):
        c.create_edge(a, "zz", "calls")
    with pytest.raises(ValidationError):
        c.create_edge(a, b, "calls", weight=-1)
    c.update_node("a", properties={"ip": None, "os": "linux"})
    assert json.loads(c.graph().node("a").first().properties) == {"os": "linux"}
    store.save_checkpoint(*replay.fold(store.events()), store.max_seq())
    c.delete_node("b")
    kinds = [r.event_type for r in store.range().collect()]
    assert kinds == ["node_created", "node_created", "edge_created", "node_updated", "edge_deleted", "node_deleted"]
    full, resumed = replay.fold(store.events()), replay.replay_live(store)
    for x, y in zip(full, resumed):
        assert {tuple(r) for r in x.select("id", "properties").collect()} == {tuple(r) for r in y.select("id", "properties").collect()}
    assert [r.seq for r in list_events(store.events(), limit=2).collect()] == [6, 5]
    assert bounds(store.events()).first()["count"] == 6 == store.max_seq() == store.count()


def test_stream_equals_batch(spark, tmp_path):
    """Batches out of order, an event that comes twice, and a restart between."""
    from provgraph.operators.projection import Projection
    from provgraph.streaming.fold import fold_stream, read_stream

    events = log(spark, [*PAID[:4], ("node_deleted", "vault", None, T1), ("node_created", "vault", node("vault"), T1), ("edge_created", "keeps", edge("keeps", "guard", "vault"), T1)])
    for parts in (("seq in (2, 6)", "seq in (1, 3, 4)"), ("seq = 5", "seq in (6, 7)", "seq in (2, 5)")):
        for part in parts:
            events.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = fold_stream(read_stream(spark, f"{tmp_path}/in", 1), (tmp_path / "out").as_uri(), f"{tmp_path}/state")
        assert query.awaitTermination(240)
    held = Projection(None, (tmp_path / "out").as_uri(), spark)
    for x, y in zip((held.graph().nodes, held.graph().edges), replay.fold(events)):
        assert ids(x) == ids(y) and ids(x)
    assert held.seq() == 7 and len(held.manifest.files.sizes()) == 4  # the last batch changed nothing


def test_scalars(spark):
    rows = spark.createDataFrame([("2026-01-02T03:04:05Z",), ("2026-01-02T03:04:05+08:00",), ("2026-01-02T03:04:05 08:00",), ("2026-01-02 03:04:05",), ("2026-01-02",), ("soon",)], "s string")
    got = [r[0] for r in rows.select(scalars.format_time(scalars.parse_time(F.col("s")))).collect()]
    assert got == ["2026-01-02 11:04:05", *["2026-01-02 03:04:05"] * 3, "2026-01-02 00:00:00", None]
    one = spark.createDataFrame([('{"Risk":"高","x":1}', '{"a":1,"b":2}', '{"b":null,"c":3}', "abcdefghijklmnopqrstuvwxyz")], "p string, o string, n string, t string")
    r = one.select(scalars.risk_of(F.col("p")), scalars.merge_properties(F.col("o"), F.col("n")), scalars.middle_ellipsis(F.col("t"), 9)).first()
    assert r[0] == "high" and json.loads(r[1]) == {"a": 1, "c": 3} and r[2] == "abcd…wxyz"
    assert scalars.direction_of(" Upstream ") == "in" and scalars.relations("calls, owns,calls") == ["calls", "owns"]


def test_formats(spark):
    times = spark.sql("select timestamp'2026-03-04 20:05:06+00:00' as t, timestamp'2026-03-05 20:05:06+00:00' as now, 1234567.5 as n, cast(null as timestamp) as none")
    f = scalars
    r = times.select(f.format_local(F.col("t")), f.format_short(F.col("t")), f.format_date(F.col("t")), f.format_offset(F.col("t")), f.format_local(F.col("none")), f.format_offset(F.col("none")), f.format_number(F.col("n")), f.format_number(F.lit(1200)), f.format_decimal(F.lit(2.50)), f.format_decimal(F.lit(100)), f.relative_time(F.col("t"), F.col("now"))).first()
    assert tuple(r) == ("2026-03-05 04:05:06", "03-05 04:05", "2026-03-05", "2026-03-05T04:05:06+08:00", "—", "", "1,234,567.5", "1,200", "2.5", "100", "1 days ago")
    words = spark.createDataFrame([('{"risk":"致命"}',), ('{"RISK_LEVEL":" Mid "}',), ('{"风险":"低"}',), ('{"risk":"?"}',)], "p string")
    assert [x[0] for x in words.select(f.risk_of(F.col("p"))).collect()] == ["critical", "medium", "low", None]
    assert [x[0] for x in spark.createDataFrame([(0,), (4,), (900,)], "d int").select(f.node_size(F.col("d"))).collect()] == [20.0, 32.0, 46.0]
    assert [x[0] for x in spark.createDataFrame([("node_updated",), ("?",)], "e string").select(f.event_label(F.col("e"))).collect()] == ["Node updated", None]


def test_time_limit(spark):
    sum_of = lambda n: spark.range(n).select(F.sum(F.sqrt("id"))).first()
    with pytest.raises(QueryTimeout), time_limit(spark, 0.5):
        for _ in range(100):
            sum_of(10**8)
    with time_limit(spark, 60):
        assert sum_of(10)
    with pytest.raises(ZeroDivisionError), time_limit(spark, 60):
        1 / 0
    assert sum_of(10)


def test_invalid_events_are_those_broken_as_events(spark, tmp_path):
    from provgraph import queries

    rows = [(i, T1 + HOUR * i, i % 3, ("click", "signup", "view")[i % 3], 0.0 if i == 3 else 1.5, '{"k": 1}') for i in range(13)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path.as_uri()}/events.parquet")
    found = {r.seq: r.violation for r in queries.QUERIES["invalid_events"](spark, tmp_path.as_uri()).collect()}
    assert found == {1: "no payload", 2: "unknown event type", 10: "blank entity id", 11: "no payload", 12: "unknown event type"}
