"""Commits of the log, its clustered layout, and the maintained projection."""

import datetime as dt
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from provgraph.errors import Conflict, DamagedLog, EdgeExists
from provgraph.operators import replay
from provgraph.operators.commands import Commands
from provgraph.operators.projection import Projection
from provgraph.operators.search import search
from provgraph.schema import EVENTS
from provgraph.sources.eventlog import EventLog, entity_timeline

START = dt.datetime(2026, 3, 1)


def random_events(rng, n, nodes=8, edges=14):
    """Events of few entities, so that all cases meet: puts of edges without
    ends, deletes and puts anew, edges that change their ends."""
    rows = []
    for seq in range(1, n + 1):
        at = START + dt.timedelta(minutes=rng.randint(0, n))
        if rng.random() < 0.5:
            i, kind = f"n{rng.randrange(nodes)}", rng.choice(["node_created", "node_updated", "node_deleted"])
            payload = {"id": i, "name": i.upper(), "type": "api", "properties": {"v": rng.choice([*range(6), "3", "true", True, 3.5, {"a": 1}, None])}}
        else:
            i, kind = f"e{rng.randrange(edges)}", rng.choice(["edge_created", "edge_updated", "edge_created", "edge_deleted"])
            a = rng.randrange(nodes)
            payload = {"id": i, "source_id": f"n{a}", "target_id": f"n{(a + 1 + rng.randrange(nodes - 1)) % nodes}", "relation": "calls", "weight": rng.randint(1, 9), "directed": rng.random() < 0.5, "properties": {}}
        rows.append((seq, kind, kind[:4], i, None if kind.endswith("_deleted") else json.dumps(payload), None, "t", "", at))
    return rows


def put(spark, store, rows):
    first = rows[0][0]
    return store.append(spark.createDataFrame(rows, EVENTS).coalesce(1).withColumn("position", (F.col("seq") - first).cast("int")))


def state(nodes, edges):
    return {tuple(r) for r in nodes.select("id", "name", "type", "properties", "updated_at").collect()}, {tuple(r) for r in edges.select("id", "source_id", "target_id", "relation", "weight", "directed", "properties", "updated_at").collect()}


def test_projection_equals_fold(spark, tmp_path):
    rng = random.Random(2)
    rows = random_events(rng, 120)
    store = EventLog(spark, (tmp_path / "log").as_uri())
    held, at = Projection(store), 0
    while at < len(rows):
        size = rng.choice([2, 7, 30])
        put(spark, store, rows[at : at + size])
        held.catch_up()
        at += size
        if size == 30 or at >= len(rows):
            graph = held.graph()
            assert state(graph.nodes, graph.edges) == state(*replay.fold(store.events()))
    assert held.seq() == 120 and len(held._runs("edges")) < 8
    graph, anew = held.graph(), Projection(store, (tmp_path / "anew").as_uri())
    anew.catch_up()
    assert state(anew.graph().nodes, anew.graph().edges) == state(graph.nodes, graph.edges)


def test_batches_in_any_order(spark, tmp_path):
    """Late events lose, and a late delete takes what was put before it."""
    rng = random.Random(5)
    rows = random_events(rng, 120)
    store = EventLog(spark, (tmp_path / "log").as_uri())
    held, events = Projection(store), spark.createDataFrame(rows, EVENTS)
    parts = [rows[i : i + 20] for i in range(0, 120, 20)]
    rng.shuffle(parts)
    for n, part in enumerate(parts):
        for again in range(2):
            assert held.apply(spark.createDataFrame(part, EVENTS), part[-1][0], len(part), f"batch-{n}") is (not again)
    graph = held.graph()
    assert state(graph.nodes, graph.edges) == state(*replay.fold(events))


def test_look_ups(spark, tmp_path, monkeypatch):
    store = EventLog(spark, tmp_path.as_uri())
    rows = random_events(random.Random(7), 200)
    monkeypatch.setattr("provgraph.operators.projection.ROWS", 40)  # several parts a run
    put(spark, store, rows)
    held = Projection(store)
    held.catch_up()
    graph = held.graph()
    for n in ("n0", "n3", "none"):
        assert {tuple(r) for r in held.node(n).select("id", "properties").collect()} == {tuple(r) for r in graph.nodes.filter(F.col("id") == n).select("id", "properties").collect()}
        want = {r.id for r in graph.incident_edges(n).collect()}
        assert {r.id for r in held.standing_at(n).collect()} == want
    for key, value in (("v", "3"), ("v", "true"), ("v", "3.5"), ("v", '{"a":1}'), ("w", "x")):
        want = [tuple(r) for r in search(graph.nodes, key=key, value=value).select("id", "properties").collect()]
        assert [tuple(r) for r in held.search(key, value).select("id", "properties").collect()] == want
    # beyond a few ids the look-up is a join
    monkeypatch.setattr("provgraph.operators.projection.FEW", 2)
    ids = graph.nodes.select("id")
    assert {r.id for r in held.pick("nodes", ids).collect()} == {r.id for r in ids.collect()}


def test_commands_do_not_read_the_log(spark, tmp_path, monkeypatch):
    store = EventLog(spark, tmp_path.as_uri())
    put(spark, store, random_events(random.Random(3), 150))
    c = Commands(store, checkpoint_interval=0)
    c.graph()
    read, sizes = EventLog._read, []

    def watched(self, entries, low=None):
        entries = list(entries)
        sizes.append(sum(e["rows"] for e in entries))
        return read(self, entries, low)

    monkeypatch.setattr(EventLog, "_read", watched)
    a, b = c.create_node("A", "api", id="a"), c.create_node("B", "api", id="b")
    c.create_edge(a, b, "calls", id="ab")
    with pytest.raises(EdgeExists):
        c.create_edge(a, b, "calls")
    c.delete_node("a")
    assert sizes and max(sizes) <= 2  # a command's own events, never those of before
    monkeypatch.undo()
    assert state(c.graph().nodes, c.graph().edges) == state(*replay.fold(store.events()))


def test_commands_at_once(spark, tmp_path):
    """Two writers of one edge: one wins, and the other sees it."""
    store = EventLog(spark, tmp_path.as_uri())
    first = Commands(store, checkpoint_interval=0)
    first.create_node("A", "api", id="a"), first.create_node("B", "api", id="b")
    seen, lock = [], threading.Lock()

    def write():
        try:
            out = Commands(EventLog(spark, tmp_path.as_uri()), checkpoint_interval=0).create_edge("a", "b", "calls")
        except EdgeExists:
            out = None
        with lock:
            seen.append(out)

    threads = [threading.Thread(target=write) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(x is None for x in seen) == [False, True] and store.count() == 3


def test_writers_at_once(spark, tmp_path):
    """Consecutive numbers, each batch in one piece."""
    rows = random_events(random.Random(9), 24)
    done = []
    threads = [threading.Thread(target=lambda k=k: done.append(put(spark, EventLog(spark, tmp_path.as_uri()), rows[k : k + 8]))) for k in (0, 8, 16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = EventLog(spark, tmp_path.as_uri())
    got = store.events().orderBy("seq").collect()
    assert sorted(done) == [8, 16, 24] and [r.seq for r in got] == list(range(1, 25))
    asked = [[(r[1], r[3], r[4]) for r in rows[k : k + 8]] for k in (0, 8, 16)]
    stored = [[(r.event_type, r.entity_id, r.payload) for r in got[k : k + 8]] for k in (0, 8, 16)]
    assert sorted(map(str, asked)) == sorted(map(str, stored))
    with pytest.raises(Conflict):
        store.append(spark.createDataFrame(rows[:1], EVENTS), expected=8)
    assert store.count() == 24


def test_damage_is_refused(spark, tmp_path):
    store = EventLog(spark, tmp_path.as_uri())
    put(spark, store, random_events(random.Random(1), 50))
    (tmp_path / "events" / "half").mkdir()  # what a crash leaves is not named
    (tmp_path / "events" / "half" / "part-0.parquet").write_bytes(b"?")
    assert store.events().count() == 50 and store.verify() == 1
    (file,) = [f for f in (tmp_path / "events").glob("*/*.parquet") if f.parent.name != "half"]
    whole = file.read_bytes()
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    file.write_bytes(whole[:-5])
    with pytest.raises(DamagedLog):
        store.events()
    altered = bytearray(whole)
    altered[len(whole) // 8] ^= 1
    file.write_bytes(bytes(altered))
    with pytest.raises(DamagedLog):
        store.verify()
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
        store.events().collect()
    file.write_bytes(whole)
    assert store.verify() == 1 and store.events().count() == 50


def scanned(df):
    """(files, rows) that the scans of a collected plan read."""
    plan, found = df._jdf.queryExecution().executedPlan(), [0, 0]
    todo = [plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            found = [a + node.metrics().apply(m).value() for a, m in zip(found, ("numFiles", "numOutputRows"))]
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return tuple(found)


def test_clustered_log(spark, tmp_path):
    rng = random.Random(4)
    store, total = EventLog(spark, tmp_path.as_uri()), 0
    for k in range(4):
        rows = [(i + 1, "node_updated", "node", f"n{rng.randrange(400):03d}", json.dumps({"id": "x"}), None, "t", "", START) for i in range(1500)]
        rows = [(*r[:4], json.dumps({"id": r[3], "name": "x", "type": "api", "properties": {}}), *r[5:]) for r in rows]
        total = put(spark, store, rows)
        if k == 2:
            before = {tuple(r) for r in store.events().collect()}
            assert store.cluster(rows_per_file=500) == 3 and store.cluster() == 0
            assert {tuple(r) for r in store.events().collect()} == before
    plain = entity_timeline(store.events(), "n007", 500)
    near = entity_timeline(store.of_entity("n007"), "n007", 500)
    want, got = [r.seq for r in plain.collect()], [r.seq for r in near.collect()]
    files, rows = scanned(near)
    assert got == want and files <= 3 and rows < total / 2
    # what follows a number is read from the last batch alone (twice, as a sort draws a sample)
    tail = store.range(4500)
    assert [r.seq for r in tail.collect()] == list(range(4501, 6001)) and scanned(tail)[1] <= 3000
    assert store.cluster(500) == 1 and [e["rows"] for e in store.manifest.state()[1].values()] == [4500, 1500]
    store.append(spark.createDataFrame(rows_of(store, 3000), EVENTS))
    assert store.cluster(500) == 3 and store.count() == store.events().count() == 9000 and store.max_seq() == 9000


def rows_of(store, n):
    return [tuple(r) for r in store.events().limit(n).collect()]


def test_versions_equal_fold_at_every_instant(spark, tmp_path):
    """Numbers and times in different order; nothing but near cells is read."""
    from provgraph.operators.versions import Versions

    rows = random_events(random.Random(11), 220)
    log = spark.createDataFrame(rows, EVENTS).cache()
    held = Versions(spark, tmp_path.as_uri()).build(log, cells=64, files=1)
    whole = scanned_files(held.spans())
    for minute in (-1, 0, 7, 50, 111, 180, 219, 10_000):
        at = START + dt.timedelta(minutes=minute)
        graph = held.at(at)
        assert state(graph.nodes, graph.edges) == state(*replay.fold(log, at))
    assert scanned_files(held.holding(START + dt.timedelta(minutes=20))) < whole / 2
    empty = Versions(spark, (tmp_path / "none").as_uri()).build(log.filter("false"))
    assert empty.at(START).nodes.count() == 0


def scanned_files(df):
    df.collect()
    return scanned(df)[0]


def test_versions_of_long_histories(spark, monkeypatch):
    """Stretches of few numbers, so that histories cross them."""
    from provgraph.operators import versions

    log = spark.createDataFrame(random_events(random.Random(12), 150), EVENTS)
    key = lambda rows: {(r.id, r.seq, r.since, r.until) for r in rows.collect()}
    want = key(versions.spans_of(log))
    monkeypatch.setattr(versions, "CHUNK", 7)
    assert key(versions.spans_of(log)) == want and want
