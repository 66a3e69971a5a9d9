"""Small graphs with known answers."""

import os

import pytest
from pyspark.sql import functions as F

from provgraph.errors import NodeNotFound, SubgraphTooLarge, ValidationError
from provgraph.functions.validation import dangling_edges, duplicate_edges, edge_rules, node_rules, violations
from provgraph.operators import detail, matrix, order, paths, search, stats, traverse
from provgraph.plans.graph import LineageGraph
from provgraph.schema import Limits

NODES = [
    ("gate", "Gate", "api", '{"owner":"kim","risk_level":"high"}'), ("shop", "Shop 店", "application", "{}"), ("cart", "Cart 店", "application", '{"owner":"lee"}'),
    ("mail", "Mail", "middleware", '{"ip":"10.1.0.7"}'), ("stock", "Stock", "database", "{}"), ("people", "People", "database", '{"risk_level":"high"}'),
    ("disk", "Disk", "storage", "{}"), ("rack", "Rack", "server", '{"ip":"10.1.0.4"}'), ("ana", "Ana", "person", "{}"),
]
EDGES = [
    ("x01", "gate", "shop", "calls", 2.0), ("x02", "gate", "cart", "calls", 5.0), ("x03", "shop", "cart", "calls", 1.0), ("x04", "shop", "people", "reads_from", 1.0), ("x05", "cart", "stock", "writes_to", 2.0),
    ("x06", "cart", "mail", "calls", 3.0), ("x07", "stock", "disk", "deploys_on", 1.0), ("x08", "mail", "rack", "deploys_on", 1.0), ("x09", "ana", "gate", "owns", 1.0), ("x10", "disk", "rack", "deploys_on", 1.0),
]


def graph(spark, nodes, edges, **limits):
    n = spark.createDataFrame([x if len(x) > 1 else (x[0], x[0], "server", "{}") for x in nodes], "id string, name string, type string, properties string")
    e = spark.createDataFrame([(*x[:5], x[5] if len(x) > 5 else True, "{}") for x in edges], "id string, source_id string, target_id string, relation string, weight double, directed boolean, properties string")
    return LineageGraph(n, e, Limits(**limits))


@pytest.fixture(scope="module")
def it(spark):
    return graph(spark, NODES, EDGES)


def depths(visits):
    return {r.node_id: r.depth for r in visits.collect()}


def ids(df):
    return {r.id for r in df.collect()}


def test_bfs(it):
    visits, cut = traverse.bfs(it, "gate")
    assert depths(visits) == {"gate": 0, "shop": 1, "cart": 1, "people": 2, "stock": 2, "mail": 2, "disk": 3, "rack": 3} and not cut
    assert [r.node_id for r in visits.orderBy("ord").collect()] == ["gate", "shop", "cart", "people", "stock", "mail", "disk", "rack"]
    one, _ = traverse.bfs(it, "gate", 1)
    assert ids(it.induced(one.select("node_id"))) == {"x01", "x02", "x03"}
    assert set(depths(traverse.bfs(it, "disk", direction="in")[0])) == {"disk", "stock", "cart", "shop", "gate", "ana"}
    assert set(depths(traverse.bfs(it, "gate", relations=["calls"])[0])) == {"gate", "shop", "cart", "mail"}
    few, cut = traverse.bfs(it, "cart", direction="both", max_nodes=3)
    assert cut and few.count() == 3
    assert traverse.neighbours(it, "cart").count() == 5
    with pytest.raises(NodeNotFound):
        traverse.bfs(it, "nowhere")


def test_dfs_and_cycles(spark, it):
    rows = traverse.dfs(it, "gate").orderBy("ord").collect()
    assert [r.node_id for r in rows] == ["gate", "shop", "cart", "stock", "disk", "rack", "mail", "people"] and not rows[0].cycle_detected and not rows[0].truncated
    few = traverse.dfs(it, "gate", max_nodes=3).orderBy("ord").collect()
    assert [r.node_id for r in few] == ["gate", "shop", "cart"] and few[0].truncated
    with pytest.raises(SubgraphTooLarge):
        traverse.dfs(LineageGraph(it.nodes, it.edges, Limits(nodes=4)), "gate")
    wheel = graph(spark, [("n",), ("o",), ("p",), ("q",), ("r",)], [("1", "n", "o", "calls", 1.0), ("2", "o", "p", "calls", 1.0), ("3", "p", "q", "calls", 1.0), ("4", "q", "n", "calls", 1.0), ("5", "p", "r", "calls", 1.0)])
    assert traverse.dfs(wheel, "n").first().cycle_detected
    assert traverse.dfs(wheel, "r").count() == 1
    found, more = paths.all_paths(wheel, "q", "r")
    assert [r.node_ids for r in found.collect()] == [["q", "n", "o", "p", "r"]] and not more
    r = order.has_cycle(wheel).first()
    assert r.has_cycle and r.topo_length == 0


def test_lineage_and_impact(it):
    levels = {"ana": -2, "gate": -1, "shop": -1, "cart": 0, "stock": 1, "mail": 1, "disk": 2, "rack": 2}
    assert {r.node_id: r.level for r in traverse.lineage(it, "cart").collect()} == levels
    view = traverse.lineage_view(it, "cart")
    assert {r.node_id: r.level for r in view["levels"].collect()} == levels and ids(view["edges"]) == {e[0] for e in EDGES} - {"x04"}
    assert tuple(view["totals"].first()) == (3, 4, False)
    cut = traverse.lineage_view(it, "cart", max_nodes=2)
    assert tuple(cut["totals"].first()) == (1, 1, True) and cut["levels"].count() == 3
    r = traverse.impact(it, "shop").first()
    assert (r.direct_downstream, r.total_downstream, r.direct_upstream, r.total_upstream, r.max_depth) == (2, 6, 1, 2, 3)
    assert {r.type: r.n for r in traverse.impact_by_type(it, "shop").collect()} == {"application": 1, "database": 2, "middleware": 1, "storage": 1, "server": 1}


def test_detail_structure_metadata(spark, it):
    log = spark.createDataFrame([("shop",), ("shop",), ("x01",)], "entity_id string")
    view = detail.node_detail(it, log, "shop")
    r = view["summary"].first()
    assert (r.name, r.in_degree, r.out_degree, r.total_downstream, r.total_upstream, r.event_count) == ("Shop 店", 1, 2, 6, 2, 2)
    assert ids(view["incident"]) == {"x01", "x03", "x04"} and {x.type: x.n for x in view["by_type"].collect()}["database"] == 2
    whole = detail.structure(it)
    r = whole["summary"].first()
    assert (r.node_count, r.edge_count, r.max_degree, r.has_cycle, r.topo_length) == (9, 10, 4, False, 9)
    assert ids(whole["roots"]) == {"ana"} and ids(whole["leaves"]) == {"people", "rack"}
    facts = {(r.kind, r.value): r.label for r in detail.metadata(it).collect()}
    assert facts["stat", "node_count"] == "9" and facts["limit", "matrix"] == "500" and ("property_key", "ip") in facts and facts["event_type", "edge_deleted"] == "Edge deleted"


def test_paths(spark, it):
    r = paths.shortest_path(it, "gate", "cart").first()
    assert (r.found, r.cost, r.hops, r.edge_ids, r.visited_count, r.truncated) == (True, 3.0, 2, ["x01", "x03"], 3, False)
    r = paths.shortest_path(it, "gate", "cart", max_visit=2).first()
    assert (r.found, r.cost, r.node_ids, r.visited_count, r.truncated) == (False, None, [], 2, True)
    r = paths.shortest_path(it, "gate", "rack").first()  # of two ways of cost 7
    assert (r.cost, r.node_ids) == (7.0, ["gate", "shop", "cart", "stock", "disk", "rack"])
    assert paths.shortest_path(it, "people", "rack", "both").first().cost == 6
    r = paths.shortest_path(it, "rack", "gate").first()
    assert (r.found, r.visited_count, r.truncated) == (False, 1, False)
    assert paths.shortest_path(it, "rack", "rack").first().hops == 0
    free = graph(spark, [("s",), ("b",), ("a",), ("t",)], [("1", "s", "b", "calls", 0.0), ("2", "b", "a", "calls", 0.0), ("3", "a", "b", "calls", 0.0), ("4", "a", "t", "calls", 0.0)])
    assert paths.shortest_path(free, "s", "t").first().node_ids == ["s", "b", "a", "t"]
    found, _ = paths.all_paths(it, "gate", "cart")
    assert [(r.cost, r.hops) for r in found.collect()] == [(3.0, 2), (5.0, 1)]
    view = paths.path_view(it, "gate", "rack")
    assert [(r.cost, r.hops) for r in view["paths"].collect()] == [(7.0, 4), (7.0, 5), (9.0, 3), (9.0, 4)] and not view["truncated"]
    assert ids(view["nodes"]) == {"gate", "shop", "cart", "stock", "mail", "disk", "rack"} and ids(view["edges"]) == {e[0] for e in EDGES} - {"x04", "x09"}
    first, more = paths.all_paths(it, "gate", "rack", max_paths=2)
    assert more and [r.edge_ids for r in first.orderBy("edge_ids").collect()] == [["x01", "x03", "x05", "x07", "x10"], ["x01", "x03", "x06", "x08"]]
    assert paths.path_view(it, "gate", "rack", 3)["paths"].count() == 1 and paths.path_view(it, "rack", "gate")["paths"].isEmpty()


def test_path_bounds_hold_while_paths_grow(spark):
    # ten layers of three: 3 ** 9 paths
    layers = [[f"n{k:02d}{c}" for c in "abc"] for k in range(10)]
    nodes = [("s",), ("t",), *((n,) for layer in layers for n in layer)]
    steps = [("s", n) for n in layers[0]] + [(a, b) for x, y in zip(layers, layers[1:]) for a in x for b in y] + [(n, "t") for n in layers[-1]]
    g = graph(spark, nodes, [(f"{a}-{b}", a, b, "calls", 1.0) for a, b in steps], depth=11)
    few = LineageGraph(g.nodes, g.edges, Limits(depth=5, paths=4))
    view = paths.path_view(few, "s", "n04a")
    ways = [["n00a", "n01a", *x] for x in (["n02a", "n03a"], ["n02a", "n03b"], ["n02a", "n03c"], ["n02b", "n03a"])]
    assert view["truncated"] and [r.node_ids[1:5] for r in view["paths"].orderBy("edge_ids").collect()] == ways


def test_order_roots_matrix(spark, it):
    roots, leaves = stats.roots_and_leaves(it)
    assert [r.id for r in roots.collect()] == ["ana"] and ids(leaves) == {"people", "rack"}
    assert [r.id for r in order.topological_order(it).orderBy("ord").collect()] == ["ana", "gate", "shop", "cart", "mail", "people", "stock", "disk", "rack"]
    assert [r.id for r in order.level_order(it).orderBy("ord").collect()] == ["ana", "gate", "shop", "cart", "people", "mail", "stock", "disk", "rack"]
    assert {r.ord for r in order.level_order(it).collect()} == set(range(9))
    assert matrix.density(it).first().density == pytest.approx(10 / 72)
    hops = {(r.i, r.j): r.n for r in matrix.two_hop(it).collect()}
    assert hops[("gate", "cart")] == 1 and hops[("gate", "stock")] == 1 and ("gate", "rack") not in hops
    assert matrix.component_sizes(it).first().size == 9
    assert len(matrix.dense(it).first().row) == 9
    with pytest.raises(SubgraphTooLarge):
        matrix.dense(LineageGraph(it.nodes, it.edges, Limits(matrix=3)))
    with pytest.raises(NodeNotFound):
        matrix.subgraph(it, ["cart", "nowhere"])
    whole = matrix.analysis(it, ["gate", "shop", "cart", "rack"])
    r = whole["summary"].first()
    assert (r.node_count, r.edge_count, r.component_count, r.largest_component) == (4, 3, 2, 3) and r.density == pytest.approx(3 / 12)
    assert {(x.i, x.j): x.n for x in whole["two_hop"].collect()} == {("gate", "cart"): 1} and whole["cells"].count() == 3
    apart = graph(spark, [("k1",), ("k2",), ("m1",), ("m2",), ("solo",)], [("1", "k1", "k2", "calls", 2.0, False), ("2", "m2", "m1", "calls", 1.0)])
    assert {r.id: r.component for r in matrix.components(apart).collect()} == {"k1": "k1", "k2": "k1", "m1": "m1", "m2": "m1", "solo": "solo"}
    assert {(r.i, r.j, r.weight) for r in matrix.cells(apart).collect()} >= {("k1", "k2", 2.0), ("k2", "k1", 2.0)}
    assert order.has_cycle(apart).first().topo_length == 5
    s = stats.stats(apart).first()
    assert (s.node_count, s.edge_count, s.max_degree, s.isolated_count, s.avg_degree) == (5, 2, 1, 1, pytest.approx(0.8))


def test_search_and_topology(it):
    assert ids(search.search(it.nodes, types=["database"])) == {"stock", "people"}
    assert ids(search.search(it.nodes, key="risk_level", value="high")) == {"gate", "people"}
    assert ids(search.search(it.nodes, key="ip")) == {"mail", "rack"}
    assert ids(search.search(it.nodes, keyword="店")) == {"shop", "cart"}
    assert [r.key for r in search.property_keys(it.nodes).collect()] == ["ip", "owner", "risk_level"]
    with pytest.raises(ValidationError):
        search.search(it.nodes, types=["spaceship"])
    top = stats.topology(it, limit=3)
    t = top["totals"].first()
    assert ids(top["nodes"]) == {"cart", "gate", "shop"} and (t.total_nodes, t.truncated) == (9, True)


def test_rules(spark, it):
    bad = spark.createDataFrame([("", "x", "api", "{}"), ("a", "n" * 129, "api", "{}"), ("b", "x", "ship", "{}"), ("c", "x", "api", '{"a b":1}'), ("d", "x", "api", "no"), ("e", "x", "api", '{"k":"' + "v" * 2049 + '"}'), ("ok", "x", "api", '{"风险":1}')], "id string, name string, type string, properties string")
    assert {r.id: r.violation for r in violations(bad, node_rules()).collect()} == {"": "blank id", "a": "name too long", "b": "unknown type", "c": "bad property key", "d": "properties are no object", "e": "property value too long"}
    edges = graph(spark, [], [("1", "a", "a", "calls", 1.0), ("2", "a", "b", "calls", -1.0), ("3", "a", "b", "calls", 1.0), ("4", "b", "a", "calls", 1.0, False), ("5", "a", "b", "calls", 2.0, False)]).edges
    assert {r.id: r.violation for r in violations(edges, edge_rules()).collect()} == {"1": "self loop", "2": "bad weight"}
    assert {(r.source_id, r.target_id): r.n for r in duplicate_edges(edges.filter("id > 2")).collect()} == {("a", "b"): 3}
    assert dangling_edges(edges, it.nodes).count() == 5


def test_random_against_dijkstra(spark):
    import heapq
    import random

    rng = random.Random(5)
    names = [f"n{i}" for i in range(25)]
    edges = [(f"e{i:03d}", a, b, "calls", float(rng.randint(1, 9)), rng.random() < 0.8) for i in range(80) for a, b in [rng.sample(names, 2)]]
    g = graph(spark, [(n,) for n in names], edges)
    out = {}
    for _, a, b, _, w, directed in edges:
        out.setdefault(a, []).append((b, w))
        if not directed:
            out.setdefault(b, []).append((a, w))
    best, heap = {}, [(0.0, "n0")]
    while heap:
        c, n = heapq.heappop(heap)
        if n not in best:
            best[n] = c
            for m, w in out.get(n, []):
                heapq.heappush(heap, (c + w, m))
    assert {r.node_id: r.cost for r in paths.distances(g, "n0")[0].collect()} == best


def test_shortest_path_reads_only_edges_that_count(spark):
    """Of 81 edges, free ones among them, those no dearer than the goal's best
    are left; the path is that of all edges, by the same order of ties."""
    import random

    rng = random.Random(9)
    edges = [(f"e{i:03d}", *rng.sample([f"n{k}" for k in range(20)], 2), "calls", float(rng.choice([0, 0, 1, 1, 2, 9, 50]))) for i in range(80)] + [("far", "n0", "n7", "calls", 7.0)]
    g = graph(spark, [(f"n{k}",) for k in range(20)], edges)
    best = {"n0": (0.0, 0)}  # least cost, then fewest edges
    for _ in range(20):
        for _, a, b, _, w in edges:
            if a in best:
                best[b] = min(best.get(b, (1e9, 0)), (best[a][0] + w, best[a][1] + 1))
    for goal in ("n7",):
        cost, found, via = best[goal][0], [goal], []
        while found[0] != "n0":
            (_, _, a, e) = min((*best[a], a, e) for e, a, b, _, w in edges if b == found[0] and a in best and best[a][0] + w == best[b][0])
            found, via = [a, *found], [e, *via]
        r = paths.shortest_path(g, "n0", goal).first()
        assert (r.cost, r.node_ids, r.edge_ids) == (cost, found, via)
        costs, left = paths.distances(g, "n0", goal)
        assert {x.node_id: x.hop for x in costs.collect() if x.cost <= cost} == {n: h for n, (c, h) in best.items() if c <= cost}
        assert left.count() < 81 and left.agg({"weight": "max"}).first()[0] <= cost


def test_many_roots_equal_one_by_one(spark):
    """More roots than a word has bits, in a graph with cycles."""
    import random

    from provgraph.operators import many

    rng = random.Random(4)
    nodes = spark.createDataFrame([(f"n{i}", f"n{i}", "api", "{}") for i in range(150)], "id string, name string, type string, properties string")
    rows = [(f"e{k}", f"n{rng.randrange(150)}", f"n{rng.randrange(150)}", rng.choice(["calls", "owns"]), 1.0, rng.random() < 0.7, "{}") for k in range(260)]
    graph = LineageGraph(nodes, spark.createDataFrame(rows, "id string, source_id string, target_id string, relation string, weight double, directed boolean, properties string")).saved()
    roots = nodes.select("id").filter("id != 'n7'")
    for direction, relations in (("out", ()), ("both", ("calls",))):
        found = many.reach_many(graph, roots, 4, direction, relations)
        want = {tuple(r) for r in traverse.reach(graph, roots, 4, direction, relations).collect()}
        assert {tuple(r) for r in found.pairs().collect()} == want and len(want) > 1000
        counts = {}
        for root, _, depth in want:
            counts[root, depth] = counts.get((root, depth), 0) + 1
        assert {(r.root, r.depth): r.n for r in found.counts().collect()} == counts
    one = {r.root: r for r in many.impact_many(graph, roots, 3).collect()}["n3"]
    alone = traverse.impact(graph, "n3", 3).first()
    assert (one.direct_downstream, one.total_downstream, one.max_depth) == (alone.direct_downstream, alone.total_downstream, alone.max_depth)
    assert many.reach_many(graph, roots.filter("false"), 2).counts().isEmpty()


def test_two_ended_equals_one_sided(spark):
    """Random weights, cycles, undirected edges, and goals out of reach."""
    import random

    from provgraph.operators.twoended import two_ended

    rng = random.Random(6)
    nodes = spark.createDataFrame([(f"n{i}", f"n{i}", "api", "{}") for i in range(60)], "id string, name string, type string, properties string")
    rows = [(f"e{k}", f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", "calls", rng.choice([0.5, 1.0, rng.uniform(1, 9)]), rng.random() < 0.8, "{}") for k in range(130)]
    g = LineageGraph(nodes, spark.createDataFrame(rows, "id string, source_id string, target_id string, relation string, weight double, directed boolean, properties string")).saved()
    weight, found = {r[0]: r[4] for r in rows}, 0
    best = {r.node_id: r.cost for r in paths.distances(g, "n0")[0].collect()}
    for goal, width in (("n17", 0.0), ("n23", 0.7), ("n41", 100.0)):
        row = two_ended(g, "n0", goal, width=width)[0].first()
        assert row.found == (goal in best)
        if row.found:
            found += 1
            assert abs(row.cost - best[goal]) < 1e-9 and abs(sum(weight[e] for e in row.edge_ids) - row.cost) < 1e-9
            assert row.node_ids[0] == "n0" and row.node_ids[-1] == goal and len(row.node_ids) == row.hops + 1 == len(row.edge_ids) + 1
            ends = {r[0]: ({(r[1], r[2])} | (set() if r[5] else {(r[2], r[1])})) for r in rows}
            assert all((a, b) in ends[e] for a, b, e in zip(row.node_ids, row.node_ids[1:], row.edge_ids))
    assert found >= 2
    back = two_ended(g, "n17", "n0", direction="in")[0].first()
    assert back.found == ("n17" in best) and (not back.found or abs(back.cost - best["n17"]) < 1e-9)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_what_asks_for_links_does_not_write_the_key_graph(spark):
    from provgraph import queries

    queries._saved.clear()
    for name in ("bfs_in", "roots"):
        assert not queries.QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty()
    assert not queries._saved


def test_dangling_needs_no_ids(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "x"), ("y", "b"), ("y", "x")], "source_id string, target_id string")
    assert sorted(map(tuple, dangling_edges(edges, nodes).collect())) == [("a", "x"), ("y", "b"), ("y", "x")]


@pytest.mark.parametrize("rising", [True, False])
def test_topological_order_beyond_one_task(spark, rising):
    import random

    draw = random.Random(5)
    names = [f"n{i}" for i in range(1, 15)]
    order_ = sorted(names) if rising else draw.sample(names, len(names))
    pairs = {tuple(sorted(draw.sample(range(14), 2))) for _ in range(18)}
    ends = [(order_[i], order_[j]) for i, j in pairs] + ([] if rising else [("c1", "c2"), ("c2", "c1"), ("c2", "c3")])
    g = graph(spark, [(n,) for n in names + ([] if rising else ["c1", "c2", "c3"])], [(str(i), a, b, "calls", 1.0) for i, (a, b) in enumerate(ends)])
    listed = lambda x: [r.id for r in sorted(order.topological_order(x).collect(), key=lambda r: r.ord)]
    found = listed(LineageGraph(g.nodes, g.edges, Limits(nodes=5)))
    assert found == listed(g) and len(found) == 14


def test_components_of_many_shapes(spark):
    import random

    draw = random.Random(3)
    ends = [(f"a{draw.randrange(30)}", f"a{draw.randrange(30)}") for _ in range(22)] + [(f"l{i}", f"l{i + 1}") for i in range(9)] + [("hub", f"s{i}") for i in range(6)] + [("p", "q"), ("q", "p"), ("z", "z"), ("hub", "s1")]
    names = sorted({n for pair in ends for n in pair} | {"lone"})
    root = {n: n for n in names}
    for _ in names:
        for a, b in ends:
            root[a] = root[b] = min(root[a], root[b])
    g = graph(spark, [(n,) for n in names], [(str(i), a, b, "calls", 1.0) for i, (a, b) in enumerate(ends)])
    assert {r.id: r.component for r in matrix.components(g).collect()} == root
    sizes = {r.component: r.size for r in matrix.component_sizes(g).collect()}
    assert sizes == {c: list(root.values()).count(c) for c in root.values()}


def test_two_hop_shuffles_no_single_ways(spark, it):
    two = matrix.two_hop(it)
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Generate explode(js") < plan.rindex("REPARTITION_BY_COL") and "Exchange" not in plan[: plan.index("Generate explode(js")]
    pairs = {(r.source_id, r.target_id) for r in it.edges.collect()}
    assert {(r.i, r.j): r.n for r in two.collect()} == {(a, d): sum((a, k) in pairs and (k, d) in pairs for k in {b for _, b in pairs}) for a, b in pairs for c, d in pairs if b == c}
