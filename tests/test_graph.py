"""Graph operators on hand-made graphs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics, graph, rules


def edges(spark, pairs, kind="CALLS"):
    rows = [(f"e{i:05d}", a, b, *(rest or (kind, 1.0, "ast"))) for i, (a, b, *rest) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id string, source string, target string, type string, confidence double, source_type string")


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_two_cliques_are_two_communities(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(1, 5) for j in range(1, 5) if i != j]
    got = graph.louvain(edges(spark, clique("a") + clique("b") + [("a4", "b1")]), "source", "target").collect()
    assert {r.id[0] for r in got if r.community == "a1"} == {"a"} and {r.id[0] for r in got if r.community == "b1"} == {"b"} and len(got) == 8


def test_long_ring_is_one_component():
    ring = [f"f{i:05d}" for i in range(20_000)]
    got = graph.tarjan(ring, {a: [b] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)})
    assert set(got.values()) == {"f00000"}


def test_many_small_components(spark):
    pairs = [p for i in range(300) for p in ((f"x{i:03d}", f"y{i:03d}"), (f"y{i:03d}", f"x{i:03d}"))]
    got = graph.strong_components(edges(spark, [*pairs, ("loop", "loop"), ("in", "x000")]), "source", "target").collect()
    assert len(got) == 601 and {r["size"] for r in got} == {1, 2} and next(r for r in got if r["size"] == 1).id == "loop"


def test_paths_are_simple_and_carry_the_least_confidence(spark):
    e = edges(spark, [("a", "b", "CALLS", 0.96, "ast"), ("b", "c", "CALLS", 1.0, "ast"), ("c", "a", "CALLS", 1.0, "ast"), ("b", "d", "CALLS", 0.5, "ast"), ("a", "z", "CONTAINS", 1.0, "ast")])
    got = {tuple(r.path): (r.distance, r.confidence) for r in graph.dependencies(e, seeds(spark, "a"), 5).collect()}
    assert got == {("a", "b"): (1, 0.96), ("a", "b", "c"): (2, 0.96)}
    back = {tuple(r.path) for r in graph.impact(e, seeds(spark, "c"), 5).collect()}
    assert back == {("c", "b"), ("c", "b", "a")}
    maybe = {tuple(r.path) for r in graph.potential_impact(e, seeds(spark, "d"), 5).collect()}
    assert maybe == {("d", "b"), ("d", "b", "a"), ("d", "b", "a", "c")}
    assert graph.impact(e, seeds(spark, "d"), 5).count() == 0


def test_limits_keep_the_first_and_say_so(spark):
    e = edges(spark, [(f"s{i}", "t") for i in range(9)])
    got = graph.impact(e, seeds(spark, "t"), 3, limit=4).collect()
    assert [r.node for r in sorted(got, key=lambda r: r.node)] == ["s0", "s1", "s2", "s3"] and all(r.truncated for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_traversals_agree_with_plain_search(spark, seed):
    r = random.Random(seed)
    pairs = sorted({(f"n{r.randrange(25):02d}", f"n{r.randrange(25):02d}") for _ in range(45)})
    e = edges(spark, pairs)
    dist = {"n00": 0}
    todo = ["n00"]
    for n in todo:
        for a, b in pairs:
            if a == n and b not in dist:
                dist[b] = dist[n] + 1
                todo.append(b)
    got = {x.node: x.distance for x in graph.bfs(e, seeds(spark, "n00"), 30).collect()}
    assert got == dist
    for target in [n for n in ("n03", "n11", "n24") if n in dist and n != "n00"]:
        path = sorted(graph.shortest_path(e, "n00", target, 30).collect(), key=lambda x: x.step)
        assert len(path) == dist[target] + 1 and path[0].node == "n00" and path[-1].node == target
        assert all((a.node, b.node) in pairs for a, b in zip(path, path[1:], strict=False))
    assert graph.shortest_path(e, "n00", "nowhere", 5).collect() == []


def test_depth_saturates_on_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")])
    assert {r.file: r.depth for r in graph.longest_depth(e, "source", "target", cap=6).collect()} == {"a": 2, "b": 1, "c": 0, "x": 6, "y": 6}


def plain_traverse(rows, start, depth, cap, reverse):
    """Edge by edge: (edge, node, depth, confidence, deterministic), and whether a cap left something out."""
    out, seen, truncated = [], {start: 0}, False
    front = {start: (0, 1.0, True)}
    while front and len(out) < cap:
        active = {n: s for n, s in front.items() if s[0] < depth}
        if not active:
            break
        at, to = (2, 1) if reverse else (1, 2)
        found = sorted((r for r in rows if r[at] in active), key=lambda r: (r[3], r[1], r[2], r[0]))
        room = cap - len(out)
        truncated |= len(found) > room
        nxt = {}
        for r in found[:room]:
            if r[0] in {x[0] for x in out}:
                continue
            d, c, sure = active[r[at]]
            state = (d + 1, min(c, r[4]), sure and r[5] != "heuristic" and r[4] == 1)
            out.append((r[0], r[to], *state))
            if len(seen) >= cap:
                truncated = True
            elif r[to] not in seen:
                seen[r[to]] = d + 1
                nxt[r[to]] = state
        front = nxt
    return out, truncated or (len(out) >= cap and bool(front))


@pytest.mark.parametrize("cap", [4, 9, 1000])
def test_bounded_traversal_against_plain_search(spark, cap):
    r = random.Random(cap)
    pairs = [(f"n{r.randrange(12):02d}", f"n{r.randrange(12):02d}", r.choice(["CALLS", "HANDLES"]), r.choice([1.0, 0.9, 0.5]), r.choice(["ast", "heuristic"])) for _ in range(40)]
    e = edges(spark, pairs)
    rows = [tuple(x) for x in e.collect()]
    for reverse in (False, True):
        got = graph.traverse(e, seeds(spark, "n00", "n05", "n99"), 3, cap, reverse=reverse).collect()
        for seed in ("n00", "n05", "n99"):
            want, truncated = plain_traverse(rows, seed, 3, cap, reverse)
            mine = [x for x in got if x.seed == seed]
            assert sorted((x.edge_id, x.node, x.depth, x.confidence, x.deterministic) for x in mine) == sorted(want)
            assert all(x.truncated == truncated for x in mine)


def plain_trace(rows, start, max_depth, max_nodes, max_paths):
    from tessera.model import TRACE_PRIORITY

    queue, nodes, ended, truncated = [(0, 0, start, 1.0, True, [start])], {start: (0, None, 1.0, True)}, 0, False
    while queue and ended < max_paths and len(nodes) <= max_nodes:
        queue.sort(key=lambda p: (-p[0], p[1], p[2]))
        _, d, n, c, sure, path = queue.pop(0)
        if d >= max_depth:
            ended += 1
            continue
        onward = sorted((x for x in rows if x[1] == n and x[3] in TRACE_PRIORITY), key=lambda x: (-TRACE_PRIORITY[x[3]], -x[4], x[2], x[0]))[:max_nodes]
        onward = [x for x in onward if x[2] not in path]
        pushed = 0
        for x in onward:
            if ended + len(queue) >= max_paths or len(nodes) >= max_nodes:
                truncated = True
                break
            state = (min(c, x[4]), sure and x[5] != "heuristic" and x[4] == 1)
            nodes.setdefault(x[2], (d + 1, x[0], *state))
            queue.append((TRACE_PRIORITY[x[3]] * 1000 + state[0] * 100 - d - 1, d + 1, x[2], *state, [*path, x[2]]))
            pushed += 1
        ended += not pushed
    return nodes, truncated or bool(queue)


@pytest.mark.parametrize("caps", [(3, 200, 50), (6, 5, 50), (6, 200, 6)])
def test_trace_against_plain_search(spark, caps):
    r = random.Random(sum(caps))
    pairs = [(f"n{r.randrange(15):02d}", f"n{r.randrange(15):02d}", r.choice(["CALLS", "HANDLES", "REFERENCES", "MOUNTS", "CONTAINS"]), r.choice([1.0, 0.9, 0.5]), r.choice(["ast", "heuristic"])) for _ in range(45)]
    e = edges(spark, pairs)
    want, truncated = plain_trace([tuple(x) for x in e.collect()], "n00", *caps)
    got = sorted(graph.trace(e, "n00", *caps).collect(), key=lambda x: x.position)
    assert [(x.node, x.depth, x.edge_id, x.confidence, x.deterministic) for x in got] == [(n, *v) for n, v in want.items()]
    assert all(x.truncated == truncated for x in got)


def test_trace_follows_a_good_chain(spark):
    e = edges(spark, [("s", f"r{i}", "REFERENCES", 1.0, "ast") for i in range(5)] + [(a, b, "HANDLES", 1.0, "ast") for a, b in (("s", "h1"), ("h1", "h2"), ("h2", "h3"), ("h3", "h4"))])
    got = sorted(graph.trace(e, "s", max_nodes=8, max_paths=3).collect(), key=lambda x: x.position)
    assert [x.node for x in got][:2] == ["s", "h1"] and {"h2", "h3", "h4"} <= {x.node for x in got} and all(x.truncated for x in got)


def modularity(pairs, of):
    total = 2 * sum(w for _, _, w in pairs)
    degree = {}
    for a, b, w in pairs:
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
    inside = sum(2 * w for a, b, w in pairs if of[a] == of[b])
    return inside / total - sum(sum(degree[n] for n in of if of[n] == c) ** 2 for c in set(of.values())) / total**2


@pytest.mark.parametrize("seed", range(4))
def test_communities_against_every_move(spark, seed):
    import numpy as np

    r = random.Random(seed)
    groups = [[f"g{g}n{i}" for i in range(6)] for g in range(5)]
    pairs = {}
    for g in groups:
        for a in g:
            for b in g:
                if a < b and r.random() < 0.7:
                    pairs[a, b] = r.choice([0.5, 1.0])
    for _ in range(8):
        a, b = sorted((r.choice(r.choice(groups)), r.choice(r.choice(groups))))
        if a != b:
            pairs.setdefault((a, b), 0.5)
    flat = [(a, b, w) for (a, b), w in pairs.items()]
    ids = sorted({n for p in pairs for n in p})
    x, y, w = (np.asarray(v) for v in ([ids.index(a) for a, _, _ in flat], [ids.index(b) for _, b, _ in flat], [c for _, _, c in flat]))
    order = np.lexsort((np.concatenate([y, x]), np.concatenate([x, y])))
    a, b, c = np.concatenate([x, y])[order], np.concatenate([y, x])[order], np.concatenate([w, w])[order]
    first = graph._local_moves(np.searchsorted(a, np.arange(len(ids) + 1)), b, c, 2 * w.sum())
    one = {n: int(first[i]) for i, n in enumerate(ids)}
    for n in ids:  # after the first level no node gains by a move of its own
        for other in {one[m] for p in pairs if n in p for m in p}:
            assert modularity(flat, {**one, n: other}) <= modularity(flat, one) + 1e-9
    of = {v.id: v.community for v in graph.louvain(edges(spark, [(a, b, "CALLS", c, "ast") for a, b, c in flat]), "source", "target").collect()}
    assert set(of) == set(ids) and all(of[n] == min(m for m in ids if of[m] == of[n]) for n in ids)
    assert modularity(flat, of) >= modularity(flat, one) - 1e-9 > 0


def test_community_loops_hold_their_node():
    import numpy as np

    x, y, w = np.asarray([0, 2, 1]), np.asarray([1, 3, 2]), np.asarray([1.0, 1.0, 0.1])
    assert graph.modularity_communities(4, x, y, w, 2 * w.sum()).tolist() == [0, 0, 2, 2]
    # two nodes and an edge become one community; with a heavy loop at each they stay apart
    start, near = np.asarray([0, 2, 4]), np.asarray([0, 1, 0, 1])
    assert graph._local_moves(start, near, np.asarray([0.0, 1.0, 1.0, 0.0]), 2.0).tolist() == [1, 1]
    assert graph._local_moves(start, near, np.asarray([9.0, 1.0, 1.0, 9.0]), 20.0).tolist() == [0, 1]


def test_limited_paths_are_the_first_of_all(spark):
    r = random.Random(3)
    pairs = sorted({(f"n{r.randrange(9)}", f"n{r.randrange(9)}") for _ in range(30)})
    e = edges(spark, [p for p in pairs if p[0] != p[1]])
    every = graph.impact(e, seeds(spark, "n0", "n1", "n2"), 4).collect()
    for limit in (1, 5, 17, 10**6):
        got = graph.impact(e, seeds(spark, "n0", "n1", "n2"), 4, limit=limit).collect()
        for seed in ("n0", "n1", "n2"):
            mine = sorted((x for x in every if x.seed == seed), key=lambda x: (x.distance, "\n".join(x.path), "\n".join(x.edge_ids)))
            assert sorted(tuple(x.edge_ids) for x in got if x.seed == seed) == sorted(tuple(x.edge_ids) for x in mine[:limit])
            assert all(x.truncated == (len(mine) > limit) for x in got if x.seed == seed)
    first = {(x.seed, x.node): x.first for x in graph.path_distances(e, seeds(spark, "n0", "n1", "n2"), 4).collect()}
    want = {}
    for x in every:
        want[x.seed, x.node] = min(want.get((x.seed, x.node), 99), x.distance)
    assert first == want


def test_lists_of_numbers_are_coded_and_read_back():
    r = random.Random(1)
    lists = [[0], [2**31 - 1], [5, 132, 133, 20_000, 3_000_000, 2**30], *(sorted(r.sample(range(70_000), r.randrange(1, 90))) for _ in range(40))]
    start = [sum(map(len, lists[:i])) for i in range(len(lists))]
    coded = graph._coded(np.asarray(sum(lists, [])), np.asarray(start))
    for a, b in ((0, len(lists)), (2, 9), (1, 2)):
        n, values = graph._decoded(coded.slice(a, b - a))
        assert n.tolist() == list(map(len, lists[a:b])) and values.tolist() == sum(lists[a:b], [])


@pytest.mark.parametrize("cyclic", [False, True])
def test_path_counts_are_grouped_paths(spark, cyclic):
    """Counted from lists of seeds, without a row for any path; where walks may run in cycles, from the paths."""
    r = random.Random(5)
    pairs = [(f"n{a:02}", f"n{b:02}", "CALLS", r.choice([0.95, 0.97, 1.0]), "ast") for a, b in ((r.randrange(16), r.randrange(16)) for _ in range(45)) if a < b or cyclic and a != b]
    e = edges(spark, [*pairs, *pairs[:4], ("n01", "n00", "CONTAINS", 1.0, "ast"), ("n03", "n03", "CALLS", 1.0, "ast")]).repartition(3)
    start = seeds(spark, "n15", "n14", "n09", "n09", "nowhere")
    for reverse in (True, False):
        depth = 3 if cyclic else 20
        listed = graph.simple_paths(e, start, depth, reverse, graph.definite_of(e)).groupBy("seed", "node", "distance").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_paths"))
        got = graph.path_counts(e, start, depth, reverse)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, listed.select(got.columns).collect())) != []
        assert ("InArrow" in got._jdf.queryExecution().toString()) != cyclic
    assert graph.path_counts(e, seeds(spark, "nowhere"), 4).collect() == []


@pytest.mark.parametrize("back", [[], [("s", "a")]])
def test_impact_description_counts_a_node_as_direct_and_transitive(spark, back):
    e = edges(spark, [("a", "s"), ("b", "a"), ("b", "s"), ("c", "b"), ("c", "t"), *back])
    n = spark.createDataFrame([("a", "module", "x", "d"), ("b", "endpoint", "x", None), ("c", "endpoint", None, "d"), ("s", "module", "y", "e"), ("t", None, None, None)], "node string, kind string, file string, domain string")
    got = {x.seed: tuple(x)[1:] for x in graph.impact_description(e, seeds(spark, "s", "t", "c"), n, 5).collect()}
    assert got == {"s": (2, 2, 1, 1, 2), "t": (1, 0, 0, 1, 1)}


def test_flows_keep_the_surest_paths_and_say_what_was_cut(spark):
    e = edges(spark, [("a", f"b{i}", "CALLS", 1.0 - i / 100, "ast") for i in range(9)] + [("b0", "c", "CALLS", 1.0, "ast"), ("c", "d", "CALLS", 1.0, "ast")])
    got = sorted(graph.flows(e, seeds(spark, "a"), ("CALLS",), depth=2, max_paths=4).collect(), key=lambda x: x["rank"])
    assert [list(x.path) for x in got] == [["a", "b1"], ["a", "b2"], ["a", "b3"], ["a", "b4"]] or len(got) == 4
    assert {tuple(x.path): x.truncated for x in graph.flows(e, seeds(spark, "a"), ("CALLS",), depth=2, max_paths=40).collect()} == {("a", "b0", "c"): True, **{("a", f"b{i}"): False for i in range(1, 9)}}
    deep = graph.flows(e, seeds(spark, "a"), ("CALLS",), depth=8, max_paths=40, max_steps=5).collect()
    assert sum(x.truncated for x in deep) >= 4


def test_a_path_rule_stops_at_the_first_target_of_a_node(spark):
    nodes = spark.createDataFrame([(x, "class" if x[0] == "t" else "service", x, None) for x in ("s", "m", "t1", "t2", "u", "t3")], "id string, kind string, name string, file string")
    nodes = nodes.withColumn("domain", F.lit(None).cast("string")).withColumn("qualified_name", F.when(F.col("id") == "u", "x.Worker"))
    e = edges(spark, [("s", "m"), ("m", "t1"), ("m", "t2"), ("m", "u"), ("s", "u"), ("u", "t3")])
    found = rules.path_violations(nodes, e, seeds(spark, "s"), rules.selector({"kind": "class"})).collect()
    assert sorted(list(x.path) for x in found) == [["s", "m", "t1"], ["s", "u", "t3"]]
    assert [x.id for x in rules.named(nodes).where(rules.selector({"layer": "worker"})).collect()] == ["u"]


def test_definite_knows_the_fact_class(spark):
    e = edges(spark, [("a", "b"), ("c", "b")]).withColumn("fact_class", F.when(F.col("source") == "a", "INFERRED").otherwise("DECLARED"))
    assert [x.node for x in graph.impact(e, seeds(spark, "b"), 2).collect()] == ["c"]


def test_flows_flag_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c")])
    got = {(tuple(r.path), r.cycle) for r in graph.flows(e, seeds(spark, "a"), ("CALLS",), depth=4).collect()}
    assert got == {(("a", "b", "a"), True), (("a", "b", "c"), False)}


def test_trace_prefers_better_edges(spark):
    e = edges(spark, [("a", "x", "REFERENCES", 1.0, "ast"), ("a", "y", "CALLS", 0.5, "ast"), ("a", "z", "HANDLES", 0.1, "ast")])
    assert [r.node for r in sorted(graph.trace(e, "a").collect(), key=lambda r: r.position)] == ["a", "z", "y", "x"]


def test_rules(spark):
    nodes = spark.createDataFrame([("c", "class", "UserController", "src/controller/user.ts", "web", {"team": "a"}), ("s", "class", "Service", "src/service/s.ts", "web", {}), ("r", "class", "Repository", "src/db/repository.ts", "data", {}), ("p", "class", "Pay", None, None, {})], "id string, kind string, name string, file string, domain string, metadata map<string,string>")
    e = edges(spark, [("c", "s", "CALLS", 1.0, "ast"), ("s", "r", "CALLS", 1.0, "ast"), ("c", "r", "IMPORTS", 0.35, "heuristic"), ("c", "r", "CONTAINS", 1.0, "ast"), ("c", "p", "CALLS", 1.0, "ast")])
    layer = nodes.select("id", rules.layer(F.lit(None).cast("string"), F.col("file"), F.col("name")).alias("l")).collect()
    assert {r.id: r.l for r in layer} == {"c": "controller", "s": "service", "r": "repository", "p": None}
    assert rules.direct_violations(nodes, e, {"layer": "controller"}, {"layer": "repository"}).count() == 0
    assert [r.id for r in rules.direct_violations(nodes, e, {"layer": "controller", "team": "A"}, {"name": "x", "kind": "class"}).collect()] == []
    found = rules.path_violations(rules.named(nodes), e, seeds(spark, "c"), rules.selector({"layer": "repository"})).collect()
    assert [list(r.path) for r in found] == [["c", "s", "r"]]
    assert rules.path_violations(nodes, e, seeds(spark, "c"), rules.selector({"layer": "repository"}), unless=rules.selector({"layer": "service"})).count() == 0
    assert {(r.source, r.target) for r in rules.crosses_domain(nodes, e).collect()} == {("s", "r"), ("c", "r")}


def test_edge_aggregation(spark):
    links = spark.createDataFrame([("1", "a/x", "b/y", 0.7), ("2", "a/x", "b/z", 0.95), ("3", "a/x", "a/y", 1.0)], "id string, source_file string, target_file string, confidence double")
    top = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(1))
    assert [tuple(r) for r in analytics.aggregate_edges(links, top("source_file"), top("target_file"), 2).collect()] == [("a", "b", 2, "1,2", "2,1")]


def test_empty_graph(spark):
    e = edges(spark, [("a", "b")]).limit(0)
    assert graph.bfs(e, seeds(spark, "a"), 3).count() == 1
    assert graph.strong_components(e, "source", "target").collect() == []
    assert graph.louvain(e, "source", "target").collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_flows_are_counted_as_plain_search_lists_them(spark, seed):
    r = random.Random(seed)
    n = 5 + 2 * seed
    out = {f"n{a}": [f"n{b}" for b in range(n) if b != a and a % 4 != 3 and r.random() < 0.4] for a in range(n)}
    pairs = [(a, b) for a in out for b in out[a]]
    want = {}

    def walk(path):
        cycle = path[-1] in path[:-1]
        if cycle or len(path) == 5 or not out[path[-1]]:
            key = (path[0], cycle, len(path))
            want[key] = want.get(key, 0) + 1
            return
        for b in out[path[-1]]:
            walk([*path, b])

    for a in out:
        if out[a]:
            walk([a])
    rows = [(f"e{i}", a, b, "CALLS", 1.0, "ast") for i, (a, b) in enumerate(pairs * 2)]
    got = graph.flow_counts(spark.createDataFrame(rows, "id string, source string, target string, type string, confidence double, source_type string"))
    assert {(x.seed, x.cycle, x.n_nodes): x.n_paths for x in got.collect()} == want


def test_more_flows_than_any_list_holds(spark):
    """65 nodes, all linked: 64 x 63 x 62 x 61 simple paths of four edges from each."""
    rows = [(f"e{a}-{b}", f"n{a}", f"n{b}", "CALLS", 1.0, "ast") for a in range(65) for b in range(65) if a != b]
    e = spark.createDataFrame(rows, "id string, source string, target string, type string, confidence double, source_type string")
    got = {(x.cycle, x.n_nodes): x.n_paths for x in graph.flow_counts(e).where("seed = 'n7'").collect()}
    assert got == {(True, 3): 64, (True, 4): 64 * 63 * 2, (True, 5): 64 * 63 * 62 * 3, (False, 5): 64 * 63 * 62 * 61}


def test_reach_is_that_of_a_plain_search(spark):
    r = random.Random(5)
    pairs = [(f"n{r.randrange(300)}", f"n{r.randrange(300)}") for _ in range(420)]
    e = spark.createDataFrame([(f"e{i}", a, b, "CALLS", 1.0, "ast") for i, (a, b) in enumerate(pairs)], "id string, source string, target string, type string, confidence double, source_type string")
    some = spark.createDataFrame([(f"n{i}",) for i in range(0, 310)] + [("n1",)], "id string")
    for depth in (1, 5):
        got = sorted(map(tuple, graph.reach(e, some, depth).collect()))
        assert got == sorted((x.seed, x.node, x.distance) for x in graph.bfs(e, some, depth).collect())


def test_reach_of_held_and_of_joined_graphs_agree(spark, monkeypatch):
    """Seeds that share nothing they reach: 70 rings of 20 nodes, and seeds that are in none."""
    pairs = [(f"r{k}.{i}", f"r{k}.{(i + 1) % 20}") for k in range(70) for i in range(20)] * 2 + [(f"r{k}.0", f"r{k}.0") for k in range(70)]
    some = spark.createDataFrame([(f"r{k}.{i}",) for k in range(70) for i in range(19)] + [("r0.0",), ("alone",), (None,)], "id string")
    with_none = edges(spark, [*pairs, (None, "r0.0"), ("r0.0", None)])
    want = {(f"r{k}.{i}", f"r{k}.{(i + d) % 20}", d) for k in range(70) for i in range(19) for d in range(5)} | {("alone", "alone", 0), (None, None, 0)}
    joined = []
    monkeypatch.setattr(graph, "_reach_joined", lambda *a, f=graph._reach_joined: joined.append(1) or f(*a))
    for sizes in ((2800, 1400, 1 << 30), (2800, 1399, 1 << 30), (1399, 1400, 1 << 30), (2800, 1400, 1400)):
        for name, size in zip(("_HELD_EDGES", "_HELD_NODES", "_HELD_WORK"), sizes, strict=True):
            monkeypatch.setattr(graph, name, size)
        got = [tuple(r) for r in graph.reach(with_none, some, 4).collect()]
        assert len(got) == len(want) and set(got) == want
    assert len(joined) == 3


def test_reach_stores_the_edges_and_no_pairs(spark, monkeypatch):
    """150 nodes, all of which reach all: 22,500 pairs from 300 edges."""
    stored = []
    monkeypatch.setattr(graph, "store", lambda df, f=graph.store: stored.append(f(df)) or stored[-1])
    monkeypatch.setattr(graph, "cut", lambda df: pytest.fail("a level was stored"))
    monkeypatch.setattr(graph, "discard", lambda *a: None)
    pairs = [(f"n{i}", f"n{(i + s) % 150}") for i in range(150) for s in (1, 12)]
    e = edges(spark, pairs)
    assert graph.reach(e, e.select(F.col("source").alias("id")), 30).count() == 22_500
    assert sum(x.count() for x in stored) == 450


def test_reach_in_several_chunks(spark, monkeypatch):
    """Chunks that cut a node's edges, and rows that cut a node's seeds; the work runs here, as workers have chunk sizes of their own."""
    r = random.Random(3)
    pairs = sorted({(r.randrange(40), r.randrange(40)) for _ in range(90)}, key=lambda p: (p[1], p[0]))
    for name, size in (("_FOLLOWED", 3), ("_LISTED", 7), ("_PAIRS", 5)):
        monkeypatch.setattr(graph, name, size)

    class Held:
        value = (pa.array([f"n{i}" for i in range(40)]), np.array([a for a, _ in pairs], np.int32), np.array([b for _, b in pairs], np.int32), np.arange(40, dtype=np.int32))

    rows = [x for b in graph._searched(Held, 3, 64)(iter([pa.RecordBatch.from_pydict({"id": [0]})])) for x in b.to_pylist()]
    got = sorted((x["seeds"][p % 64], x["nodes"][p // 64], x["distance"]) for x in rows for p in x["pairs"])
    want = []
    for seed in range(40):
        seen, front = {seed}, {seed}
        for d in (1, 2, 3):
            front = {b for a, b in pairs if a in front} - seen
            seen |= front
            want += [(f"n{seed}", f"n{b}", d) for b in front]
    assert got == sorted(want) and len(rows) > 40
