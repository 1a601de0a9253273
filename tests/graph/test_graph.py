from collections import deque

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cartomill.functions.communities import places, propagated, shuffled
from cartomill.operators import graph as G

from .fixtures import SYMBOLS, graph


def test_sources_and_sinks(spark):
    g = graph(spark, [("a", "b", "call"), ("b", "c", "instantiation"), ("a", "c", "import")])
    assert [r.file for r in G.find_sources(g.edges).collect()] == ["a"] and [r.file for r in G.find_sinks(g.edges).collect()] == ["c"]


def test_shortest_path(spark):
    g = graph(spark, [("A", "B"), ("B", "D"), ("A", "C"), ("C", "D")])
    assert G.critical_path(g.edges, "A", "D").first().path == ["A", "B", "D"]
    assert G.critical_path(g.edges, "B", "C").first() is None and G.critical_path(g.edges, "A", "A").first().length == 1


def test_trace_follows_a_cycle_once(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    t = G.trace(g, "a", depth=5)
    assert [[f for f, _ in p] for p in t["paths"]] == [["a", "b", "c"]] and t["nodes"] == 3
    assert t["cycles"] == [{"from": "c", "to": "a", "type": "call", "length": 3}]
    assert G.cycles(g.edges).collect()[0].path == ["a", "b", "c"]
    t = G.trace(graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]), "a")
    assert [[f for f, _ in p] for p in t["paths"]] == [["a", "b", "d"]] and not t["max_depth_reached"]
    assert G.trace(graph(spark, [("a", "b"), ("b", "c")]), "a", depth=1)["max_depth_reached"]


def test_pagerank(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")])
    nodes, edges = G.nodes(g), G.graph_edges(g)
    got = {r.id: r.rank for r in G.pagerank(nodes, edges, max_iter=60, tol=1e-12).collect()}
    names = [f"file://{x}" for x in "abcd"]
    out = {"file://a": ["file://b", "file://d"], "file://b": ["file://c"], "file://c": ["file://a"], "file://d": []}
    want = dict.fromkeys(names, 0.25)
    for _ in range(60):
        lost = sum(want[n] for n in names if not out[n])
        want = {n: 0.15 / 4 + 0.85 * (lost / 4 + sum(want[m] / len(out[m]) for m in names if n in out[m])) for n in names}
    assert abs(sum(got.values()) - 1) < 1e-9 and all(abs(got[n] - want[n]) < 1e-9 for n in names)


def test_symbol_nodes(spark):
    symbols = [("f", "r", "C", "class", None, 1, 9), ("f", "r", "m", "method", "C", 2, 3), ("f", "r", "C", "method", "C", 4, 5)]
    g = graph(spark, [], files=["f"], symbols=symbols)
    assert {(r.src, r.dst) for r in G.contains_edges(g).collect()} == {("file://f", "symbol://f::C"), ("file://f", "symbol://f::m"), ("symbol://f::C", "symbol://f::m")}


def calls(spark):
    symbols = [("a", "r", "f", "function", None, 1, 9), ("b", "r", "g", "method", "K", 1, 9), ("c", "r", "h", "function", None, 1, 9), ("x.test.ts", "r", "t", "function", None, 1, 9)]
    edges = [("b", "a", "call", None, "K::g", "f"), ("c", "b", "call", None, "h", "g"), ("b", "c", "extends", None, "K::g", "h"), ("x.test.ts", "a", "call", None, "t", "f"), ("c", "a", "import", None, "h", "f")]
    return graph(spark, edges, files=["a", "b", "c", "x.test.ts"], symbols=symbols)


def test_callers_and_impact(spark):
    g = calls(spark)
    got = {(r.depth, r.source_symbol) for r in G.symbol_bfs(g.symbols, g.edges, "f", 3).collect()}
    assert got == {(1, "K::g"), (1, "t"), (2, "h"), (3, "K::g")}
    assert {(r.depth, r.target_symbol) for r in G.symbol_bfs(g.symbols, g.edges, "h", 1, up=False).collect()} == {(1, "g"), (1, "f")}
    hit = G.impact(g.symbols, g.edges, "f", 3)
    assert {(r.symbol, r.depth, r.risk) for r in hit.collect()} == {("K::g", 1, "HIGH"), ("t", 1, "LOW"), ("h", 2, "MEDIUM")}
    s = G.risk_summary(hit).first()
    assert (s.high, s.medium, s.low) == (1, 1, 1) and "BREAKING" in s.recommendation
    assert G.risk_summary(G.impact(g.symbols, g.edges, "nothing")).first().recommendation.startswith("No callers")


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), min_size=1, max_size=14))
def test_distances_against_a_queue(spark, pairs):
    g = graph(spark, pairs)
    near = {}
    for s, t in pairs:
        near.setdefault(s, set()).add(t)
        near.setdefault(t, set()).add(s)
    want, todo = {pairs[0][0]: 0}, deque([pairs[0][0]])
    while todo:
        x = todo.popleft()
        for y in near[x]:
            if y not in want and want[x] < 3:
                want[y] = want[x] + 1
                todo.append(y)
    seeds = spark.createDataFrame([(pairs[0][0],)], "path string")
    assert {r.path: r.depth for r in G.distances(g.edges, seeds, 3).collect()} == want


def test_communities(spark):
    links = [("a", "b", 2), ("b", "c", 2), ("a", "c", 2), ("x", "y", 1), ("y", "z", 1), ("x", "z", 1), ("c", "x", 1)]
    order = [places(6, k) for k in range(10)]
    label = propagated({n: [o[i] for o in order] for i, n in enumerate("abcxyz")}, links)
    assert len({label[n] for n in "abc"}) == 1 and label["x"] == label["z"]
    orders = [shuffled(6, seed) for seed in range(42, 52)]
    assert len(set(map(tuple, orders))) > 5 and all(sorted(o) == list(range(6)) for o in orders)
    # a part of a graph gets the labels that it has in the whole, where a part's nodes keep their places
    far = [("p", "q", 3), ("q", "r", 1), ("m", "p", 2)]
    names = sorted("abcxyz" + "mpqr" + "uv")
    order = [places(len(names), k) for k in range(10)]
    whole = propagated({n: [o[i] for o in order] for i, n in enumerate(names)}, links + far)
    part = propagated({n: [o[names.index(n)] for o in order] for n in "mpqr"}, far)
    assert {n: whole[n] for n in "mpqr"} == part and (whole["u"], whole["v"]) == ("u", "v")
    g = graph(spark, [(u, v) for u, v, w in links + far for _ in range(w)])
    both = sorted({n for u, v, _ in links + far for n in (u, v)})
    order = [places(len(both), k) for k in range(10)]
    want = propagated({n: [o[i] for o in order] for i, n in enumerate(both)}, links + far)
    assert {r.path: r.label for r in G.community_exact(g.edges, g.files).collect()} == want
    g = graph(spark, [(u, v) for u, v, w in links for _ in range(w)])
    got = {r.path: r.label for r in G.community_exact(g.edges, g.files).collect()}
    assert got == label
    none = spark.createDataFrame([], "cluster_name string, file_path string")
    numbered = G.numbered_communities(G.community_exact(g.edges, g.files).select("path", "label"), none)
    assert {r.cluster_name for r in numbered.collect()} <= {"community_1", "community_2"}


def test_a_large_component_is_propagated_in_numbers():
    """What a task holds is a few numbers a link, not names in dictionaries."""
    import tracemalloc

    import numpy as np

    from cartomill.functions.communities import drawn, labelled

    n, m, rng = 2_000, 100_000, np.random.default_rng(1)
    u, v, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(1, 4, m)
    order = [drawn(n, k) for k in range(2)]
    tracemalloc.start()
    found = labelled(order, u, v, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * m
    names = [f"{i:05d}" for i in range(n)]
    want = propagated({x: [int(o[i]) for o in order] for i, x in enumerate(names)}, [(names[a], names[b], int(c)) for a, b, c in zip(u, v, w)])
    assert [names[x] for x in found] == list(want.values())


def test_rounds_leave_only_their_result(spark, tmp_path):
    """PageRank and label propagation delete what they wrote on the way."""
    import os

    from cartomill.functions.lineage import shared_dir
    from cartomill.operators import graph as O

    place = shared_dir(spark).removeprefix("file://")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    before = set(os.listdir(place))
    ranks = O.pagerank(nodes, links)
    assert len(set(os.listdir(place)) - before) == 1 and abs(sum(r["rank"] for r in ranks.collect()) - 1) < 1e-3
    before = set(os.listdir(place))
    labels = O.community_sync(links.selectExpr("src AS source_file", "dst AS target_file"), nodes.selectExpr("id AS path"))
    assert len(set(os.listdir(place)) - before) == 1 and labels.count() == 4


def test_community_sync_on_odd_files_and_edges(spark):
    """A path listed twice votes twice, one without edges keeps its label, null has none, unknown files have no vote."""
    links = [("a", "b"), ("b", "a"), ("c", "b"), ("c", "d"), ("d", "d"), ("e", "zz"), ("zz", "a"), (None, "a"), ("b", "f"), ("f", "g")]
    names = ["a", "b", "c", "c", "d", "e", "f", "g", "lone", None]
    edges = spark.createDataFrame(links, "source_file string, target_file string")
    files = spark.createDataFrame([(n,) for n in names], "path string")
    label = {n: n for n in names if n}
    for _ in range(5):
        new = dict(label)
        for n in label:
            votes = {}
            for x, y in [(x, y) for u, v in links if u != v for x, y in ((u, v), (v, u))]:
                if x == n and y in label:
                    votes[label[y]] = votes.get(label[y], 0) + names.count(y)
            if votes:
                new[n] = min(votes, key=lambda x: (-votes[x], x))
        label = new
    got = sorted(((r.path, r.label) for r in G.community_sync(edges, files).collect()), key=str)
    assert got == sorted(((n, label.get(n)) for n in names), key=str)


def test_shuffles_go_with_what_they_were_for(spark):
    """Label propagation and the derived edges leave no shuffle files, which at size are most of the disk."""
    import time

    from cartomill.sources.graph_tables import G_FILES, derived_edges

    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return {b for b in blocks.split() if b.startswith("shuffle_")}

    part, lineitem = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("part", "lineitem"))
    files = spark.sql(G_FILES.replace("FROM part", "FROM {part}"), part=part)
    before = shuffles()
    edges = derived_edges(part, lineitem, files)
    labels = G.community_sync(edges, files)
    left = time.time() + 20
    while shuffles() - before and time.time() < left:
        time.sleep(0.2)
    assert not shuffles() - before and labels.columns == ["path", "label"]


def test_derived_edges_are_those_of_their_sql(spark):
    """Also for lines without keys, of one number, with gaps between, and parts listed twice."""
    from cartomill.sources.graph_tables import G_EDGES, G_FILES, derived_edges

    lines = [(1, 1, 1, 3.0, "A", "F"), (1, 2, 2, 4.0, "N", "O"), (1, 2, 3, 5.0, None, "F"), (1, 3, 2, None, "R", None), (2, 1, 1, 1.0, "A", "F"), (2, 3, 2, 1.0, "A", "F"), (None, 1, 1, 1.0, "A", "F"), (None, 2, 2, 1.0, "A", "F"), (3, None, 1, 1.0, "A", "F"), (3, 1, None, 1.0, "A", "F"), (3, 1, 3, 1.0, "A", "F"), (3, 2, 9, 1.0, "A", "F"), (4, 1, 3, 1.0, "N", "F"), (4, 2, 4, 1.0, "N", "F")]
    lineitem = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string")
    parts = [(1, "red bolt", "Brand#1", "SMALL"), (2, "blue ring", "Brand#2", "LARGE"), (3, "hot nut", "Brand#3", "LARGE"), (3, "hot pin", "Brand#3", "SMALL"), (4, None, "Brand#3", None), (None, "x", "y", "z")]
    part = spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").selectExpr("*", "1 AS p_size", "900.0D AS p_retailprice")
    files = spark.sql(G_FILES.replace("FROM part", "FROM {part}"), part=part)
    for name, df in (("part", part), ("lineitem", lineitem), ("g_files", files)):
        df.createOrReplaceTempView(name)
    want = spark.sql(G_EDGES)
    got = derived_edges(part, lineitem, files)
    assert got.dtypes == want.dtypes and want.count() > 10 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for name in ("part", "lineitem", "g_files"):
        spark.catalog.dropTempView(name)
