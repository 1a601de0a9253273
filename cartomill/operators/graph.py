"""Graph operators: construction, ranking, bounded traversal, impact, communities.

Traversals are loops of equi-joins with a fixed bound; each level joins only its frontier, and an anti-join against what
was seen keeps cycles from growing. Iterations cut lineage in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.lineage import Rounds, bucketed, cut, dropped, forgotten, numbered
from ..functions.ship import ship
from ..sources.graph_tables import DATA_EDGES, EDGE_ORDER, STRUCTURAL_EDGES, Graph
from .relational import first_per_key, scoped, undirected

# --- construction and ranking


def file_node(path: Column | str) -> Column:
    return F.concat(F.lit("file://"), path)


def symbol_node(path: Column | str, name: Column | str) -> Column:
    return F.concat(F.lit("symbol://"), path, F.lit("::"), name)


def nodes(g: Graph) -> DataFrame:
    """id, type: files and symbols; symbols of one name in a file are one node."""
    return g.files.select(file_node("path").alias("id"), F.lit("file").alias("type")).union(g.symbols.select(symbol_node("file_path", "name"), F.lit("symbol")).distinct())


def dependency_edges(g: Graph) -> DataFrame:
    """Edges between known files, one for each pair, type and source symbol: the first."""
    own = g.files.select("path")
    known = g.edges.join(own, F.col("source_file") == F.col("path"), "left_semi").join(own, F.col("target_file") == F.col("path"), "left_semi")
    return first_per_key(known, "source_file", "target_file", "edge_type", "source_symbol")


def contains_edges(g: Graph) -> DataFrame:
    """src, dst: from files to their symbols, and from a scope's symbol to what it scopes."""
    own = g.symbols.join(g.files.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    of_file = own.select(file_node("file_path").alias("src"), symbol_node("file_path", "name").alias("dst"))
    parents = own.select("file_path", F.col("name").alias("scope")).distinct()
    of_scope = own.where("scope <> name").join(parents, ["file_path", "scope"]).select(symbol_node("file_path", "scope").alias("src"), symbol_node("file_path", "name").alias("dst"))
    return of_file.union(of_scope).distinct()


def graph_edges(g: Graph) -> DataFrame:
    """src, dst, type, weight of all edges."""
    deps = dependency_edges(g).select(file_node("source_file").alias("src"), file_node("target_file").alias("dst"), F.col("edge_type").alias("type"), "weight")
    return deps.unionByName(contains_edges(g).withColumn("type", F.lit("contains")).withColumn("weight", F.lit(1.0)))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """id, rank: weighted PageRank; what nodes without edges out hold is dealt to all. Stops when the summed change is
    under tol for each node, or after max_iter rounds.

    Nodes get numbers, and links lie in buckets by their source, so a round moves one number a node and one a link. The
    round's change and what it loses are observed while it is written, and the round before is deleted then.
    """
    keys = numbered(nodes.select("id").distinct(), "k", "id")
    n = keys.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    pairs = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    pairs = pairs.join(keys.select(F.col("id").alias("src"), F.col("k").alias("s")), "src").join(keys.select(F.col("id").alias("dst"), F.col("k").alias("d")), "dst").select("s", "d", "w")
    pairs = cut(pairs)
    summed = pairs
    out = pairs.groupBy("s").agg(F.sum("w").alias("total"))
    links = bucketed(pairs.join(out, "s").select("s", "d", (F.col("w") / F.col("total")).alias("share")), "s")
    gives = out.select(F.col("s").alias("k"), F.lit(True).alias("gives"))
    ranks = last = cut(keys.select("k").join(gives, "k", "left").select("k", F.coalesce("gives", F.lit(False)).alias("gives"), F.lit(1.0 / n).alias("rank")))
    dropped(summed)
    lost = ranks.where("NOT gives").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
    for _ in range(max_iter):
        got = links.join(ranks.select(F.col("k").alias("s"), "rank"), "s").groupBy(F.col("d").alias("k")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = ranks.withColumnRenamed("rank", "old").join(got, "k", "left")
        new = new.select("k", "gives", (alpha * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n)) + (1 - alpha) / n).alias("rank"), "old")
        seen = Observation()
        new = new.observe(seen, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change"), F.coalesce(F.sum(F.when(~F.col("gives"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        written = cut(new)
        dropped(last)
        last, ranks = written, written.select("k", "gives", "rank")
        change, lost = seen.get["change"], seen.get["lost"]
        if change < n * tol:
            break
    found = cut(keys.join(ranks, "k").select("id", "rank"))
    dropped(keys, last)
    forgotten(links)
    return found


def ranked_files(g: Graph, ranks: DataFrame) -> DataFrame:
    return g.files.select("path", "language", file_node("path").alias("id")).join(ranks, "id").select("path", "language", F.col("rank").alias("pagerank")).orderBy(F.desc("pagerank"), "path")


def ranked_symbols(g: Graph, ranks: DataFrame) -> DataFrame:
    """A symbol's rank is its file's, and a tenth more for each edge into its node."""
    own = g.symbols.groupBy("file_path", "name").agg(F.max_by(F.struct("kind", "scope", "start_line"), F.struct("start_line", "end_line")).alias("s")).select("file_path", "name", "s.*")
    degree = contains_edges(g).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("d"))
    joined = own.withColumn("id", symbol_node("file_path", "name")).join(degree, "id", "left").drop("id").withColumn("id", file_node("file_path")).join(ranks, "id", "left")
    return joined.select("file_path", "name", "kind", "scope", "start_line", (F.coalesce("rank", F.lit(0.0)) * (1 + 0.1 * F.coalesce("d", F.lit(0)))).alias("pagerank")).orderBy(F.desc("pagerank"), "file_path", "name")


def dependencies(edges: DataFrame, path: str, reverse: bool = False) -> DataFrame:
    own, other = ("target_file", "source_file") if reverse else ("source_file", "target_file")
    return edges.where(F.col(own) == path).select(F.col(other).alias("path"), F.col("edge_type").alias("type")).distinct()


# --- symbol traversal


def keyed_symbols(symbols: DataFrame) -> DataFrame:
    """key, file_path, name, full: what a name or a scoped name stands for."""
    full = F.concat("scope", F.lit("::"), "name")
    own = symbols.select(F.col("name").alias("key"), "file_path", "name", full.alias("full"))
    return own.unionByName(symbols.where("scope IS NOT NULL").select(full.alias("key"), "file_path", "name", full.alias("full")))


def call_edges(symbols: DataFrame, edges: DataFrame, up: bool, of: DataFrame | None = None) -> DataFrame:
    """key with the edges into it (up, imports aside) or out of it; of: only these keys. The keys choose symbols first, and
    these choose edges, so a question about few moves few."""
    file, symbol = ("target_file", "target_symbol") if up else ("source_file", "source_symbol")
    e = edges.where(~F.col("edge_type").isin("import", "require")) if up else edges
    keyed = keyed_symbols(symbols)
    if of is not None:
        keyed = keyed.join(of, "key", "left_semi")
    named = keyed.select("key", F.col("file_path").alias(file), F.explode(F.array_compact(F.array("name", "full"))).alias(symbol))
    return named.join(e, [file, symbol]).select("key", *edges.columns)


def symbol_bfs(symbols: DataFrame, edges: DataFrame, start: str, depth: int, up: bool = True) -> DataFrame:
    """depth, key and edge of everything within `depth` calls. Every edge of an expanded symbol is a row."""
    following = "source_symbol" if up else "target_symbol"
    spark = symbols.sparkSession
    frontier, found, seen = spark.createDataFrame([(start,)], "key string"), None, Rounds(spark, "key string")
    seen.add(frontier)
    for level in range(1, depth + 1):
        rows = cut(call_edges(symbols, edges, up, frontier).withColumn("depth", F.lit(level)))
        found = rows if found is None else found.unionByName(rows)
        if level == depth or not seen.add(rows.select(F.col(following).alias("key")).where("key IS NOT NULL").distinct().join(seen.all(), "key", "left_anti")):
            break
        frontier = seen.last()
    return found


def impact(symbols: DataFrame, edges: DataFrame, start: str, depth: int = 3, in_try: DataFrame | None = None) -> DataFrame:
    """symbol, file, depth, edge_type, risk of what calls a symbol, directly or through others; each caller once.

    in_try (file, line): calls inside a try block, which are LOW, as test files are; edges then need a `line`.
    """
    spark = symbols.sparkSession
    frontier = spark.createDataFrame([(start,)], "key string")
    seen = Rounds(spark, "source_file string, caller string, edge_type string, source_symbol string, guarded boolean, depth int")
    for level in range(1, depth + 1):
        rows = call_edges(symbols, edges, True, frontier).withColumn("caller", F.coalesce("source_symbol", F.lit("<top-level>")))
        if level > 1:
            rows = rows.join(seen.all().select("source_file", "caller"), ["source_file", "caller"], "left_anti")
        first = F.min_by(F.struct("edge_type", "source_symbol", "guarded"), F.struct("key", "edge_type", "target_file", "target_symbol", "weight"))
        guarded = rows.withColumn("guarded", F.lit(False)) if in_try is None else rows.join(in_try.select(F.col("file").alias("source_file"), "line", F.lit(True).alias("guarded")), ["source_file", "line"], "left").na.fill(False, ["guarded"])
        new = seen.add(guarded.groupBy("source_file", "caller").agg(first.alias("e")).select("source_file", "caller", "e.*", F.lit(level).alias("depth")))
        if not new:
            break
        frontier = seen.last().select(F.col("source_symbol").alias("key")).where("key IS NOT NULL").distinct()
    from .predicates import is_test_file

    structural = F.col("edge_type").isin("import", "require", "extends", "implements")
    risk = F.when(is_test_file("source_file") | F.col("guarded"), "LOW").when(F.col("depth") == 1, F.when(structural, "MEDIUM").otherwise("HIGH")).when(F.col("depth") == 2, F.when(structural, "LOW").otherwise("MEDIUM")).otherwise("LOW")
    return seen.all().select(F.col("caller").alias("symbol"), F.col("source_file").alias("file"), "depth", "edge_type", risk.alias("risk"))


def risk_summary(affected: DataFrame) -> DataFrame:
    """Counts of each risk, and what to do."""
    n = affected.agg(*(F.count_if(F.col("risk") == r).alias(r.lower()) for r in ("HIGH", "MEDIUM", "LOW")), F.count("*").alias("n"))
    advice = F.when(F.col("high") > 0, "Treat as BREAKING CHANGE — update all HIGH-risk callers").when(F.col("n") > 0, "Low blast radius — proceed with caution").otherwise("No callers found — safe to change")
    return n.withColumn("recommendation", advice).drop("n")


# --- file traversal


def data_edges(edges: DataFrame, structural: bool = False) -> DataFrame:
    return edges.where(F.col("edge_type").isin(*DATA_EDGES, *(STRUCTURAL_EDGES if structural else ())))


def _ends(edges: DataFrame, has: str, lacks: str) -> DataFrame:
    e = data_edges(edges)
    return e.groupBy(F.col(has).alias("file")).agg(F.count("*").alias("edges")).join(e.select(F.col(lacks).alias("file")).distinct(), "file", "left_anti")


def find_sources(edges: DataFrame) -> DataFrame:
    """Files with data edges out and none in."""
    return _ends(edges, "source_file", "target_file")


def find_sinks(edges: DataFrame) -> DataFrame:
    return _ends(edges, "target_file", "source_file")


def source_label(sources: DataFrame, edges: DataFrame) -> DataFrame:
    routes = edges.where("edge_type = 'route'").groupBy(F.col("source_file").alias("file")).agg(F.count("*").alias("routes"))
    f = F.col("file")
    label = F.when(f.contains("routes/"), F.format_string("[route file — %d controller endpoints]", F.coalesce("routes", F.lit(0)))).when(f.contains("app/Jobs/"), "[dispatched externally — queue worker]").when(f.contains("app/Listeners/"), "[event listener — external trigger]").when(f.contains("app/Http/Middleware/"), "[middleware — filter chain entry]").otherwise("")
    return sources.join(routes, "file", "left").select("file", label.alias("label"))


def sink_label(sinks: DataFrame) -> DataFrame:
    """sinks: file and edges, the number of data edges in. Of several words the first counts."""
    f, n = F.col("file"), F.col("edges")
    label = F.lit("[terminal — no outgoing data edges]")
    for words, text in reversed(((("QueueManager", "queue"), "[Queue::push — %d in-edges]"), (("Mailer", "mail"), "[Mail facade → SMTP — %d in-edges]"), (("CacheManager", "cache"), "[Cache facade → Redis/Memcache — %d in-edges]"), (("DatabaseManager", "database"), "[DB facade → raw SQL — %d in-edges]"))):
        label = F.when(f.contains(words[0]) | f.contains(words[1]), F.format_string(text, n)).otherwise(label)
    return sinks.select("file", label.alias("label"))


def distances(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """path, depth within so many undirected steps of the seeds (path)."""
    u = undirected(edges)
    return _levels(u.select(F.col("a").alias("file"), F.col("b").alias("to")).union(u.select("b", "a")), seeds.select(F.col("path").alias("file")).distinct(), depth).select(F.col("file").alias("path"), "depth")


def _levels(steps: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """file, depth of what so many steps (file, to) reach from the seeds (file)."""
    seen = Rounds(steps.sparkSession, "file string")
    seen.add(seeds)
    for _ in range(depth):
        if not seen.add(steps.join(seen.last(), "file", "left_semi").select(F.col("to").alias("file")).distinct().join(seen.all(), "file", "left_anti")):
            break
    return seen.all().select("file", F.col("round").alias("depth"))


def focus_neighborhood(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """source_file, target_file of the edges among the nodes within so many steps."""
    own = cut(distances(edges, seeds, depth).select("path"))
    pairs = edges.select("source_file", "target_file").distinct()
    return pairs.join(own, F.col("source_file") == F.col("path"), "left_semi").join(own, F.col("target_file") == F.col("path"), "left_semi")


def data_steps(edges: DataFrame) -> DataFrame:
    """a, b: different files that a data edge links."""
    return data_edges(edges).select(F.col("source_file").alias("a"), F.col("target_file").alias("b")).where("a <> b")


def followed(starts: DataFrame, pointers: DataFrame) -> DataFrame:
    """key, node, place of all nodes on the way from each start (key, node) along the pointers (node, next). Jumps double,
    so a way of n nodes takes log n joins."""
    way, jump, size = cut(starts.select("key", "node", F.lit(0).alias("place"))), cut(pointers.select("node", "next")), 1
    while True:
        more = cut(way.join(jump, "node").select("key", F.col("next").alias("node"), (F.col("place") + size).alias("place")))
        if more.isEmpty():
            return way
        longer, size = cut(way.unionByName(more)), 2 * size
        further = cut(jump.select("node", F.col("next").alias("via")).join(jump.select(F.col("node").alias("via"), "next"), "via").select("node", "next"))
        dropped(way, more, jump)
        way, jump = longer, further


def written_ways(ways: DataFrame) -> DataFrame:
    """key, path (array) of key, node, place."""
    return ways.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("path"))


def critical_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """path (array), length: a shortest path over data edges, of any length; of equals, the one whose files sort first.

    The search goes from both ends, from the side whose last round found less, until they meet or one side is exhausted.
    The goal's side keeps for each file the least next one; from where they meet, pointers are continued through the files
    that the start's side found, so a file has one row, however many ways lead through it.
    """
    steps, spark = data_steps(edges), edges.sparkSession
    ahead, back = Rounds(spark, "node string"), Rounds(spark, "node string, next string")
    sizes = [ahead.add(spark.createDataFrame([(start,)], "node string")), back.add(spark.createDataFrame([(goal, None)], "node string, next string"))]
    while (met := ahead.last().join(back.last().select("node"), "node", "left_semi")).isEmpty():
        if sizes[0] <= sizes[1]:
            sizes[0] = ahead.add(steps.join(ahead.last().select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct().join(ahead.all(), "node", "left_anti"))
        else:
            near = steps.join(back.last().select(F.col("node").alias("b")), "b", "left_semi").groupBy(F.col("a").alias("node")).agg(F.min("b").alias("next"))
            sizes[1] = back.add(near.join(back.all().select("node"), "node", "left_anti"))
        if not min(sizes):
            return back.of(0).where("false").select(F.array("node").alias("path"), F.lit(0).alias("length"))
    rest, own = Rounds(spark, "node string, next string"), met
    for k in range(ahead.n - 2, -1, -1):
        near = steps.join(own.select(F.col("node").alias("b")), "b", "left_semi").join(ahead.of(k).select(F.col("node").alias("a")), "a", "left_semi")
        rest.add(near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("next")))
        own = rest.last()
    pointers = back.all().select("node", "next").where("next IS NOT NULL")
    if rest.n:
        pointers = pointers.unionByName(rest.all().select("node", "next"))
    way = followed(spark.createDataFrame([(0, start)], "key int, node string"), pointers)
    return written_ways(way).select("path", F.size("path").alias("length"))


def trace_bfs(edges: DataFrame, start: str, depth: int = 3, up: bool = False, structural: bool = False) -> DataFrame:
    """file, depth of what data reaches from a file, or reaches it."""
    own, other = ("target_file", "source_file") if up else ("source_file", "target_file")
    steps = data_edges(edges, structural).select(F.col(own).alias("file"), F.col(other).alias("to"))
    return _levels(steps, edges.sparkSession.createDataFrame([(start,)], "file string"), depth)


def cyclic_components(edges: DataFrame) -> DataFrame:
    """file, component: the files that lie on cycles of data edges, each with the least file that it reaches and that
    reaches it.

    Files without a way in or out go, until none does. The least file that reaches it is passed forward to each file;
    from a file that got its own, a search backward among files that got the same one finds its component. What
    is left goes through the same again.
    """
    steps, found = cut(data_steps(edges).distinct()), []
    empty = steps.where("false").select(F.col("a").alias("file"), F.col("b").alias("component"))
    while True:
        before, n = None, steps.count()
        while n and n != before:
            both = steps.join(steps.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(steps.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
            less = cut(both.select("a", "b"))
            dropped(steps)
            steps, before, n = less, n, less.count()
        if not n:
            break
        labels = cut(steps.select(F.col("a").alias("file")).union(steps.select("b")).distinct().select("file", F.col("file").alias("label"), F.lit(True).alias("new")))
        while not labels.where("new").isEmpty():
            offers = steps.join(labels.where("new").select(F.col("file").alias("a"), "label"), "a").groupBy(F.col("b").alias("file")).agg(F.min("label").alias("offer"))
            better = F.coalesce(F.col("offer") < F.col("label"), F.lit(False))
            passed = cut(labels.join(offers, "file", "left").select("file", F.when(better, F.col("offer")).otherwise(F.col("label")).alias("label"), better.alias("new")))
            dropped(labels)
            labels = passed
        inner = steps.join(labels.select(F.col("file").alias("a"), "label"), "a").join(labels.select(F.col("file").alias("b"), F.col("label").alias("other")), "b").where("label = other").select("a", "b", "label")
        inner = cut(inner)
        back = Rounds(edges.sparkSession, "file string, component string")
        n = back.add(labels.where("file = label").select("file", F.col("label").alias("component")))
        while n:
            near = inner.join(back.last().select(F.col("file").alias("b"), "component"), "b").where("label = component").select(F.col("a").alias("file"), "component").distinct()
            n = back.add(near.join(back.all().select("file"), "file", "left_anti"))
        done = back.all().select("file", "component")
        found.append(done)
        gone = done.select("file")
        rest = cut(steps.join(gone.select(F.col("file").alias("a")), "a", "left_anti").join(gone.select(F.col("file").alias("b")), "b", "left_anti").select("a", "b"))
        dropped(steps, inner, labels)
        steps = rest
    out = empty
    for f in found:
        out = out.unionByName(f)
    several = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return out.join(several.select("component"), "component", "left_semi").select("file", "component")


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """component, path, length: of each component that cyclic_components() finds, a shortest cycle of any length through
    its least file, from that file; of equals, the one whose files sort first.

    All components are searched at once, backward from their least files, with pointers as in critical_path().
    """
    own, spark = cut(cyclic_components(edges)), edges.sparkSession
    steps = data_steps(edges).distinct().join(own.select(F.col("file").alias("a"), "component"), "a").join(own.select(F.col("file").alias("b"), F.col("component").alias("other")), "b").where("component = other").select("component", "a", "b")
    steps = cut(steps)
    back, closed = Rounds(spark, "component string, node string, next string"), Rounds(spark, "key string, node string")
    n = back.add(own.where("file = component").select("component", F.col("file").alias("node"), F.lit(None).cast("string").alias("next")))
    closed.add(own.where("false").select(F.col("component").alias("key"), F.col("file").alias("node")))
    while n:
        open_ = steps.join(closed.all().select(F.col("key").alias("component")), "component", "left_anti")
        near = open_.join(back.last().select(F.col("node").alias("b")), "b", "left_semi").groupBy("component", F.col("a").alias("node")).agg(F.min("b").alias("next"))
        n = back.add(near.join(back.all().select("node"), "node", "left_anti"))
        closed.add(open_.where("a = component").join(back.last().select(F.col("node").alias("b")), "b", "left_semi").groupBy(F.col("component").alias("key")).agg(F.min("b").alias("node")))
    ways = written_ways(followed(closed.all(), back.all().where("next IS NOT NULL")))
    # a way ends in the file that the cycle begins with
    return ways.select(F.col("key").alias("component"), F.concat(F.array("key"), F.slice("path", 1, F.size("path") - 1)).alias("path"), F.size("path").alias("length"))


def cycles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """path, length of each simple cycle, of at most `most` files if it is given, from its least file. Their number can
    grow with the power of a component's size; shortest_cycles() has one of each component."""
    own = cut(cyclic_components(edges))
    steps = cut(data_steps(edges).distinct().join(own.select(F.col("file").alias("a")), "a", "left_semi").join(own.select(F.col("file").alias("b")), "b", "left_semi").select("a", "b"))
    walk, found, n = steps.where("a < b").select(F.array("a", "b").alias("path")), None, 2
    while True:
        ends = walk.join(steps, F.element_at("path", -1) == F.col("a"))
        closed = cut(ends.where(F.col("b") == F.col("path")[0]).select("path", F.lit(n).alias("length")))
        found = closed if found is None else found.unionByName(closed)
        if n == most:
            return found
        walk = cut(ends.where(F.col("b") > F.col("path")[0]).where(~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path")))
        n += 1
        if walk.isEmpty():
            return found


TRACES = "file string, symbol string, paths array<array<struct<file:string,symbol:string>>>, cycles array<struct<from:string,to:string,type:string,length:int>>, nodes int, edges int, max_depth_reached boolean"


def traces(g: Graph, starts: DataFrame, depth: int = 3, up: bool = False, structural: bool = False) -> DataFrame:
    """TRACES of each start (file, symbol): paths, cycles and sizes by depth-first search, each node visited once.

    What all starts reach within the depth is found together, a level a round; then the edges around each start meet it in one
    group, where the order of the search decides. A group is the neighbourhood of one start, and nothing else is collected.
    """
    ship(g.edges.sparkSession)
    side, other = ("target", "source") if up else ("source", "target")
    rows = data_edges(g.edges, structural)
    if not up:
        from .relational import scoped_name

        rows = scoped_name(rows, g.symbols)
    edges = rows.select(
        F.col(f"{side}_file").alias("file"), F.col(f"{side}_symbol").alias("symbol"), F.col(f"{other}_file").alias("to_file"), F.col("source_symbol" if up else "scoped").alias("to_symbol"), "edge_type",
        F.array(*(F.col(c).cast("string") for c in EDGE_ORDER)).alias("order"),
    )
    steps = edges.select("file", F.col("to_file").alias("to"))
    own = starts.select("file").distinct()
    near = Rounds(g.edges.sparkSession, "start string, file string")
    near.add(own.select(F.col("file").alias("start"), "file"))
    for _ in range(depth):
        if not near.add(steps.join(near.last(), "file").select("start", F.col("to").alias("file")).distinct().join(near.all(), ["start", "file"], "left_anti")):
            break
    around = near.all().select("start", "file").join(edges, "file").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("order", "file", "symbol", "to_file", "to_symbol", "edge_type"))).alias("around"))
    asked = starts.select("file", "symbol").join(around, F.col("file") == F.col("start"), "left").select("file", "symbol", "around")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from cartomill.functions.tracing import EDGE, searched

        for frame in frames:
            out = []
            for file, symbol, near in frame.itertuples(index=False):
                found = searched(file, symbol, [tuple(e[c] for c in EDGE) for e in (near if near is not None else ())], depth)
                found["paths"] = [[{"file": f, "symbol": s} for f, s in p] for p in found["paths"]]
                out.append((file, symbol, *found.values()))
            yield pd.DataFrame(out, columns=["file", "symbol", "paths", "cycles", "nodes", "edges", "max_depth_reached"])

    return asked.mapInPandas(search, TRACES)


def trace(g: Graph, start: str, symbol: str | None = None, depth: int = 3, up: bool = False, structural: bool = False) -> dict:
    """traces() of one start."""
    starts = g.edges.sparkSession.createDataFrame([(start, symbol)], "file string, symbol string")
    r = traces(g, starts, depth, up, structural).first().asDict(recursive=True)
    return {"paths": [[(n["file"], n["symbol"]) for n in p] for p in r["paths"]], "cycles": r["cycles"], "nodes": r["nodes"], "edges": r["edges"], "max_depth_reached": r["max_depth_reached"]}


# --- communities


def community_sync(edges: DataFrame, files: DataFrame, rounds: int = 5) -> DataFrame:
    """path, label by label propagation in which all files change at once: what scales. Its result differs from that of
    community_exact(), where each change is seen by the next file.

    Files are their places among the sorted paths, so the least number is the least path, and links lie in buckets by the
    file that votes: a round moves one number a file, and three numbers a link to the file that is voted on, once. The shuffles
    of each step are deleted with it. A path that files lists n times votes n times.
    """
    paths = numbered(files.where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("n")), "k", "path")
    keys = paths.withColumn("k", F.col("k").cast("int"))
    known = lambda c, k: keys.select(F.col("path").alias(c), F.col("k").alias(k))
    e = edges.where("source_file <> target_file").select("source_file", "target_file")
    half = cut(e.join(known("source_file", "a"), "source_file").drop("source_file"))
    pairs = cut(half.join(known("target_file", "b"), "target_file").drop("target_file"))
    dropped(half)
    once = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("w"))
    links = bucketed(once.select(F.explode(F.array("a", "b")).alias("by"), (F.col("a") + F.col("b") - F.col("by")).alias("k"), "w"), "by")
    dropped(pairs)
    labels = cut(keys.select("k", F.col("k").alias("label"), "n"))
    for _ in range(rounds):
        votes = links.join(labels.select(F.col("k").alias("by"), "label", "n"), "by").select("k", "label", (F.col("w") * F.col("n")).alias("w")).repartition("k")
        best = votes.groupBy("k", "label").agg(F.sum("w").alias("w")).groupBy("k").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("new"))
        new = cut(labels.join(best, "k", "left").select("k", F.coalesce("new", "label").alias("label"), "n"))
        dropped(labels)
        labels = new
    forgotten(links)
    named = labels.join(keys.select(F.col("k").alias("label"), F.col("path").alias("name")), "label").join(keys.select("k", "path"), "k")
    found = cut(files.select("path").join(named.select("path", "name"), "path", "left").select("path", F.col("name").alias("label")))
    dropped(labels, paths)
    return found


def connected(links: DataFrame, *key: str) -> DataFrame:
    """key, node, component: the least node that links (key, a, b) connect each node with. Each round takes the least label
    around a node, then the label of that label, so rounds grow with the logarithm of a component's width."""
    both = cut(links.select(*key, "a", "b").union(links.select(*key, "b", "a")).distinct())
    labels = cut(both.groupBy(*key, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        around = both.join(labels.select(*key, F.col("node").alias("b"), F.col("component").alias("near")), [*key, "b"]).groupBy(*key, F.col("a").alias("node")).agg(F.min("near").alias("near"))
        least = cut(labels.join(around, [*key, "node"]).select(*key, "node", "component", F.least("component", "near").alias("near")))
        jump = least.select(*key, F.col("node").alias("near"), F.col("near").alias("further"))
        new = cut(least.join(jump, [*key, "near"]).select(*key, "node", F.least("near", "further").alias("label"), (F.least("near", "further") != F.col("component")).alias("moved")))
        done = new.where("moved").isEmpty()
        dropped(labels, least)
        labels = new.select(*key, "node", F.col("label").alias("component"))
        labels.written_at = new.written_at
        if done:
            return labels


#: Files of components that one task takes together; a larger component is a task of its own.
PACK_FILES = 20_000


def community_exact(edges: DataFrame, files: DataFrame, rounds: int = 10) -> DataFrame:
    """repo, path, label by sequential label propagation in a fixed shuffled order of each repository's files.

    Labels never leave a connected component, so each component is propagated by itself, in the order that its files have
    among all of the repository. That order depends on the number of files alone; a task draws it. Small components are packed
    to tasks together; the largest task is the largest component. Files are their places among the sorted paths of their
    repository, so what tasks hold are numbers, and the least number is the least path.
    """
    spark = edges.sparkSession
    ship(spark)
    paths = files.select("repo", "path").distinct().withColumn("i", F.row_number().over(Window.partitionBy("repo").orderBy("path")) - 1)
    own = cut(paths.join(numbered(files.select("repo").distinct(), "r", "repo"), "repo"))
    known = lambda c, i: own.select("repo", F.col("path").alias(c), "r", F.col("i").alias(i))
    e = edges.where("source_file <> target_file").groupBy("repo", "source_file", "target_file").agg(F.count("*").alias("w"))
    e = cut(e.join(known("source_file", "a"), ["repo", "source_file"]).drop("r").join(known("target_file", "b"), ["repo", "target_file"]).select("r", "a", "b", "w"))
    parts = connected(e.select("r", "a", "b"), "r")
    steps = [f"p{k}" for k in range(rounds)]

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from cartomill.functions.communities import drawn as one_round

        for frame in frames:
            for r, n in frame.itertuples(index=False):
                orders = [one_round(n, k) for k in range(rounds)]
                for a in range(0, n, 50_000):
                    yield pd.DataFrame({"r": r, "i": range(a, min(n, a + 50_000))} | {c: o[a : a + 50_000] for c, o in zip(steps, orders)})

    order = own.groupBy("r").agg(F.count("*").alias("n")).repartition("r").mapInPandas(drawn, "r long, i int, " + ", ".join(f"{c} int" for c in steps))
    sizes = parts.groupBy("r", "component").agg(F.count("*").alias("size"))
    small = F.col("size") <= PACK_FILES // 10
    many = sizes.groupBy("r").agg(F.ceil(F.sum(F.when(small, F.col("size")).otherwise(0)) / PACK_FILES).alias("packs"))
    number = F.pmod(F.xxhash64("component"), F.greatest("packs", F.lit(1)))
    packs = sizes.join(many, "r").select("r", "component", F.when(small, -1 - number).otherwise(F.col("component")).alias("pack"))
    placed = cut(own.select("r", "i").join(order, ["r", "i"]).join(parts.withColumnRenamed("node", "i"), ["r", "i"]).join(packs, ["r", "component"]).select("r", "i", "pack", *steps))
    links = e.join(placed.select("r", F.col("i").alias("a"), "pack"), ["r", "a"]).select(F.col("r").alias("link_r"), F.col("pack").alias("link_pack"), "a", "b", "w")

    def one(nodes: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        from cartomill.functions.communities import labelled

        if not len(nodes):
            return pd.DataFrame({"r": [], "i": [], "label": []})
        nodes = nodes.sort_values("i")
        i = nodes["i"].to_numpy()
        label = labelled([nodes[c].to_numpy() for c in steps], i.searchsorted(near["a"].to_numpy()), i.searchsorted(near["b"].to_numpy()), near["w"].to_numpy())
        return pd.DataFrame({"r": nodes["r"].to_numpy(), "i": i, "label": i[label]})

    found = placed.groupBy("r", "pack").cogroup(links.groupBy("link_r", "link_pack")).applyInPandas(one, "r long, i int, label int")
    named = own.join(found, ["r", "i"], "left").select("r", "repo", "path", F.coalesce("label", "i").alias("label"))
    return named.join(own.select("r", F.col("i").alias("label"), F.col("path").alias("name")), ["r", "label"]).select("repo", "path", F.col("name").alias("label"))


def numbered_communities(labels: DataFrame, existing: DataFrame, least: int = 3) -> DataFrame:
    """cluster_name, file_path of communities (path, label) of three files or more that equal no existing cluster."""
    from .relational import same_set_drop

    big = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    own = labels.join(big.select("label"), "label", "left_semi").select(F.col("label").alias("cluster_name"), F.col("path").alias("file_path"))
    left = same_set_drop(own, existing)
    number = numbered(left.select("cluster_name").distinct(), "k", "cluster_name").withColumn("k", F.col("k") + 1)
    return left.join(number, "cluster_name").select(F.concat(F.lit("community_"), F.col("k").cast("string")).alias("cluster_name"), "file_path")
