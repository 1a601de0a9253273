"""Queries of the graph operators on the derived graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import relational as R
from ..registry import graph_query as q
from ..sources.graph_tables import EDGE_ORDER, Graph
from .relational_queries import EDGE_COLUMNS, FIRST_FILE, first_path

_ORDERED = ", ".join(EDGE_ORDER)
NODES = """WITH nodes AS (SELECT 'file://' || path AS id FROM g_files UNION SELECT 'symbol://' || file_path || '::' || name FROM g_symbols),
deps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file, target_file, edge_type, source_symbol ORDER BY %s) AS r FROM g_edges) WHERE r = 1),
inside AS (SELECT 'file://' || file_path AS src, 'symbol://' || file_path || '::' || name AS dst FROM g_symbols
 UNION SELECT 'symbol://' || s.file_path || '::' || s.scope, 'symbol://' || s.file_path || '::' || s.name FROM g_symbols s JOIN g_symbols p ON p.file_path = s.file_path AND p.name = s.scope WHERE s.scope <> s.name),
links AS (SELECT 'file://' || source_file AS src, 'file://' || target_file AS dst, edge_type AS type, weight FROM deps UNION ALL SELECT src, dst, 'contains', 1.0 FROM inside)""" % _ORDERED
#: More rounds than any table here takes; the ranks are those of the first round whose change is under the bound.
ROUNDS = 50
RANK = NODES + """, pairs AS MATERIALIZED (SELECT src, dst, sum(weight) AS w FROM links GROUP BY ALL), outs AS MATERIALIZED (SELECT src, sum(w) AS total FROM pairs GROUP BY src), n AS MATERIALIZED (SELECT count(*) AS n FROM nodes),
r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank, 1.0::DOUBLE AS change, id NOT IN (SELECT src FROM outs) AS ends FROM nodes, n)""" + "".join(
    f""", g{k} AS (SELECT dst AS id, sum(w / total * rank) AS got FROM pairs JOIN outs USING (src) JOIN r{k - 1} ON id = src GROUP BY dst),
r{k} AS MATERIALIZED (SELECT id, new AS rank, sum(abs(new - old)) OVER () AS change, ends FROM (SELECT p.id, p.ends, p.rank AS old, 0.85 * (coalesce(got, 0) + lost / n) + 0.15 / n AS new FROM r{k - 1} p LEFT JOIN g{k} ON g{k}.id = p.id, (SELECT coalesce(sum(rank) FILTER (ends), 0) AS lost FROM r{k - 1}), n))"""
    for k in range(1, ROUNDS + 1)
) + ", changes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS k, any_value(change) AS change FROM r{k}" for k in range(1, ROUNDS + 1)) + "), last AS (SELECT min(k) AS k FROM changes, n WHERE change < n * 1e-6), ranks AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT id, rank FROM r{k} WHERE (SELECT k FROM last) = {k}" for k in range(1, ROUNDS + 1)) + ")"


def _ranks(g: Graph) -> DataFrame:
    """Computed once for each graph."""
    if "ranks" not in g.kept:
        g.kept["ranks"] = G.pagerank(G.nodes(g), G.graph_edges(g))
    return g.kept["ranks"]


q("build_graph", NODES + " SELECT src, dst, type, weight FROM links", lambda g: G.graph_edges(g))
q("load_graph", NODES + " SELECT id FROM nodes", lambda g: G.nodes(g).select("id"))
q("graph_counts", NODES + " SELECT (SELECT count(*) FROM nodes WHERE id LIKE 'file:%') AS files, (SELECT count(*) FROM nodes WHERE id LIKE 'symbol:%') AS symbols, (SELECT count(*) FROM deps) AS edges", lambda g: G.nodes(g).agg(F.count_if(F.col("type") == "file").alias("files"), F.count_if(F.col("type") == "symbol").alias("symbols")).crossJoin(G.dependency_edges(g).agg(F.count("*").alias("edges"))))
q("graph_json", NODES + """ SELECT '{"id":' || to_json(id) || ',"type":"' || CASE WHEN id LIKE 'file:%' THEN 'file' ELSE 'symbol' END || '"}' AS json FROM nodes UNION ALL SELECT '{"src":' || to_json(src) || ',"dst":' || to_json(dst) || ',"type":"' || type || '","weight":' || CAST(weight AS DOUBLE) || '}' FROM links""", lambda g: G.nodes(g).select(F.to_json(F.struct("id", "type")).alias("json")).union(G.graph_edges(g).select(F.to_json(F.struct("src", "dst", "type", "weight")))))
q("pagerank", RANK + f" SELECT id, round(rank, 12) AS rank FROM ranks", lambda g: _ranks(g).select("id", F.round("rank", 12).alias("rank")))
q("ranked_files", RANK + f" SELECT path, language, round(rank, 12) AS pagerank FROM g_files JOIN ranks ON id = 'file://' || path", lambda g: G.ranked_files(g, _ranks(g)).withColumn("pagerank", F.round("pagerank", 12)))
q("top_files", RANK + f" SELECT path, round(rank, 12) AS pagerank FROM g_files JOIN ranks ON id = 'file://' || path ORDER BY rank DESC, path LIMIT 10", lambda g: R.top(G.ranked_files(g, _ranks(g)), 10, F.desc("pagerank"), "path").select("path", F.round("pagerank", 12).alias("pagerank")))
_SYMBOL_RANK = RANK + f", deg AS (SELECT dst, count(*) AS d FROM inside GROUP BY dst) SELECT DISTINCT s.file_path, s.name, round(rank * (1 + 0.1 * coalesce(d, 0)), 12) AS pagerank FROM g_symbols s JOIN ranks ON id = 'file://' || s.file_path LEFT JOIN deg ON dst = 'symbol://' || s.file_path || '::' || s.name"
q("ranked_symbols", _SYMBOL_RANK, lambda g: G.ranked_symbols(g, _ranks(g)).select("file_path", "name", F.round("pagerank", 12).alias("pagerank")))
q("top_symbols", f"{_SYMBOL_RANK} ORDER BY pagerank DESC, file_path, name LIMIT 5", lambda g: R.top(G.ranked_symbols(g, _ranks(g)).select("file_path", "name", F.round("pagerank", 12).alias("pagerank")), 5, F.desc("pagerank"), "file_path", "name"))
q("symbol_rank_enrich", RANK + f", deg AS (SELECT dst, count(*) AS d FROM inside GROUP BY dst) SELECT DISTINCT s.file_path, s.name, s.start_line, round(rank * (1 + 0.1 * coalesce(d, 0)), 12) AS pagerank FROM g_symbols s JOIN ranks ON id = 'file://' || s.file_path LEFT JOIN deg ON dst = 'symbol://' || s.file_path || '::' || s.name WHERE lower(s.name) LIKE 'red%'", lambda g: R.symbol_query(g.symbols, "RED*").select("file_path", "name", "start_line").join(G.ranked_symbols(g, _ranks(g)).select("file_path", "name", "pagerank"), ["file_path", "name"], "left").select("file_path", "name", "start_line", F.round(F.coalesce("pagerank", F.lit(0.0)), 12).alias("pagerank")).distinct())
q("dependencies", f"SELECT DISTINCT target_file AS path, edge_type AS type FROM g_edges WHERE source_file = {FIRST_FILE}", lambda g: G.dependencies(G.dependency_edges(g), first_path(g)))
q("reverse_dependencies", f"SELECT DISTINCT source_file AS path, edge_type AS type FROM g_edges WHERE target_file = {FIRST_FILE}", lambda g: G.dependencies(G.dependency_edges(g), first_path(g), reverse=True))

KEYED = "WITH keyed AS (SELECT name AS key, file_path, name, scope || '::' || name AS full_ FROM g_symbols UNION ALL SELECT scope || '::' || name, file_path, name, scope || '::' || name FROM g_symbols WHERE scope IS NOT NULL)"
_UP = "up AS (SELECT k.key, e.* FROM keyed k JOIN g_edges e ON e.target_file = k.file_path AND (e.target_symbol = k.name OR e.target_symbol = k.full_) WHERE e.edge_type NOT IN ('import', 'require'))"
_DOWN = "up AS (SELECT k.key, e.* FROM keyed k JOIN g_edges e ON e.source_file = k.file_path AND (e.source_symbol = k.name OR e.source_symbol = k.full_))"


def _bfs_sql(calls: str, start: str, follow: str) -> str:
    return f"{KEYED}, {calls}, a AS (SELECT *, 1 AS depth FROM up WHERE key = '{start}'), f AS (SELECT DISTINCT {follow} AS key FROM a WHERE {follow} IS NOT NULL AND {follow} <> '{start}') SELECT depth, key, {EDGE_COLUMNS} FROM a UNION ALL SELECT 2, key, {EDGE_COLUMNS} FROM up WHERE key IN (SELECT key FROM f)"


q("callers_bfs", _bfs_sql(_UP, "redwidget::onAO", "source_symbol"), lambda g: G.symbol_bfs(g.symbols, g.edges, "redwidget::onAO", 2))
q("callees_bfs", _bfs_sql(_DOWN, "redwidget::onAF", "target_symbol"), lambda g: G.symbol_bfs(g.symbols, g.edges, "redwidget::onAF", 2, up=False))
_IMPACT = f"""{KEYED}, {_UP}, a AS (SELECT *, row_number() OVER (PARTITION BY source_file, source_symbol ORDER BY key, edge_type, target_file, target_symbol, weight) AS r FROM up WHERE key = 'redwidget::onAO'), a1 AS (SELECT * FROM a WHERE r = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY source_file, source_symbol ORDER BY key, edge_type, target_file, target_symbol, weight) AS r FROM up WHERE key IN (SELECT source_symbol FROM a1) AND (source_file, source_symbol) NOT IN (SELECT source_file, source_symbol FROM a1)),
affected AS (SELECT source_symbol AS symbol, source_file AS file, 1 AS depth, edge_type, CASE WHEN edge_type = 'extends' THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM a1 UNION ALL SELECT source_symbol, source_file, 2, edge_type, CASE WHEN edge_type = 'extends' THEN 'LOW' ELSE 'MEDIUM' END FROM b WHERE r = 1)"""
q("impact", f"{_IMPACT} SELECT * FROM affected", lambda g: G.impact(g.symbols, g.edges, "redwidget::onAO", 2))
q("risk_summary", f"{_IMPACT} SELECT count(*) FILTER (risk = 'HIGH') AS high, count(*) FILTER (risk = 'MEDIUM') AS medium, count(*) FILTER (risk = 'LOW') AS low, CASE WHEN count(*) FILTER (risk = 'HIGH') > 0 THEN 'Treat as BREAKING CHANGE — update all HIGH-risk callers' WHEN count(*) > 0 THEN 'Low blast radius — proceed with caution' ELSE 'No callers found — safe to change' END AS recommendation FROM affected", lambda g: G.risk_summary(G.impact(g.symbols, g.edges, "redwidget::onAO", 2)))

_CALLS = "(SELECT * FROM g_edges WHERE edge_type = 'call')"
q("find_sources", f"SELECT source_file AS file, count(*) AS edges FROM {_CALLS} WHERE source_file NOT IN (SELECT target_file FROM {_CALLS}) GROUP BY source_file", lambda g: G.find_sources(g.edges))
q("find_sinks", f"SELECT target_file AS file, count(*) AS edges FROM {_CALLS} WHERE target_file NOT IN (SELECT source_file FROM {_CALLS}) GROUP BY target_file", lambda g: G.find_sinks(g.edges))
q("edges_for_node", f"SELECT {EDGE_COLUMNS} FROM g_edges WHERE source_file = {FIRST_FILE} AND edge_type IN ('call', 'import', 'extends') AND repo = 'repo_0'", lambda g: R.of_repo(G.data_edges(g.edges, structural=True), "repo_0").where(F.col("source_file") == first_path(g)))

_BOTH = "both_ AS (SELECT source_file AS a, target_file AS b FROM g_edges WHERE source_file <> target_file UNION SELECT target_file, source_file FROM g_edges WHERE source_file <> target_file)"
_NEAR = f"WITH {_BOTH}, d0 AS (SELECT {FIRST_FILE} AS path), d1 AS (SELECT DISTINCT b AS path FROM both_ JOIN d0 ON a = path WHERE b NOT IN (SELECT path FROM d0)), d2 AS (SELECT DISTINCT b AS path FROM both_ JOIN d1 ON a = path WHERE b NOT IN (SELECT path FROM d0) AND b NOT IN (SELECT path FROM d1)), near AS (SELECT path, 0 AS depth FROM d0 UNION ALL SELECT path, 1 FROM d1 UNION ALL SELECT path, 2 FROM d2)"


def _seed(g: Graph) -> DataFrame:
    return g.files.agg(F.min("path").alias("path"))


q("context_distance", f"{_NEAR} SELECT path, depth FROM near", lambda g: G.distances(g.edges, _seed(g)))
q("focus_neighborhood", f"{_NEAR} SELECT DISTINCT source_file, target_file FROM g_edges WHERE source_file IN (SELECT path FROM near WHERE depth < 2) AND target_file IN (SELECT path FROM near WHERE depth < 2)", lambda g: G.focus_neighborhood(g.edges, _seed(g), 1))
_STEP = "(SELECT DISTINCT source_file AS a, target_file AS b FROM g_edges WHERE edge_type = 'call')"


def _trace_sql(up: bool) -> str:
    a, b = ("b", "a") if up else ("a", "b")
    return f"WITH s AS {_STEP}, t0 AS (SELECT min({a}) AS file FROM s), t1 AS (SELECT DISTINCT {b} AS file FROM s JOIN t0 ON {a} = file WHERE {b} NOT IN (SELECT file FROM t0)), t2 AS (SELECT DISTINCT {b} AS file FROM s JOIN t1 ON {a} = file WHERE {b} NOT IN (SELECT file FROM t0) AND {b} NOT IN (SELECT file FROM t1)) SELECT file, 0 AS depth FROM t0 UNION ALL SELECT file, 1 FROM t1 UNION ALL SELECT file, 2 FROM t2"


def _first(g: Graph, column: str) -> str:
    return g.edges.where("edge_type = 'call'").agg(F.min(column)).first()[0]


q("trace_down", _trace_sql(False), lambda g: G.trace_bfs(g.edges, _first(g, "source_file"), 2))
q("trace_up", _trace_sql(True), lambda g: G.trace_bfs(g.edges, _first(g, "target_file"), 2, up=True))
q("trace_both", f"SELECT file, min(depth) AS depth FROM (SELECT * FROM ({_trace_sql(False)}) UNION ALL SELECT * FROM ({_trace_sql(True).replace('min(b)', 'min(a)')})) GROUP BY file", lambda g: (lambda s: G.trace_bfs(g.edges, s, 2).unionByName(G.trace_bfs(g.edges, s, 2, up=True)).groupBy("file").agg(F.min("depth").alias("depth")))(_first(g, "source_file")))
q("union_trace", f"SELECT count(DISTINCT file) AS files FROM (SELECT * FROM ({_trace_sql(False)}) UNION ALL SELECT * FROM ({_trace_sql(True).replace('min(b)', 'min(a)')}))", lambda g: (lambda s: G.trace_bfs(g.edges, s, 2).unionByName(G.trace_bfs(g.edges, s, 2, up=True)).agg(F.countDistinct("file").alias("files")))(_first(g, "source_file")))
def _traces(g: Graph, up: bool) -> DataFrame:
    """Of all files that data leaves or reaches, one row each."""
    column = "target_file" if up else "source_file"
    starts = g.edges.where("edge_type = 'call'").select(F.col(column).alias("file"), F.lit(None).cast("string").alias("symbol")).distinct()
    return G.traces(g, starts, 1, up)


def _traces_sql(up: bool) -> str:
    """One step deep, a trace has a path for each different node around the start but itself; an edge to itself is a cycle."""
    own, other = ("target", "source") if up else ("source", "target")
    to = "source_symbol" if up else "CASE WHEN t.scope IS NOT NULL THEN t.scope || '::' || target_symbol ELSE target_symbol END"
    joined = "" if up else " LEFT JOIN (SELECT file_path, name, min(scope) AS scope FROM g_symbols GROUP BY ALL) t ON t.file_path = e.target_file AND t.name = e.target_symbol"
    return f"WITH c AS (SELECT {own}_file AS file, {other}_file AS to_file, {to} AS to_symbol FROM g_edges e{joined} WHERE edge_type = 'call') SELECT file, CAST(count(DISTINCT to_file || '|' || to_symbol) AS INTEGER) AS paths, CAST(count(DISTINCT to_file || '|' || to_symbol) + 1 AS INTEGER) AS nodes, CAST(count(DISTINCT to_file) AS INTEGER) AS edges FROM c GROUP BY file"


q("traces_down", _traces_sql(False), lambda g: _traces(g, False).select("file", F.size("paths").alias("paths"), "nodes", "edges"))
q("traces_up", _traces_sql(True), lambda g: _traces(g, True).select("file", F.size("paths").alias("paths"), "nodes", "edges"))
q("trace_exact", None, lambda g: (lambda t: t.select(F.explode("paths").alias("p")).select(F.transform("p", lambda n: F.concat(n["file"], F.lit("::"), F.coalesce(n["symbol"], F.lit("")))).alias("path")))(G.traces(g, g.edges.sparkSession.createDataFrame([(_first(g, "source_file"), None)], "file string, symbol string"), 2)))
q("cycle_detect", f"WITH s AS (SELECT * FROM {_STEP} WHERE a <> b) SELECT x.a || '>' || x.b AS path, 2 AS length FROM s x JOIN s y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b UNION ALL SELECT x.a || '>' || x.b || '>' || y.b, 3 FROM s x JOIN s y ON y.a = x.b JOIN s z ON z.a = y.b AND z.b = x.a WHERE x.a < x.b AND x.a < y.b AND y.b <> x.b", lambda g: G.cycles(g.edges, 3).select(F.array_join("path", ">").alias("path"), "length"))
#: Reachability outright: all pairs of a small graph. far is where the longest of the shortest ways from the first file ends.
_STEPS = f"s AS MATERIALIZED (SELECT * FROM {_STEP} WHERE a <> b)"
_WAY = f"""WITH {_STEPS}, ends AS (SELECT min(a) AS start_ FROM s), ds(node, k) AS (SELECT start_, 0 FROM ends UNION SELECT b, k + 1 FROM ds JOIN s ON a = node WHERE k < 25),
far AS (SELECT node AS goal, k AS n FROM (SELECT node, min(k) AS k FROM ds GROUP BY node) ORDER BY k DESC, node DESC LIMIT 1),
dg(node, k) AS (SELECT goal, 0 FROM far UNION SELECT a, k + 1 FROM dg JOIN s ON b = node WHERE k < 25), left_ AS MATERIALIZED (SELECT node, min(k) AS k FROM dg GROUP BY node),
next_ AS MATERIALIZED (SELECT a AS node, min(b) AS nxt FROM s JOIN left_ x ON x.node = a JOIN left_ y ON y.node = b AND y.k = x.k - 1 GROUP BY a),
way(node, i) AS (SELECT start_, 0 FROM ends UNION ALL SELECT nxt, i + 1 FROM way JOIN next_ USING (node))
SELECT string_agg(node, '>' ORDER BY i) AS path, CAST(count(*) AS INTEGER) AS length FROM way"""
q("critical_path", _WAY, lambda g: _critical(g))
_REACH = f"""WITH {_STEPS}, r(a, b) AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON s.a = r.b), mutual AS MATERIALIZED (SELECT a AS file, b AS other FROM r WHERE a <> b AND (b, a) IN (SELECT a, b FROM r)),
comp AS MATERIALIZED (SELECT file, least(file, min(other)) AS component FROM mutual GROUP BY file)"""
q("cycle_components", f"{_REACH} SELECT file, component FROM comp", lambda g: G.cyclic_components(g.edges))
q("shortest_cycles", f"""{_REACH}, roots AS (SELECT DISTINCT component AS root FROM comp), dg(root, node, k) AS (SELECT root, root, 0 FROM roots UNION SELECT root, a, k + 1 FROM dg JOIN s ON b = node WHERE k < 25 AND a <> root),
left_ AS MATERIALIZED (SELECT root, node, min(k) AS k FROM dg GROUP BY ALL), next_ AS MATERIALIZED (SELECT x.root, a AS node, min(b) AS nxt FROM s JOIN left_ x ON x.node = a JOIN left_ y ON y.root = x.root AND y.node = b AND y.k = x.k - 1 GROUP BY ALL),
first_ AS (SELECT root, b AS node FROM roots JOIN s ON a = root JOIN left_ USING (root) WHERE left_.node = b QUALIFY row_number() OVER (PARTITION BY root ORDER BY k, b) = 1),
way(root, node, i) AS (SELECT root, node, 1 FROM first_ UNION ALL SELECT root, nxt, i + 1 FROM way JOIN next_ USING (root, node))
SELECT root AS component, root || '>' || string_agg(node, '>' ORDER BY i) AS path, CAST(count(*) AS INTEGER) AS length FROM way GROUP BY root""", lambda g: G.shortest_cycles(g.edges).select("component", F.concat(F.array_join("path", ">"), F.lit(">"), "component").alias("path"), "length"))


def _critical(g: Graph) -> DataFrame:
    start = _first(g, "source_file")
    goal = G.trace_bfs(g.edges, start, 25).orderBy(F.desc("depth"), F.desc("file")).first()[0]
    return G.critical_path(g.edges, start, goal).select(F.array_join("path", ">").alias("path"), "length")


q("resolve_start", f"SELECT path AS file FROM g_files WHERE path = {FIRST_FILE} OR path LIKE '%' || {FIRST_FILE} ORDER BY path LIMIT 1", lambda g: (lambda p: g.files.where((F.col("path") == p) | F.col("path").endswith(p)).orderBy("path").limit(1).select(F.col("path").alias("file")))(first_path(g)))
_LP = "WITH w AS MATERIALIZED (SELECT a, b, count(*) AS w FROM (SELECT source_file AS a, target_file AS b FROM g_edges WHERE source_file <> target_file UNION ALL SELECT target_file, source_file FROM g_edges WHERE source_file <> target_file) GROUP BY ALL), l0 AS (SELECT path, path AS label FROM g_files)" + "".join(f", v{k} AS (SELECT a, label, sum(w) AS w FROM w JOIN l{k - 1} ON path = b GROUP BY ALL), b{k} AS (SELECT a, label FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, label) AS r FROM v{k}) WHERE r = 1), l{k} AS MATERIALIZED (SELECT path, coalesce(b{k}.label, l{k - 1}.label) AS label FROM l{k - 1} LEFT JOIN b{k} ON a = path)" for k in range(1, 6))
q("community_sync", _LP + " SELECT path, label FROM l5", lambda g: G.community_sync(g.edges, g.files, 5))
q("community_clusters", None, lambda g: G.numbered_communities(G.community_exact(g.edges, g.files), R.primary_memberships(g.files)))
q("community_number", _LP + ", big AS (SELECT label, row_number() OVER (ORDER BY label) AS k FROM l5 GROUP BY label HAVING count(*) >= 3) SELECT 'community_' || k AS cluster_name, path AS file_path FROM l5 JOIN big USING (label)", lambda g: G.numbered_communities(G.community_sync(g.edges, g.files, 5), g.files.where("false").select(F.col("repo").alias("cluster_name"), F.col("path").alias("file_path"))))
