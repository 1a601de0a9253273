"""Queries of the relational operators on the derived graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import predicates as P
from ..operators import relational as R
from ..registry import graph_query as q
from ..sources.graph_tables import DATA_EDGES, EDGE_ORDER, FRAMEWORK_EDGES, Graph

FIRST_FILE = "(SELECT min(path) FROM g_files)"
PRIMARY = """WITH ns_m AS (SELECT path AS file_path, repo, replace(namespace, chr(92), '.') AS cluster_name FROM g_files WHERE namespace IS NOT NULL),
dirs AS (SELECT repo, path, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS dir, i FROM g_files, unnest(range(1, len(string_split(path, '/')))) AS t(i)),
dir_n AS (SELECT repo, dir, count(DISTINCT path) AS files FROM dirs GROUP BY repo, dir HAVING count(DISTINCT path) >= 2),
dir_m AS (SELECT path AS file_path, repo, replace(arg_max(dir, i), '/', '.') AS cluster_name FROM dirs JOIN dir_n USING (repo, dir) WHERE path NOT IN (SELECT file_path FROM ns_m) GROUP BY path, repo),
members AS (SELECT * FROM ns_m UNION ALL SELECT * FROM dir_m)"""
NS_CLUSTERS = "SELECT DISTINCT repo, array_to_string(list_slice(string_split(cluster_name, '.'), 1, i), '.') AS name FROM ns_m, unnest(range(1, len(string_split(cluster_name, '.')) + 1)) AS t(i)"
PARENT = "CASE WHEN len(string_split(name, '.')) > 1 THEN array_to_string(list_slice(string_split(name, '.'), 1, len(string_split(name, '.')) - 1), '.') END"


def first_path(g: Graph) -> str:
    return g.files.agg(F.min("path")).first()[0]


FILE_COLUMNS = "path, file_id, repo, language, lines, size_bytes, namespace"
SYMBOL_COLUMNS = "file_path, repo, name, kind, scope, start_line, end_line"
EDGE_COLUMNS = "source_file, target_file, source_symbol, target_symbol, edge_type, repo, weight, verifiability, target_repo"

# scans and lookups
q("scan_files", f"SELECT {FILE_COLUMNS} FROM g_files WHERE repo = 'repo_0'", lambda g: R.of_repo(g.files, "repo_0"))
q("scan_symbols", f"SELECT {SYMBOL_COLUMNS} FROM g_symbols WHERE repo = 'repo_0'", lambda g: R.of_repo(g.symbols, "repo_0").orderBy("file_path", "start_line", "name"))
q("scan_edges", f"SELECT {EDGE_COLUMNS} FROM g_edges WHERE repo = 'repo_1'", lambda g: R.of_repo(g.edges, "repo_1"))
q("get_file", f"SELECT {FILE_COLUMNS} FROM g_files WHERE path = {FIRST_FILE}", lambda g: R.get_file(g.files, first_path(g)))
q("symbols_for_file", f"SELECT {SYMBOL_COLUMNS} FROM g_symbols WHERE file_path = {FIRST_FILE}", lambda g: g.symbols.where(F.col("file_path") == first_path(g)).orderBy("start_line"))
q("edges_for_file", f"SELECT {EDGE_COLUMNS} FROM g_edges WHERE source_file = {FIRST_FILE}", lambda g: g.edges.where(F.col("source_file") == first_path(g)).orderBy("edge_type"))
q("reverse_edges", f"SELECT {EDGE_COLUMNS} FROM g_edges WHERE target_file = {FIRST_FILE}", lambda g: g.edges.where(F.col("target_file") == first_path(g)).orderBy("edge_type"))


def _meta(g: Graph) -> DataFrame:
    return g.files.groupBy(F.concat(F.lit("last_scan_commit:"), "repo").alias("key")).agg(F.max("file_id").cast("string").alias("value"))


META = "SELECT concat('last_scan_commit:', repo) AS key, CAST(max(file_id) AS VARCHAR) AS value FROM g_files GROUP BY repo"
q("get_meta", f"SELECT * FROM ({META}) WHERE key = 'last_scan_commit:repo_0'", lambda g: _meta(g).where("key = 'last_scan_commit:repo_0'"))
q(
    "set_meta",
    f"SELECT key, CASE WHEN key = 'last_scan_commit:repo_1' THEN 'abc' ELSE value END AS value FROM ({META}) UNION ALL SELECT 'schema_version', '6'",
    lambda g: R.upsert(_meta(g), g.files.sparkSession.createDataFrame([("last_scan_commit:repo_1", "abc"), ("schema_version", "6")], "key string, value string"), "key"),
)

# changes
q("upsert_file", f"SELECT path, repo, language, CASE WHEN language = 'go' THEN lines + 1 ELSE lines END AS lines FROM g_files", lambda g: R.upsert(g.files.select("path", "repo", "language", "lines"), g.files.where("language = 'go'").select("path", "repo", "language", F.expr("lines + 1").alias("lines")), "path"))
q(
    "merge_file_metadata",
    "SELECT path, CASE WHEN language = 'php' THEN 'b' ELSE 'a' END AS x, 'go' AS y, CASE WHEN language = 'php' THEN 'App.New' ELSE namespace END AS namespace FROM g_files",
    lambda g: R.merge_file_metadata(
        g.files.select("path", "namespace", F.create_map(F.lit("x"), F.lit("a"), F.lit("y"), F.lit("go")).alias("metadata")),
        g.files.where("language = 'php'").select("path", F.create_map(F.lit("x"), F.lit("b"), F.lit("namespace"), F.lit("App.New")).alias("metadata")),
    ).select("path", F.col("metadata")["x"].alias("x"), F.col("metadata")["y"].alias("y"), "namespace"),
)
q("delete_file", f"SELECT (SELECT count(*) FROM g_files WHERE path <> {FIRST_FILE}) AS files, (SELECT count(*) FROM g_symbols WHERE file_path <> {FIRST_FILE}) AS symbols, (SELECT count(*) FROM g_edges WHERE source_file <> {FIRST_FILE} AND target_file <> {FIRST_FILE}) AS edges", lambda g: _sizes(R.delete_file(g.files, g.symbols, g.edges, first_path(g))))
q("delete_repo", "SELECT (SELECT count(*) FROM g_files WHERE repo <> 'repo_0') AS files, (SELECT count(*) FROM g_symbols WHERE repo <> 'repo_0') AS symbols, (SELECT count(*) FROM g_edges WHERE repo <> 'repo_0' AND coalesce(target_repo <> 'repo_0', true)) AS edges", lambda g: _sizes(R.delete_repo(g.files, g.symbols, g.edges, "repo_0")))


def _sizes(tables: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    files, symbols, edges = (t.agg(F.count("*").alias(n)) for t, n in zip(tables, ("files", "symbols", "edges")))
    return files.crossJoin(symbols).crossJoin(edges)


q("delete_symbols_for_file", f"SELECT {SYMBOL_COLUMNS} FROM g_symbols WHERE file_path <> {FIRST_FILE}", lambda g: R.delete_symbols_for_file(g.symbols, first_path(g)))
q("delete_edges_for_file", f"SELECT {EDGE_COLUMNS} FROM g_edges WHERE source_file <> {FIRST_FILE}", lambda g: R.delete_edges_for_file(g.edges, first_path(g)))
q("delete_framework_edges", f"SELECT {EDGE_COLUMNS} FROM g_edges WHERE NOT (repo = 'repo_0' AND edge_type IN ('extends', 'route'))", lambda g: R.delete_framework_edges(g.edges, "repo_0", ["extends", "route"]))

# searches
q("symbol_query", f"SELECT {SYMBOL_COLUMNS} FROM g_symbols WHERE lower(name) LIKE 'red%'", lambda g: R.symbol_query(g.symbols, "RED*"))
q("symbol_search", f"SELECT {SYMBOL_COLUMNS} FROM g_symbols WHERE (lower(name) LIKE '%red%' OR lower(file_path) LIKE '%red%') AND repo = 'repo_0' ORDER BY kind, name, file_path, start_line LIMIT 20 OFFSET 5", lambda g: R.symbol_search(g.symbols, "RED", offset=5, repo="repo_0"))
q("symbol_search_prefix", f"SELECT {SYMBOL_COLUMNS} FROM g_symbols WHERE lower(name) LIKE '%o_a%' AND lower(kind) = 'method' AND lower(file_path) LIKE 'src/%' ORDER BY kind, name, file_path, start_line LIMIT 50", lambda g: R.symbol_search(g.symbols, "*o?A*", limit=50, kind="METHOD", prefix="SRC/"))
q("symbol_search_count", "SELECT count(*) AS count FROM g_symbols WHERE lower(name) LIKE '%red%' OR lower(file_path) LIKE '%red%'", lambda g: R.symbol_filter(g.symbols, "RED").agg(F.count("*").alias("count")))
q("symbol_search_exact", f"SELECT {SYMBOL_COLUMNS} FROM g_symbols WHERE lower(name) = 'redwidget' OR lower(file_path) = 'redwidget'", lambda g: R.symbol_filter(g.symbols, "RedWidget", exact=True))
q("broaden_search", f"SELECT {SYMBOL_COLUMNS}, true AS broadened FROM g_symbols WHERE lower(name) LIKE '%widget%' OR lower(file_path) LIKE '%widget%'", lambda g: R.broaden_search(g.symbols, "widget", "trait"))
q("symbol_by_name", f"SELECT {SYMBOL_COLUMNS} FROM g_symbols WHERE name = 'onAF' AND scope = 'redwidget' ORDER BY file_path, start_line, name LIMIT 1", lambda g: R.symbol_by_name(g.symbols, "redwidget::onAF"))
q("symbol_names", "SELECT DISTINCT name FROM g_symbols", lambda g: g.symbols.select("name").distinct().orderBy("name"))
q("edge_query", f"SELECT {EDGE_COLUMNS} FROM g_edges WHERE repo = 'repo_0' AND edge_type = 'call' AND lower(source_file) LIKE '%brand_1%' AND lower(target_file) LIKE '%.py%'", lambda g: R.edge_query(g.edges, "call", "Brand_1", ".PY", "repo_0"))
q("files_filtered", f"SELECT {FILE_COLUMNS} FROM g_files WHERE lower(path) LIKE 'src/%' AND language = 'php' ORDER BY lines DESC, path LIMIT 50", lambda g: R.files_filtered(g.files, "SRC/", "PHP", "lines"))
q("path_matcher", "SELECT path FROM g_files WHERE regexp_matches(path, '^src/.*red[^/]*\\.(ts|py)$') AND NOT list_contains(string_split(path, '/'), 'brand_1')", lambda g: g.files.select("path").where(P.included("path", ["src/**/*red*.{ts,py}"], ["brand_1"])))
q("dir_excluded", "SELECT path, (path LIKE 'src/%/brand_1/%' OR list_contains(string_split(path, '/'), 'brand_2') OR regexp_matches(path, '^src/[^/]*/brand_1(/.*)?$')) AS excluded FROM g_files", lambda g: g.files.select("path", P.dir_excluded("path", ["src/*/brand_1", "brand_2"]).alias("excluded")))
q("glob_helpers", "SELECT DISTINCT p_name AS term, replace(replace(p_name, 'e', '%'), 'd', '_') AS pattern FROM part", lambda g: _globs(g))
q("is_test_file", "SELECT path, regexp_matches(path, '\\.(test|spec)\\.[a-z]+$|/[tT][eE][sS][tT][sS]?/|__tests__') AS is_test FROM (SELECT replace(path, 'brand_1', 'tests') AS path FROM g_files)", lambda g: g.files.select(F.replace("path", F.lit("brand_1"), F.lit("tests")).alias("path")).select("path", P.is_test_file("path").alias("is_test")))
q("matches_symbol", "SELECT count(*) AS n FROM g_edges a JOIN g_symbols s ON a.target_file = s.file_path WHERE a.target_symbol IS NULL OR concat(s.scope, '::', s.name) = a.target_symbol OR s.name = a.target_symbol OR s.scope IS NULL", lambda g: g.edges.join(g.symbols.select("file_path", F.concat("scope", F.lit("::"), "name").alias("node")), F.col("target_file") == F.col("file_path")).where(P.matches_symbol(F.col("node"), F.col("target_symbol"))).agg(F.count("*").alias("n")))


def _globs(g: Graph) -> DataFrame:
    names = g.files.select(F.regexp_extract("path", r"([^/]+)_\d+\.\w+$", 1).alias("n")).select(F.replace("n", F.lit("_"), F.lit(" ")).alias("term")).distinct()
    return names.select("term", F.replace(F.replace("term", F.lit("e"), F.lit(P.glob_to_like("*"))), F.lit("d"), F.lit(P.glob_to_like("?"))).alias("pattern"))


# joins
q("symbol_callers", f"SELECT {', '.join('e.' + c for c in EDGE_COLUMNS.split(', '))} FROM g_symbols s JOIN g_edges e ON e.target_file = s.file_path AND (e.target_symbol = s.name OR e.target_symbol = s.scope || '::' || s.name) WHERE s.name = 'redwidget' AND e.edge_type NOT IN ('import', 'require')", lambda g: R.symbol_callers(g.symbols, g.edges, "redwidget"))
q("symbol_callees", f"SELECT {', '.join('e.' + c for c in EDGE_COLUMNS.split(', '))} FROM g_symbols s JOIN g_edges e ON e.source_file = s.file_path AND (e.source_symbol = s.name OR e.source_symbol = s.scope || '::' || s.name) WHERE s.name = 'onAF' AND s.scope = 'redwidget'", lambda g: R.symbol_callees(g.symbols, g.edges, "redwidget::onAF"))
q(
    "cluster_edges",
    PRIMARY + ", pairs AS (SELECT a.cluster_name AS source_cluster, b.cluster_name AS target_cluster, edge_type, count(*) AS n FROM g_edges e JOIN members a ON a.file_path = e.source_file JOIN members b ON b.file_path = e.target_file WHERE a.cluster_name <> b.cluster_name GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY source_cluster, target_cluster ORDER BY n DESC, edge_type) AS r FROM pairs)"
    " SELECT source_cluster, target_cluster, CAST(sum(n) AS BIGINT) AS edge_count, max(CASE WHEN r = 1 THEN edge_type END) AS dominant_type FROM ranked GROUP BY source_cluster, target_cluster",
    lambda g: R.cluster_edges(g.edges, R.primary_memberships(g.files)),
)
q("enclosing_symbol", "SELECT path AS file_path, line, (SELECT s.name FROM g_symbols s WHERE s.file_path = path AND line BETWEEN s.start_line AND s.end_line ORDER BY s.end_line - s.start_line, s.start_line, s.name LIMIT 1) AS symbol FROM g_files, unnest([0, 2, 5, 9]) AS t(line)", lambda g: R.enclosing_symbol(g.files.select(F.col("path").alias("file_path"), F.explode(F.array(*map(F.lit, (0, 2, 5, 9)))).alias("line")), g.symbols))
IMPORT_SUFFIXES = ["", "/index.js", "/index.ts", "/index.tsx", "/index.jsx", "/index.vue", ".js", ".ts", ".tsx", ".jsx", ".vue"]
q("resolve_import", "SELECT ref, ref || '.ts' AS target FROM (SELECT regexp_replace(path, '\\.[a-z]+$', '') AS ref, path FROM g_files) WHERE path LIKE '%.ts'", lambda g: R.first_candidate(g.files.select(F.regexp_replace("path", r"\.[a-z]+$", "").alias("ref")), g.files, F.array(*(F.concat("ref", F.lit(s)) for s in IMPORT_SUFFIXES))))
q("resolve_require", "SELECT path AS ref, path AS target FROM g_files WHERE language = 'python'", lambda g: R.first_candidate(g.files.where("language = 'python'").select(F.col("path").alias("ref")), g.files, F.array("ref", F.concat("ref", F.lit(".js")), F.concat("ref", F.lit("/index.js")))))
q("files_with_symbols", f"SELECT {FILE_COLUMNS} FROM g_files WHERE path IN (SELECT file_path FROM g_symbols WHERE kind = 'method')", lambda g: R.files_with_symbols(g.files, g.symbols.where("kind = 'method'")))
q("files_without_symbols", f"SELECT {FILE_COLUMNS} FROM g_files WHERE path NOT IN (SELECT file_path FROM g_symbols WHERE name = 'onAF')", lambda g: R.files_with_symbols(g.files, g.symbols.where("name = 'onAF'"), without=True))
q("change_classify", "SELECT path, CASE WHEN lines < 100 THEN 'new' WHEN lines < 200 THEN 'deleted' WHEN lines < 300 THEN 'changed' WHEN path NOT IN (SELECT file_path FROM g_symbols WHERE name = 'onAF') THEN 'incomplete' ELSE 'unchanged' END AS status FROM g_files", lambda g: R.change_classify(g.files.where("lines >= 100").select("path", F.md5("path").alias("hash")), g.files.where("NOT (lines >= 100 AND lines < 200)").select("path", F.md5(F.expr("CASE WHEN lines >= 200 AND lines < 300 THEN concat(path, 'x') ELSE path END")).alias("hash")), g.symbols.where("name = 'onAF'")))
q("included_edges", f"SELECT {EDGE_COLUMNS} FROM g_edges WHERE source_file IN (SELECT path FROM g_files WHERE lines > 250) AND target_file IN (SELECT path FROM g_files WHERE lines > 250)", lambda g: R.included_edges(g.edges, g.files.where("lines > 250")))
q("kept_symbol_edges", f"SELECT {EDGE_COLUMNS} FROM g_edges WHERE (source_symbol IS NULL OR false OR (source_file, source_symbol) IN (SELECT file_path, scope || '::' || name FROM g_symbols WHERE name = 'onAF')) AND (target_symbol IS NULL OR (target_file, target_symbol) IN (SELECT file_path, name FROM g_symbols))", lambda g: R.kept_symbol_edges(g.edges, g.symbols.where("name = 'onAF'").select("file_path", F.concat("scope", F.lit("::"), "name").alias("name")).unionByName(g.symbols.select("file_path", "name"))))
q("scoped_name", f"SELECT {', '.join('e.' + c for c in EDGE_COLUMNS.split(', '))}, CASE WHEN s.scope IS NULL THEN e.target_symbol ELSE s.scope || '::' || e.target_symbol END AS scoped FROM g_edges e LEFT JOIN g_symbols s ON s.file_path = e.target_file AND s.name = e.target_symbol", lambda g: R.scoped_name(g.edges, g.symbols))
q("proximity_boundary", f"SELECT {EDGE_COLUMNS}, CASE WHEN source_file LIKE '%brand_1/%' THEN 0 ELSE 1 END + CASE WHEN target_file LIKE '%brand_1/%' THEN 0 ELSE 1 END AS outside FROM g_edges WHERE source_file LIKE '%brand_1/%' OR target_file LIKE '%brand_1/%'", lambda g: R.proximity_boundary(g.edges, g.files.where("path LIKE '%brand_1/%'")))
q("seed_clusters", PRIMARY + " SELECT DISTINCT cluster_name FROM members WHERE file_path IN (SELECT path FROM g_files WHERE lines > 450)", lambda g: R.primary_memberships(g.files).join(g.files.where("lines > 450").select(F.col("path").alias("file_path")), "file_path", "left_semi").select("cluster_name").distinct())
q("cluster_files", PRIMARY + ", one AS (SELECT min(cluster_name) AS c FROM members) SELECT file_path FROM members, one WHERE cluster_name = c", lambda g: (lambda m: m.where(F.col("cluster_name") == m.agg(F.min("cluster_name")).first()[0]).select("file_path"))(R.primary_memberships(g.files)))
q("lang_compatible", "SELECT a.language AS a, b.language AS b, a.language = b.language AS compatible FROM (SELECT DISTINCT language FROM g_files) a, (SELECT DISTINCT language FROM g_files) b", lambda g: _compatible(g))


def _compatible(g: Graph) -> DataFrame:
    from ..functions.languages import compatible

    langs = g.files.select("language").distinct()  # bounded: the registry's languages
    return langs.select(F.col("language").alias("a")).crossJoin(F.broadcast(langs.select(F.col("language").alias("b")))).select("a", "b", compatible("a", "b").alias("compatible"))


# aggregates
q("count_files", "SELECT count(*) AS count FROM g_files", lambda g: g.files.agg(F.count("*").alias("count")))
q("count_symbols", "SELECT count(*) AS count FROM g_symbols WHERE repo = 'repo_0'", lambda g: R.of_repo(g.symbols, "repo_0").agg(F.count("*").alias("count")))
q("count_edges", "SELECT count(*) AS count FROM g_edges", lambda g: g.edges.agg(F.count("*").alias("count")))
q("language_breakdown", "SELECT language, count(*) AS count FROM g_files GROUP BY language", lambda g: R.counts(g.files, "language"))
q("symbol_kinds", "SELECT kind, count(*) AS count FROM g_symbols GROUP BY kind", lambda g: R.counts(g.symbols, "kind").orderBy(F.desc("count"), "kind"))
q("edge_types", "SELECT edge_type, count(*) AS count FROM g_edges GROUP BY edge_type", lambda g: R.counts(g.edges, "edge_type"))
q("verifiability_counts", "SELECT count(*) FILTER (verifiability = 'verified') AS verified, count(*) FILTER (verifiability = 'inferred') AS inferred FROM g_edges", lambda g: g.edges.agg(F.count_if(F.col("verifiability") == "verified").alias("verified"), F.count_if(F.col("verifiability") == "inferred").alias("inferred")))
q("symbols_per_file", "SELECT file_path, count(*) AS count FROM g_symbols GROUP BY file_path", lambda g: R.counts(g.symbols, "file_path"))
q("top_out_degree", "SELECT source_file, count(*) AS count FROM g_edges GROUP BY source_file ORDER BY count DESC, source_file LIMIT 5", lambda g: R.top(R.counts(g.edges, "source_file"), 5, F.desc("count"), "source_file"))
q("avg_edges_per_file", "SELECT round((SELECT count(*) FROM g_edges) * 1.0 / (SELECT count(*) FROM g_files), 6) AS value", lambda g: g.edges.agg(F.count("*").alias("m")).crossJoin(g.files.agg(F.count("*").alias("n"))).select(F.round(F.col("m") / F.col("n"), 6).alias("value")))
q("file_coupling", "SELECT path, language, coalesce(ca, 0) AS afferent, coalesce(ce, 0) AS efferent, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) ELSE 0.0 END AS instability FROM g_files LEFT JOIN (SELECT target_file, count(DISTINCT source_file) AS ca FROM g_edges WHERE source_file <> target_file GROUP BY 1) a ON a.target_file = path LEFT JOIN (SELECT source_file, count(DISTINCT target_file) AS ce FROM g_edges WHERE source_file <> target_file GROUP BY 1) b ON b.source_file = path", lambda g: R.file_coupling(g.files, g.edges))
q("sort_metrics", "SELECT path, language, coalesce(ca, 0) AS afferent, coalesce(ce, 0) AS efferent, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) ELSE 0.0 END AS instability FROM g_files LEFT JOIN (SELECT target_file, count(DISTINCT source_file) AS ca FROM g_edges WHERE source_file <> target_file AND verifiability = 'verified' GROUP BY 1) a ON a.target_file = path LEFT JOIN (SELECT source_file, count(DISTINCT target_file) AS ce FROM g_edges WHERE source_file <> target_file AND verifiability = 'verified' GROUP BY 1) b ON b.source_file = path WHERE language = 'python' ORDER BY instability DESC, afferent DESC, path LIMIT 25", lambda g: R.file_coupling(g.files, g.edges, language="Python", verified_only=True).limit(25))
q("graph_density", "SELECT round((SELECT count(*) FROM g_edges) / (n * (n - 1)), 9) AS density FROM (SELECT count(*) AS n FROM g_files)", lambda g: R.graph_density(g.files, g.edges).select(F.round("density", 9).alias("density")))
q("density_pct", "SELECT round(100 * (SELECT count(*) FROM g_edges) / (n * (n - 1)), 6) AS density_pct FROM (SELECT count(*) AS n FROM g_files)", lambda g: R.graph_density(g.files, g.edges).select(F.round(100 * F.col("density"), 6).alias("density_pct")))
q("graph_transitivity", "WITH u AS (SELECT DISTINCT least(source_file, target_file) AS a, greatest(source_file, target_file) AS b FROM g_edges WHERE source_file <> target_file), d AS (SELECT v, count(*) AS k FROM (SELECT a AS v FROM u UNION ALL SELECT b FROM u) GROUP BY v), t AS (SELECT count(*) AS n FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b) SELECT round(3 * n / (SELECT sum(k * (k - 1) / 2) FROM d), 9) AS transitivity, n AS triangles FROM t", lambda g: R.graph_transitivity(g.edges).select(F.round("transitivity", 9).alias("transitivity"), "triangles"))
_ORDERED = ", ".join(EDGE_ORDER)
q("first_per_key", f"SELECT {EDGE_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY source_file, target_file, edge_type, source_symbol ORDER BY {_ORDERED}) AS r FROM g_edges) WHERE r = 1", lambda g: R.first_per_key(g.edges, "source_file", "target_file", "edge_type", "source_symbol"))
q("llm_dep_dedup", f"SELECT {EDGE_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY source_file, target_file, edge_type ORDER BY {_ORDERED}) AS r FROM g_edges) WHERE r = 1", lambda g: R.first_per_key(g.edges, "source_file", "target_file", "edge_type"))
q("edge_rollup", f"SELECT source_file, target_file, max(weight) AS weight, count(*) AS count, max(CASE WHEN r = 1 THEN edge_type END) AS edge_type, max(CASE WHEN r = 1 THEN verifiability END) AS verifiability FROM (SELECT *, row_number() OVER (PARTITION BY source_file, target_file ORDER BY {_ORDERED}) AS r FROM g_edges) GROUP BY source_file, target_file", lambda g: R.edge_rollup(g.edges))
q("dir_rollup", "SELECT source_dir, target_dir, count(*) AS edges FROM (SELECT DISTINCT source_file, target_file, regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS source_dir, regexp_extract(target_file, '^(.*)/[^/]*$', 1) AS target_dir FROM g_edges) WHERE source_dir <> target_dir GROUP BY source_dir, target_dir", lambda g: R.dir_rollup(g.edges))
q("cluster_rollup", "WITH p AS (SELECT DISTINCT source_file, target_file FROM g_edges WHERE source_file <> target_file), d AS (SELECT f, count(*) AS k FROM (SELECT source_file AS f FROM p UNION ALL SELECT target_file FROM p) GROUP BY f), own AS (SELECT path, CASE WHEN k IS NULL THEN 'orphans' WHEN k = 1 THEN 'singulars' ELSE language END AS grp FROM g_files LEFT JOIN d ON f = path) SELECT a.grp AS source_group, b.grp AS target_group, count(*) AS edges FROM p JOIN own a ON a.path = source_file JOIN own b ON b.path = target_file WHERE a.grp <> b.grp GROUP BY ALL", lambda g: R.cluster_rollup(g.files, g.edges, F.col("language")))
q("workspace_list", "SELECT f.repo, files, symbols, edges, cross_repo_edges FROM (SELECT repo, count(*) AS files FROM g_files GROUP BY repo) f JOIN (SELECT repo, count(*) AS symbols FROM g_symbols GROUP BY repo) s USING (repo) JOIN (SELECT repo, count(*) AS edges, count(*) FILTER (target_repo <> repo) AS cross_repo_edges FROM g_edges GROUP BY repo) e USING (repo)", lambda g: R.workspace_list(g.files, g.symbols, g.edges))
q("doc_summary", "SELECT (SELECT count(*) FROM g_files) AS files, (SELECT count(*) FROM g_symbols) AS symbols, (SELECT count(*) FROM g_edges) AS edges, (SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM (SELECT language, count(*) AS n FROM g_files GROUP BY language)) AS languages", lambda g: _sizes((g.files, g.symbols, g.edges)).crossJoin(R.counts(g.files, "language").agg(F.array_join(F.array_sort(F.collect_list(F.concat("language", F.lit("="), F.col("count").cast("string")))), ",").alias("languages"))))
q("project_summary", "SELECT concat('Files: ', (SELECT count(*) FROM g_files), chr(10), 'Symbols: ', (SELECT count(*) FROM g_symbols), chr(10), 'Dependencies: ', (SELECT count(*) FROM g_edges)) AS summary", lambda g: _sizes((g.files, g.symbols, g.edges)).select(F.format_string("Files: %d\nSymbols: %d\nDependencies: %d", "files", "symbols", "edges").alias("summary")))
q("lang_sorted", "SELECT language, count(*) AS count FROM g_files GROUP BY language ORDER BY count DESC, language", lambda g: R.counts(g.files, "language").orderBy(F.desc("count"), "language"))
q("llm_file_summary", "WITH n AS (SELECT file_path, kind, count(*) AS n FROM g_symbols GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY n DESC, kind) AS r FROM n) SELECT file_path, CAST(sum(n) AS BIGINT) AS symbols, string_agg(n || ' ' || kind, ', ' ORDER BY r) FILTER (r <= 3) AS kinds, max(CASE WHEN r = 1 THEN kind END) AS dominant FROM r GROUP BY file_path", lambda g: R.llm_file_summary(g.symbols))
q("top3_kinds", "SELECT file_path, name, start_line FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line DESC, name) AS r FROM g_symbols) WHERE r <= 3", lambda g: g.symbols.withColumn("r", F.row_number().over(R.Window.partitionBy("file_path").orderBy(F.desc("start_line"), "name"))).where("r <= 3").select("file_path", "name", "start_line"))

# hierarchies
q("namespace_clusters", PRIMARY + f" SELECT repo, name, array_to_string(string_split(name, '.'), ' / ') AS label, 'namespace' AS source, {PARENT} AS parent_name, CAST(len(string_split(name, '.')) - 1 AS INTEGER) AS depth FROM ({NS_CLUSTERS})", lambda g: R.namespace_clusters(g.files))
q("directory_clusters", PRIMARY + f" SELECT repo, name, array_to_string(string_split(name, '.'), ' / ') AS label, 'directory' AS source, {PARENT} AS parent_name, CAST(len(string_split(name, '.')) AS INTEGER) AS depth FROM (SELECT repo, replace(dir, '/', '.') AS name FROM dir_n)", lambda g: R.directory_clusters(g.files))
q("scan_clusters", PRIMARY + f" SELECT repo, name, source FROM (SELECT repo, name, 'namespace' AS source FROM ({NS_CLUSTERS}) UNION ALL SELECT repo, replace(dir, '/', '.'), 'directory' FROM dir_n)", lambda g: R.primary_clusters(g.files).select("repo", "name", "source"))
q("merge_primary_clusters", PRIMARY + f", both_ AS (SELECT repo, name, 0 AS p FROM ({NS_CLUSTERS}) UNION ALL SELECT repo, replace(dir, '/', '.'), 1 FROM dir_n) SELECT repo, name, CASE min(p) WHEN 0 THEN 'namespace' ELSE 'directory' END AS source FROM both_ GROUP BY repo, name", lambda g: R.primary_clusters(g.files).select("repo", "name", "source"))
q("scan_memberships", PRIMARY + " SELECT file_path, repo, cluster_name, true AS is_primary FROM members", lambda g: R.primary_memberships(g.files))
q("deepest_cluster", PRIMARY + " SELECT file_path, repo, cluster_name FROM dir_m", lambda g: R.directory_memberships(g.files, R.namespace_memberships(g.files)).drop("is_primary"))
q("dir_file_counts", PRIMARY + " SELECT repo, dir, files FROM dir_n", lambda g: R.dir_file_counts(g.files))
q("cluster_file_counts", PRIMARY + " SELECT repo, array_to_string(list_slice(string_split(cluster_name, '.'), 1, i), '.') AS name, count(*) AS file_count FROM members, unnest(range(1, len(string_split(cluster_name, '.')) + 1)) AS t(i) GROUP BY ALL", lambda g: R.cluster_file_counts(R.primary_memberships(g.files)))
q("cluster_tree", PRIMARY + f" SELECT DISTINCT repo, name, repeat('  ', len(string_split(name, '.')) - 1) || string_split(name, '.')[-1] AS line FROM (SELECT repo, name FROM ({NS_CLUSTERS}) UNION SELECT repo, replace(dir, '/', '.') FROM dir_n)", lambda g: R.cluster_tree(R.primary_clusters(g.files)))
q("same_set_drop", "SELECT language AS cluster_name, path AS file_path FROM g_files WHERE language <> 'php'", lambda g: R.same_set_drop(g.files.select(F.col("language").alias("cluster_name"), F.col("path").alias("file_path")), g.files.where("language = 'php'").select(F.lit("other").alias("cluster_name"), F.col("path").alias("file_path"))))

# set operations and pages
q("node_universe", "SELECT path FROM g_files UNION SELECT source_file FROM g_edges UNION SELECT target_file FROM g_edges", lambda g: g.files.select("path").union(g.edges.select("source_file")).union(g.edges.select("target_file")).distinct())
q("union_changes", "SELECT path, CASE WHEN lines > 200 THEN 'modified' ELSE 'staged' END AS status FROM g_files WHERE lines > 200 OR language = 'go'", lambda g: R.upsert(g.files.where("language = 'go'").select("path", F.lit("staged").alias("status")), g.files.where("lines > 200").select("path", F.lit("modified").alias("status")), "path"))
q("discovered_minus_registered", "SELECT DISTINCT concat('repo_', CAST(file_id % 5 AS VARCHAR)) AS repo FROM g_files WHERE concat('repo_', CAST(file_id % 5 AS VARCHAR)) NOT IN (SELECT repo FROM g_files)", lambda g: g.files.select(F.expr("concat('repo_', file_id % 5)").alias("repo")).distinct().join(g.files.select("repo").distinct(), "repo", "left_anti"))
q("order_symbols", f"SELECT {SYMBOL_COLUMNS} FROM g_symbols ORDER BY kind, name, file_path, start_line LIMIT 30 OFFSET 10", lambda g: R.symbol_search(g.symbols, limit=30, offset=10))
q("page_symbols", f"SELECT {SYMBOL_COLUMNS} FROM g_symbols ORDER BY kind, name, file_path, start_line LIMIT 200", lambda g: R.symbol_search(g.symbols, limit=min(max(500, 1), 200), offset=max(-3, 0)))
q("page_elements", "SELECT id, kind FROM (SELECT path AS id, 'node' AS kind, 0 AS k FROM g_files UNION ALL SELECT source_file || '->' || target_file, 'edge', 1 FROM (SELECT DISTINCT source_file, target_file FROM g_edges)) ORDER BY k, id LIMIT 100 OFFSET 50", lambda g: g.files.select(F.col("path").alias("id"), F.lit("node").alias("kind"), F.lit(0).alias("k")).union(g.edges.select("source_file", "target_file").distinct().select(F.concat("source_file", F.lit("->"), "target_file"), F.lit("edge"), F.lit(1))).orderBy("k", "id").offset(50).limit(100).drop("k"))
q("node_related", f"SELECT 'sibling' AS relation, name FROM (SELECT name FROM g_symbols WHERE file_path = {FIRST_FILE} ORDER BY start_line, name LIMIT 5) UNION ALL SELECT 'caller', source_symbol FROM (SELECT source_symbol FROM g_edges WHERE target_file = {FIRST_FILE} ORDER BY source_symbol, source_file LIMIT 3) UNION ALL SELECT 'callee', target_symbol FROM (SELECT target_symbol FROM g_edges WHERE source_file = {FIRST_FILE} ORDER BY target_symbol, target_file LIMIT 3)", lambda g: _related(g))


def _related(g: Graph) -> DataFrame:
    path = first_path(g)
    siblings = g.symbols.where(F.col("file_path") == path).orderBy("start_line", "name").limit(5).select(F.lit("sibling").alias("relation"), "name")
    callers = g.edges.where(F.col("target_file") == path).orderBy("source_symbol", "source_file").limit(3).select(F.lit("caller"), "source_symbol")
    return siblings.union(callers).union(g.edges.where(F.col("source_file") == path).orderBy("target_symbol", "target_file").limit(3).select(F.lit("callee"), "target_symbol"))


q("dominant_type", "SELECT source_file, arg_max(edge_type, n) AS edge_type FROM (SELECT source_file, edge_type, n, row_number() OVER (PARTITION BY source_file ORDER BY n DESC, edge_type) AS r FROM (SELECT source_file, edge_type, count(*) AS n FROM g_edges GROUP BY ALL)) WHERE r = 1 GROUP BY source_file", lambda g: R.counts(g.edges, "source_file", "edge_type", name="n").groupBy("source_file").agg(F.min_by("edge_type", F.struct(-F.col("n"), "edge_type")).alias("edge_type")))
q("smallest_span", "SELECT file_path, name FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY end_line - start_line, start_line, name) AS r FROM g_symbols) WHERE r = 1", lambda g: g.symbols.groupBy("file_path").agg(F.min_by("name", F.struct(F.col("end_line") - F.col("start_line"), "start_line", "name")).alias("name")))
