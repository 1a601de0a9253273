"""The tools as one object over a graph's tables: each method is a question and returns a DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import extract, frameworks, laravel
from .functions.languages import EXTENSIONS
from .functions.lineage import cut
from .operators import context, exports, graph, relational, resolve
from .sources import workspace
from .sources.graph_tables import Graph


class CodeGraph(Graph):
    """Files, symbols and edges, with what is computed from them kept for the next question."""

    # --- building

    @classmethod
    def scan(cls, spark: SparkSession, root: str, repo: str, config: workspace.Config | None = None) -> "CodeGraph":
        """Reads a tree: all symbols first, then the references to them."""
        files = cut(workspace.walk_files(spark, root, repo, config))
        used = [r.framework for r in frameworks.active_frameworks(workspace.project_files(spark, root, repo, config)).select("framework").distinct().collect()]  # of a fixed table
        rows = cut(extract.extract(files, used))
        symbols, refs = extract.symbols_of(rows), extract.references_of(rows)
        own = relational.enclosing_symbol(refs.select(F.col("source_file").alias("file_path"), "line").distinct(), symbols).select(F.col("file_path").alias("source_file"), "line", F.col("symbol").alias("source_symbol"))
        found = resolve.resolve_symbol(refs, symbols, files).where("target IS NOT NULL").join(own, ["source_file", "line"], "left")
        edges = found.select("source_file", F.col("target").alias("target_file"), "source_symbol", F.when(F.col("how") == "member", F.substring_index("symbol", "::", -1)).otherwise(F.col("symbol")).alias("target_symbol"), "edge_type", "repo", F.lit(1.0).alias("weight"), F.when(F.col("how") == "contains", "inferred").otherwise(F.col("verifiability")).alias("verifiability"), F.lit(None).cast("string").alias("target_repo"), "line")
        if used:
            edges = edges.unionByName(cls._routed(files, symbols, repo, used).select(edges.columns))
        if "laravel" in used:
            more = laravel.edges(cut(laravel.facts(files.select("repo", "path", "text"))))
            edges = edges.unionByName(more.select(*(F.col(c) if c in more.columns else F.lit(1.0).alias(c) if c == "weight" else F.lit("verified").alias(c) if c == "verifiability" else F.lit(None).cast("string").alias(c) for c in edges.columns)))
        out = cls(files.join(extract.namespaces_of(rows), "path", "left"), symbols, cut(edges))
        out.texts = files.select("path", "text")
        return out

    @staticmethod
    def _routed(files: DataFrame, symbols: DataFrame, repo: str, used: list[str]) -> DataFrame:
        """Edges from the files that declare routes to the files of their handlers."""
        routes = frameworks.detect_routes(files, used).where("handler <> '' AND handler <> 'default'")
        handler = F.split("handler", "[@.]")
        routes = routes.select(F.col("handler_file").alias("source_file"), F.element_at(handler, 1).alias("symbol"), F.element_at(handler, -1).alias("target_symbol"), "line", "confidence").distinct()
        found = resolve.resolve_symbol(routes, symbols, files).where("how IN ('exact', 'short')")
        verifiability = F.when(F.col("confidence") >= 1, "verified").otherwise("inferred")
        none = F.lit(None).cast("string")
        return found.select("source_file", F.col("target").alias("target_file"), none.alias("source_symbol"), "target_symbol", F.lit("route").alias("edge_type"), F.lit(repo).alias("repo"), F.lit(1.0).alias("weight"), verifiability.alias("verifiability"), none.alias("target_repo"), "line")

    texts: DataFrame | None = None

    @cached_property
    def ranks(self) -> DataFrame:
        return graph.pagerank(graph.nodes(self), graph.graph_edges(self))

    @cached_property
    def memberships(self) -> DataFrame:
        return cut(relational.primary_memberships(self.files))

    # --- questions

    def query(self, pattern: str) -> DataFrame:
        return relational.symbol_query(self.symbols, pattern)

    def search(self, term: str, kind: str | None = None, prefix: str | None = None, exact: bool = False, limit: int = 20, offset: int = 0) -> DataFrame:
        found = relational.broaden_search(self.symbols, term, kind, prefix=prefix, exact=exact) if kind else relational.symbol_filter(self.symbols, term, prefix=prefix, exact=exact).withColumn("broadened", F.lit(False))
        ranked = graph.ranked_symbols(self, self.ranks).select("file_path", "name", "pagerank")
        return found.join(ranked, ["file_path", "name"], "left").orderBy(*relational.SYMBOL_ORDER).offset(offset).limit(limit)

    def suggestions(self, term: str) -> DataFrame:
        return context.fuzzy_suggest(self.symbols, term)

    def dependencies(self, path: str) -> DataFrame:
        return graph.dependencies(graph.dependency_edges(self), path)

    def reverse_dependencies(self, path: str) -> DataFrame:
        return graph.dependencies(graph.dependency_edges(self), path, reverse=True)

    def export(self, format: str = "llm", budget: int = 8192) -> DataFrame:
        files = graph.ranked_files(self, self.ranks)
        return {
            "json": lambda: exports.export_json(self),
            "dot": lambda: exports.export_dot(self),
            "svg": lambda: exports.export_svg(self, files),
            "llm": lambda: exports.export_llm(self, files, budget),
            "toon": lambda: exports.export_toon(self, graph.ranked_files(self, self.ranks), graph.ranked_symbols(self, self.ranks), budget=budget),
        }[format]()

    def status(self) -> DataFrame:
        return relational.workspace_list(self.files, self.symbols, self.edges)

    workspaces = status

    def metrics(self, language: str | None = None, verified_only: bool = False) -> DataFrame:
        return relational.file_coupling(self.files, self.edges, language, verified_only)

    def edge_query(self, **where: str) -> DataFrame:
        return relational.edge_query(self.edges, **where)

    def clusters(self, source: str | None = None) -> DataFrame:
        found = relational.primary_clusters(self.files).join(relational.cluster_file_counts(self.memberships), ["repo", "name"], "left").na.fill(0, ["file_count"])
        return found.where(F.col("source") == source) if source else found

    def cluster_edges(self, cluster: str | None = None) -> DataFrame:
        return relational.cluster_edges(self.edges, self.memberships, cluster)

    def communities(self) -> DataFrame:
        return graph.numbered_communities(graph.community_exact(self.edges, self.files), self.memberships)

    def trace(self, start: str, symbol: str | None = None, depth: int = 3, direction: str = "down", structural: bool = False) -> dict:
        if direction != "both":
            return graph.trace(self, start, symbol, depth, direction == "up", structural)
        down, up = (graph.trace(self, start, symbol, depth, d, structural) for d in (False, True))
        return {k: down[k] + up[k] if isinstance(down[k], list) else down[k] or up[k] if k == "max_depth_reached" else down[k] + up[k] - (k == "nodes") for k in down}

    def path_between(self, start: str, goal: str) -> DataFrame:
        return graph.critical_path(self.edges, start, goal)

    def routes(self, **where: str) -> DataFrame:
        return frameworks.route_query(frameworks.detect_routes(self.texts), **where)

    def hooks(self, **where: str) -> DataFrame:
        return frameworks.hook_query(frameworks.detect_hooks(self.texts), **where)

    def sources(self) -> DataFrame:
        return graph.source_label(graph.find_sources(self.edges), self.edges)

    def sinks(self) -> DataFrame:
        return graph.sink_label(graph.find_sinks(self.edges))

    def context(self, task: str, tokens: int = 8192, depth: int = 2, seeds: list[str] = ()) -> DataFrame:
        return context.build_context(self.files, self.symbols, self.edges, task, graph.ranked_files(self, self.ranks), self.memberships, tokens, depth, seeds)

    def callers(self, symbol: str, depth: int = 1) -> DataFrame:
        return graph.symbol_bfs(self.symbols, self.edges, symbol, depth)

    def callees(self, symbol: str, depth: int = 1) -> DataFrame:
        return graph.symbol_bfs(self.symbols, self.edges, symbol, depth, up=False)

    def impact(self, symbol: str, depth: int = 3) -> DataFrame:
        return graph.impact(self.symbols, self.edges, symbol, depth)

    def node(self, name: str) -> DataFrame:
        return relational.symbol_by_name(self.symbols, name)

    def files_filtered(self, **where) -> DataFrame:
        return relational.files_filtered(self.files, **where)

    def languages(self) -> dict[str, list[str]]:
        return {k: v.split() for k, v in EXTENSIONS.items()}

    def batch(self, ops: list[tuple[str, dict]], most: int = 10) -> DataFrame:
        """op_index and JSON rows of up to ten questions; more are refused."""
        if not 0 < len(ops) <= most:
            raise ValueError(f"between 1 and {most} questions, not {len(ops)}")
        parts = [getattr(self, name)(**args) for name, args in ops]
        rows = [p.select(F.lit(i).alias("op_index"), F.to_json(F.struct(*p.columns)).alias("row")) for i, p in enumerate(parts)]
        out = rows[0]
        for r in rows[1:]:
            out = out.union(r)
        return out
