"""Filters, joins and aggregates over the code graph's tables. Every operator maps DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, numbered
from ..sources.graph_tables import EDGE_ORDER, FRAMEWORK_EDGES
from .predicates import folded, folded_text, glob_to_like, is_glob, is_wildcard, like, same


def of_repo(df: DataFrame, repo: str | None) -> DataFrame:
    return df if repo is None else df.where(F.col("repo") == repo)


# --- sources and lookups


def get_file(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and those of `old` whose key it lacks."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def merged_metadata(old: str | Column, new: str | Column) -> Column:
    """Two maps as one; of a key in both, the new value."""
    old, new = (F.col(c) if isinstance(c, str) else c for c in (old, new))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def merge_file_metadata(files: DataFrame, news: DataFrame) -> DataFrame:
    """files with each path's metadata merged with that of `news` (path, metadata); the namespace follows if it is set."""
    joined = files.join(news.select("path", F.col("metadata").alias("__new")), "path", "left")
    merged = F.when(F.col("__new").isNull(), F.col("metadata")).otherwise(merged_metadata(F.coalesce("metadata", F.create_map().cast("map<string,string>")), "__new"))
    return joined.withColumn("namespace", F.coalesce(F.try_element_at("__new", F.lit("namespace")), "namespace")).withColumn("metadata", merged).select(*files.columns)


# --- deletes


def delete_file(files: DataFrame, symbols: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A file goes with its symbols and with the edges at either end."""
    return files.where(F.col("path") != path), symbols.where(F.col("file_path") != path), edges.where((F.col("source_file") != path) & (F.col("target_file") != path))


def delete_symbols_for_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("file_path") != path)


def delete_edges_for_file(edges: DataFrame, path: str) -> DataFrame:
    """The file's outgoing edges only."""
    return edges.where(F.col("source_file") != path)


def delete_framework_edges(edges: DataFrame, repo: str, types: list[str] = FRAMEWORK_EDGES) -> DataFrame:
    return edges.where(~((F.col("repo") == repo) & F.col("edge_type").isin(*types)))


def delete_repo(files: DataFrame, symbols: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Everything of a repo, edges into it from others included; clusters stay."""
    other = F.col("repo") != repo
    return files.where(other), symbols.where(other), edges.where(other & F.coalesce(F.col("target_repo") != repo, F.lit(True)))


# --- searches


def symbol_query(symbols: DataFrame, pattern: str, repo: str | None = None) -> DataFrame:
    """By name without case: a wildcard is everything, a glob is itself, other text may be anywhere."""
    found = of_repo(symbols, repo)
    if not is_wildcard(pattern):
        found = found.where(like("name", glob_to_like(pattern) if is_glob(pattern) else f"%{pattern}%"))
    return found


def symbol_filter(symbols: DataFrame, term: str = "*", kind: str | None = None, prefix: str | None = None, exact: bool = False, repo: str | None = None) -> DataFrame:
    """Plain terms also match paths, globs do not; exact ones match a whole name or path."""
    found = of_repo(symbols, repo)
    if exact:
        found = found.where(same("name", term) | same("file_path", term))
    elif not is_wildcard(term):
        found = found.where(like("name", glob_to_like(term)) if is_glob(term) else like("name", f"%{term}%") | like("file_path", f"%{term}%"))
    if kind:
        found = found.where(same("kind", kind))
    if prefix:
        found = found.where(like("file_path", f"{prefix}%"))
    return found


SYMBOL_ORDER = ("kind", "name", "file_path", "start_line")


def symbol_search(symbols: DataFrame, term: str = "*", limit: int = 20, offset: int = 0, **where) -> DataFrame:
    return symbol_filter(symbols, term, **where).orderBy(*SYMBOL_ORDER).offset(offset).limit(limit)


def broaden_search(symbols: DataFrame, term: str, kind: str, **where) -> DataFrame:
    """The search with the kind; if it finds nothing, without it. `broadened` says which."""
    narrow = symbol_filter(symbols, term, kind=kind, **where)
    wide = symbol_filter(symbols, term, **where)
    any_ = narrow.limit(1).agg((F.count("*") > 0).alias("__any"))
    return narrow.withColumn("broadened", F.lit(False)).unionByName(wide.crossJoin(F.broadcast(any_)).where("NOT __any").drop("__any").withColumn("broadened", F.lit(True)))


def scoped(full_name: str) -> tuple[str | None, str]:
    """`A::b` is b in A. Of longer chains the last part is the name and what is before it the scope."""
    scope, sep, name = full_name.rpartition("::")
    return (scope, name) if sep else (None, full_name)


def symbol_by_name(symbols: DataFrame, full_name: str, repo: str | None = None) -> DataFrame:
    scope, name = scoped(full_name)
    found = of_repo(symbols, repo).where(F.col("name") == name)
    return (found.where(F.col("scope") == scope) if scope else found).orderBy("file_path", "start_line", "name").limit(1)


def edge_query(edges: DataFrame, type: str | None = None, source: str | None = None, target: str | None = None, repo: str | None = None) -> DataFrame:
    found = of_repo(edges, repo)
    if type:
        found = found.where(F.col("edge_type") == type)
    if source:
        found = found.where(like("source_file", f"%{source}%"))
    return found.where(like("target_file", f"%{target}%")) if target else found


def files_filtered(files: DataFrame, prefix: str | None = None, lang: str | None = None, sort: str = "path", limit: int = 50, repo: str | None = None) -> DataFrame:
    found = of_repo(files, repo)
    if prefix:
        found = found.where(like("path", f"{prefix}%"))
    if lang:
        found = found.where(same("language", lang))
    return (found.orderBy(F.desc("lines"), "path") if sort == "lines" else found.orderBy("path")).limit(limit)


# --- joins


def symbol_callers(symbols: DataFrame, edges: DataFrame, full_name: str, repo: str | None = None) -> DataFrame:
    """Edges into a symbol, imports aside; one row for each symbol of that name the edge reaches."""
    scope, name = scoped(full_name)
    own = of_repo(symbols, repo).where(F.col("name") == name)
    own = (own.where(F.col("scope") == scope) if scope else own).select(F.col("file_path").alias("__file"), "name", F.concat("scope", F.lit("::"), "name").alias("__full"))
    hit = (F.col("target_symbol") == F.col("name")) | F.coalesce(F.col("target_symbol") == F.col("__full"), F.lit(False))
    return of_repo(edges, repo).where(~F.col("edge_type").isin("import", "require")).join(own, (F.col("target_file") == F.col("__file")) & hit).drop("__file", "name", "__full")


def symbol_callees(symbols: DataFrame, edges: DataFrame, full_name: str, repo: str | None = None) -> DataFrame:
    """Edges out of a symbol, of any type."""
    scope, name = scoped(full_name)
    own = of_repo(symbols, repo).where(F.col("name") == name)
    own = (own.where(F.col("scope") == scope) if scope else own).select(F.col("file_path").alias("__file"), "name", F.concat("scope", F.lit("::"), "name").alias("__full"))
    hit = (F.col("source_symbol") == F.col("name")) | F.coalesce(F.col("source_symbol") == F.col("__full"), F.lit(False))
    return of_repo(edges, repo).join(own, (F.col("source_file") == F.col("__file")) & hit).drop("__file", "name", "__full")


def cluster_edges(edges: DataFrame, membership: DataFrame, cluster: str | None = None) -> DataFrame:
    """Between primary clusters: edges in all, and the most frequent type (of equals the first by name)."""
    own = membership.where("is_primary").select("file_path", "cluster_name")
    src = own.select(F.col("file_path").alias("source_file"), F.col("cluster_name").alias("source_cluster"))
    tgt = own.select(F.col("file_path").alias("target_file"), F.col("cluster_name").alias("target_cluster"))
    joined = edges.select("source_file", "target_file", "edge_type").join(src, "source_file").join(tgt, "target_file").where("source_cluster <> target_cluster")
    if cluster:
        joined = joined.where((F.col("source_cluster") == cluster) | (F.col("target_cluster") == cluster))
    typed = joined.groupBy("source_cluster", "target_cluster", "edge_type").agg(F.count("*").alias("n"))
    return typed.groupBy("source_cluster", "target_cluster").agg(F.sum("n").alias("edge_count"), F.min_by("edge_type", F.struct(-F.col("n"), "edge_type")).alias("dominant_type"))


def enclosing_symbol(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (file_path, line) with the least symbol around the line; null where there is none."""
    own = symbols.select(F.col("file_path").alias("__f"), "name", "start_line", "end_line")
    joined = refs.join(own, (F.col("file_path") == F.col("__f")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left")
    best = F.min_by("name", F.struct(F.col("end_line") - F.col("start_line"), "start_line", "name"))
    return joined.groupBy(*refs.columns).agg(best.alias("symbol"))


def first_candidate(refs: DataFrame, files: DataFrame, candidates: Column) -> DataFrame:
    """refs with `target`, the first of an array of candidate paths that is a file; rows without one go."""
    tried = refs.select("*", F.posexplode(candidates).alias("__pos", "__path"))
    return tried.join(files.select(F.col("path").alias("__path")), "__path").groupBy(*refs.columns).agg(F.min_by("__path", "__pos").alias("target"))


def files_with_symbols(files: DataFrame, symbols: DataFrame, without: bool = False) -> DataFrame:
    return files.join(symbols.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti" if without else "left_semi")


def change_classify(old: DataFrame, new: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, status of files by content hash: new, deleted, changed, incomplete (no symbols yet) or unchanged."""
    has = symbols.select(F.col("file_path").alias("path")).distinct().withColumn("__has", F.lit(True))
    joined = old.select("path", F.col("hash").alias("__old")).join(new.select("path", F.col("hash").alias("__new")), "path", "full_outer").join(has, "path", "left")
    status = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "deleted").when(F.col("__old") != F.col("__new"), "changed").when(F.col("__has").isNull(), "incomplete").otherwise("unchanged")
    return joined.select("path", status.alias("status"))


def included_edges(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges with both ends among the paths."""
    own = paths.select("path").distinct()
    return edges.join(own, edges["source_file"] == own["path"], "left_semi").join(own, edges["target_file"] == own["path"], "left_semi")


def kept_symbol_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose symbols, where they have any, are among the kept (file_path, name)."""
    own = kept.select("file_path", "name").distinct()
    s = own.select(F.col("file_path").alias("source_file"), F.col("name").alias("source_symbol"), F.lit(1).alias("__s"))
    t = own.select(F.col("file_path").alias("target_file"), F.col("name").alias("target_symbol"), F.lit(1).alias("__t"))
    joined = edges.join(s, ["source_file", "source_symbol"], "left").join(t, ["target_file", "target_symbol"], "left")
    return joined.where("(source_symbol IS NULL OR __s = 1) AND (target_symbol IS NULL OR __t = 1)").select(*edges.columns)


def scoped_name(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges with `scoped`, the target's name after the scope of the file's first symbol so named."""
    dim = symbols.groupBy(F.col("file_path").alias("target_file"), F.col("name").alias("target_symbol")).agg(F.min_by(F.struct("scope"), F.struct("start_line", "end_line")).alias("__s"))
    joined = edges.join(dim, ["target_file", "target_symbol"], "left")
    return joined.withColumn("scoped", F.when(F.col("__s.scope").isNotNull(), F.concat("__s.scope", F.lit("::"), "target_symbol")).otherwise(F.col("target_symbol"))).drop("__s")


def proximity_boundary(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges that touch a set of paths, and how many of their ends are outside."""
    own = members.select("path").distinct()
    joined = edges.join(own.select(F.col("path").alias("source_file"), F.lit(1).alias("__s")), "source_file", "left").join(own.select(F.col("path").alias("target_file"), F.lit(1).alias("__t")), "target_file", "left")
    return joined.where("__s = 1 OR __t = 1").withColumn("outside", F.expr("int(__s IS NULL) + int(__t IS NULL)")).drop("__s", "__t")


# --- aggregates


def counts(df: DataFrame, *by: str, name: str = "count") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def workspace_list(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    n = counts(files, "repo", name="files").join(counts(symbols, "repo", name="symbols"), "repo", "left")
    crossing = edges.groupBy("repo").agg(F.count("*").alias("edges"), F.count_if(F.col("target_repo") != F.col("repo")).alias("cross_repo_edges"))
    return n.join(crossing, "repo", "left").na.fill(0)


def file_coupling(files: DataFrame, edges: DataFrame, language: str | None = None, verified_only: bool = False) -> DataFrame:
    """path, language, afferent, efferent, instability; neighbours are counted once, loops do not count. Equal files are in
    the order of their paths as a reader expects it, by Unicode collation: a, A, b, e, É, Z."""
    e = edges.where("verifiability <> 'inferred'") if verified_only else edges
    pairs = e.where("source_file <> target_file").select("source_file", "target_file").distinct()
    ca = pairs.groupBy(F.col("target_file").alias("path")).agg(F.count("*").alias("afferent"))
    ce = pairs.groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("efferent"))
    own = files.where(same("language", language)) if language else files
    joined = own.select("path", "language").join(ca, "path", "left").join(ce, "path", "left").na.fill(0, ["afferent", "efferent"])
    return joined.withColumn("instability", F.when(F.expr("afferent + efferent > 0"), F.expr("efferent / (afferent + efferent)")).otherwise(F.lit(0.0))).orderBy(F.desc("instability"), F.desc("afferent"), F.collate("path", "UNICODE"), "path")


def graph_density(files: DataFrame, edges: DataFrame) -> DataFrame:
    n = files.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("m")))
    return n.select(F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(F.lit(0.0)).alias("density"))


def undirected(edges: DataFrame) -> DataFrame:
    """a < b: each pair of files with an edge, once."""
    return edges.where("source_file <> target_file").select(F.least("source_file", "target_file").alias("a"), F.greatest("source_file", "target_file").alias("b")).distinct()


def graph_transitivity(edges: DataFrame) -> DataFrame:
    """Closed over all triplets. Each edge points from the end of less degree, so hubs have few pairs to test."""
    u = cut(undirected(edges))
    degree = u.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    ends = u.join(degree.select(F.col("v").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("v").alias("b"), F.col("d").alias("db")), "b")
    low = F.expr("da < db OR (da = db AND a < b)")
    out = cut(ends.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedge = out.alias("p").join(out.alias("q"), (F.col("p.x") == F.col("q.x")) & (F.col("p.y") < F.col("q.y"))).select(F.col("p.y").alias("a"), F.col("q.y").alias("b"))
    closed = wedge.join(u, ["a", "b"]).agg(F.count("*").alias("t"))
    triplets = degree.agg(F.coalesce(F.sum(F.expr("d * (d - 1) div 2")), F.lit(0)).alias("w"))
    return closed.crossJoin(triplets).select(F.when(F.col("w") > 0, 3 * F.col("t") / F.col("w")).otherwise(F.lit(0.0)).alias("transitivity"), F.col("t").alias("triangles"))


def first_per_key(edges: DataFrame, *key: str, order: tuple[str, ...] = EDGE_ORDER) -> DataFrame:
    """The first edge of each key in a total order."""
    return edges.groupBy(*key).agg(F.min_by(F.struct(*edges.columns), F.struct(*order)).alias("e")).select("e.*")


def edge_rollup(edges: DataFrame) -> DataFrame:
    """One edge for each pair of files: the greatest weight, how many, and the first one's type."""
    order = F.struct(*EDGE_ORDER)
    return edges.groupBy("source_file", "target_file").agg(F.max("weight").alias("weight"), F.count("*").alias("count"), F.min_by("edge_type", order).alias("edge_type"), F.min_by("verifiability", order).alias("verifiability"))


def directory(path: Column | str) -> Column:
    found = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(found == "", "root").otherwise(found)


def dir_rollup(edges: DataFrame) -> DataFrame:
    pairs = edges.select("source_file", "target_file").distinct().select(directory("source_file").alias("source_dir"), directory("target_file").alias("target_dir"))
    return counts(pairs.where("source_dir <> target_dir"), "source_dir", "target_dir", name="edges")


def cluster_rollup(files: DataFrame, edges: DataFrame, group: Column) -> DataFrame:
    """File pairs between groups. Files of no pair are `orphans`, those of one are `singulars`, others take `group`."""
    pairs = edges.where("source_file <> target_file").select("source_file", "target_file").distinct()
    degree = pairs.select(F.explode(F.array("source_file", "target_file")).alias("path")).groupBy("path").agg(F.count("*").alias("d"))
    own = files.join(degree, "path", "left").select("path", F.when(F.col("d").isNull(), "orphans").when(F.col("d") == 1, "singulars").otherwise(group).alias("g"))
    s, t = own.select(F.col("path").alias("source_file"), F.col("g").alias("source_group")), own.select(F.col("path").alias("target_file"), F.col("g").alias("target_group"))
    return counts(pairs.join(s, "source_file").join(t, "target_file").where("source_group <> target_group"), "source_group", "target_group", name="edges")


def prefixes(parts: Column, sep: str, last: Column) -> Column:
    """All prefixes of a list of segments, from one segment to `last` of them."""
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(parts, 1, i), sep)))


def top(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def llm_file_summary(symbols: DataFrame) -> DataFrame:
    """A line on each file's symbols: how many, and of which kinds most."""
    n = counts(symbols, "file_path", "kind", name="n")
    ranked = n.withColumn("r", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("n"), "kind")))
    top3 = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", F.concat(F.col("n").cast("string"), F.lit(" "), "kind").alias("s"))))), lambda x: x["s"]), ", ")
    return ranked.groupBy("file_path").agg(F.sum("n").alias("symbols"), top3.alias("kinds"), F.min_by("kind", "r").alias("dominant"))


def symbol_candidates(symbols: DataFrame) -> DataFrame:
    """What a reference may mean: name, kind and file, each once."""
    return symbols.select("name", "kind", "file_path").distinct()


def deleted_files(known: DataFrame, found: DataFrame) -> DataFrame:
    """path of files that were known and are found no more."""
    return known.select("path").join(found.select("path"), "path", "left_anti")


def inserted(table: DataFrame, rows: DataFrame, key: list[str] | None = None, number: str | None = None) -> DataFrame:
    """The table with rows added. With a key, rows take the place of those with the same key, and of rows with one key the
    last by all columns counts; with a number, new rows get numbers after the greatest, in the order of their columns."""
    rows = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns))
    if key:
        rest = [c for c in table.columns if c not in key]
        last = rows.groupBy(*key).agg(F.max(F.struct(*rest)).alias("r")).select(*key, "r.*").select(*table.columns)
        same = [F.col(f"t.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        return table.alias("t").join(last.alias("n"), condition, "left_anti").select(*table.columns).unionByName(last)
    if number:
        rest = [c for c in table.columns if c != number]
        most = table.agg(F.coalesce(F.max(number), F.lit(0)).alias("__most"))
        rows = numbered(rows.select(*rest), "__i", *rest).crossJoin(F.broadcast(most)).withColumn(number, (F.col("__most") + F.col("__i") + 1).cast(table.schema[number].dataType)).select(*table.columns)
    return table.unionByName(rows)


# --- hierarchies


def normal_namespace(ns: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(ns, r"\\", "."), r"^\.|\.$", "")


def namespace_memberships(files: DataFrame) -> DataFrame:
    found = files.select(F.col("path").alias("file_path"), "repo", normal_namespace("namespace").alias("cluster_name"))
    return found.where("cluster_name IS NOT NULL AND cluster_name <> ''").withColumn("is_primary", F.lit(True))


def namespace_clusters(files: DataFrame) -> DataFrame:
    """Namespaces and all their ancestors: name, label, parent_name, depth."""
    parts = F.split("cluster_name", r"\.")
    names = namespace_memberships(files).select("repo", F.explode(prefixes(parts, ".", F.size(parts))).alias("name")).distinct()
    own = F.split("name", r"\.")
    return names.select("repo", "name", F.array_join(own, " / ").alias("label"), F.lit("namespace").alias("source"), _parent(own).alias("parent_name"), (F.size(own) - 1).alias("depth"))


def _parent(parts: Column) -> Column:
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "."))


def dir_file_counts(files: DataFrame, least: int = 2) -> DataFrame:
    """repo, dir, files under each folder prefix; folders of fewer than `least` go."""
    parts = F.split("path", "/")
    rows = files.select("repo", "path", F.explode(prefixes(parts, "/", F.size(parts) - 1)).alias("dir"))
    return rows.groupBy("repo", "dir").agg(F.countDistinct("path").alias("files")).where(F.col("files") >= least)


def directory_clusters(files: DataFrame) -> DataFrame:
    own = F.split("name", r"\.")
    return dir_file_counts(files).select("repo", F.regexp_replace("dir", "/", ".").alias("name")).select("repo", "name", F.array_join(own, " / ").alias("label"), F.lit("directory").alias("source"), _parent(own).alias("parent_name"), F.size(own).alias("depth"))


def directory_memberships(files: DataFrame, primary: DataFrame) -> DataFrame:
    """Files without a primary cluster go to their deepest folder that is one."""
    rest = files.join(primary.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti")
    parts = F.split("path", "/")
    rows = rest.select("path", "repo", F.explode(prefixes(parts, "/", F.size(parts) - 1)).alias("dir"))
    deepest = rows.join(dir_file_counts(files).select("repo", "dir"), ["repo", "dir"]).groupBy("path", "repo").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    return deepest.select(F.col("path").alias("file_path"), "repo", F.regexp_replace("dir", "/", ".").alias("cluster_name"), F.lit(True).alias("is_primary"))


def primary_memberships(files: DataFrame) -> DataFrame:
    by_namespace = namespace_memberships(files)
    return by_namespace.unionByName(directory_memberships(files, by_namespace))


def primary_clusters(files: DataFrame) -> DataFrame:
    """Namespace and folder clusters; of one name, the namespace's."""
    both = namespace_clusters(files).withColumn("__p", F.lit(0)).unionByName(directory_clusters(files).withColumn("__p", F.lit(1)))
    return both.groupBy("repo", "name").agg(F.min_by(F.struct("label", "source", "parent_name", "depth"), "__p").alias("c")).select("repo", "name", "c.*")


def cluster_file_counts(membership: DataFrame) -> DataFrame:
    """Each file counts in its cluster and in every ancestor."""
    parts = F.split("cluster_name", r"\.")
    return counts(membership.select("repo", F.explode(prefixes(parts, ".", F.size(parts))).alias("name")), "repo", "name", name="file_count")


def cluster_tree(clusters: DataFrame) -> DataFrame:
    """Clusters in pre-order, indented by level."""
    parts = F.split("name", r"\.")
    return clusters.select("repo", "name", F.concat(F.repeat(F.lit("  "), F.size(parts) - 1), F.element_at(parts, -1)).alias("line"), parts.alias("__order")).orderBy("repo", "__order").drop("__order")


def cluster_filter(clusters: DataFrame, repo: str | None = None, name: str | None = None, source: str | None = None, parent: str | None = None) -> DataFrame:
    for column, value in (("repo", repo), ("name", name), ("source", source), ("parent_name", parent)):
        clusters = clusters.where(F.col(column) == value) if value is not None else clusters
    return clusters


def clear_clusters(clusters: DataFrame, membership: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without what belongs to a repository."""
    return clusters.where(F.col("repo") != repo), membership.where(F.col("repo") != repo)


def same_set_drop(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidate memberships (cluster_name, file_path) of clusters that equal no existing one as a set."""
    def signed(df: DataFrame) -> DataFrame:
        return df.groupBy("cluster_name").agg(F.md5(F.array_join(F.array_sort(F.collect_set("file_path")), "\n")).alias("sig"))

    new = signed(candidates).join(signed(existing).select("sig").distinct(), "sig", "left_anti")
    return candidates.join(new.select("cluster_name"), "cluster_name", "left_semi")
