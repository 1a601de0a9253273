"""Exports of the graph as rows of text, in order: write them with the text sink, or join them on a small graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, numbered
from ..sources.graph_tables import EDGE_ORDER, Graph
from .relational import first_per_key, llm_file_summary

# Fixed values of the drawing: fill by language, line by type of edge, colour by type.
LANGUAGE_COLOURS = {"php": "#8892BF", "javascript": "#F7DF1E", "typescript": "#3178C6", "python": "#3776AB", "go": "#00ADD8", "rust": "#DEA584", "java": "#ED8B00"}
EDGE_STYLES = {
    "import": "solid", "require": "solid", "extends": "bold", "implements": "dashed", "call": "dotted", "instantiation": "dotted", "relation": "bold",
    "route": "solid", "binding": "dashed", "middleware": "dotted", "dispatch": "dashed", "notify": "dotted", "render": "dotted",
}
EDGE_COLOURS = {"relation": "blue", "route": "green", "binding": "purple", "middleware": "orange", "dispatch": "magenta", "notify": "pink", "render": "cyan"}


def looked_up(table: dict[str, str], key: Column | str, default: str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(key) if isinstance(key, str) else key)
    return found if default is None else F.coalesce(found, F.lit(default))


def export_dot(g: Graph, membership: DataFrame | None = None, depth: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """section, line of a GraphViz drawing; one edge for each pair of files and type, the first.

    membership (file_path, cluster_name): files are drawn inside their clusters, which nest by the parts of their names, down
    to `depth` parts; files further down lie in the last. only (path): the files to draw, and the edges among them.
    """
    spark = g.files.sparkSession
    files, edges = g.files, g.edges
    if only is not None:
        own = only.select("path").distinct()
        files = files.join(own, "path", "left_semi")
        edges = edges.join(own, F.col("source_file") == F.col("path"), "left_semi").join(own, F.col("target_file") == F.col("path"), "left_semi")
    head = spark.createDataFrame([(0, [f"{i}"], line) for i, line in enumerate(("digraph Cartomill {", "  newrank=true;", "  rankdir=LR;", "  node [shape=box, style=filled];"))] + [(3, ["0"], "}")], "section int, place array<string>, line string")
    label = F.element_at(F.split("path", "/"), -1)
    node = F.format_string('"%s" [label="%s", fillcolor="%s", fontcolor="white"];', "path", label, looked_up(LANGUAGE_COLOURS, "language", "#CCCCCC"))
    if membership is None:
        nodes = files.select(F.lit(1).alias("section"), F.array("path").alias("place"), F.concat(F.lit("  "), node).alias("line"))
    else:
        parts = F.split("cluster_name", r"\.")
        parts = F.slice(parts, 1, depth) if depth else parts
        placed = files.join(membership.select(F.col("file_path").alias("path"), parts.alias("parts")), "path", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))
        # a cluster's lines lie between its first and last, its files before its children
        inside = placed.select(F.lit(1), F.concat("parts", F.array(F.lit("\x02"), "path")), F.concat(F.repeat(F.lit("  "), F.size("parts") + 1), node))
        every = placed.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda i: F.slice("parts", 1, i))).alias("parts")).where("size(parts) > 0").distinct()
        pad = F.repeat(F.lit("  "), F.size("parts"))
        lines = F.array(
            F.struct(F.lit("\x010").alias("at"), F.concat(pad, F.lit('subgraph "cluster_'), F.regexp_replace(F.array_join("parts", "."), "[^a-zA-Z0-9]", "_"), F.lit('" {')).alias("line")),
            F.struct(F.lit("\x011").alias("at"), F.concat(pad, F.lit('  label="'), F.array_join("parts", " / "), F.lit('";')).alias("line")),
            F.struct(F.lit("\x012").alias("at"), F.concat(pad, F.lit("  color=gray;")).alias("line")),
            F.struct(F.lit("\x013").alias("at"), F.concat(pad, F.lit("  style=dashed;")).alias("line")),
            F.struct(F.lit("\uffff").alias("at"), F.concat(pad, F.lit("}")).alias("line")),
        )
        nodes = inside.union(every.select("parts", F.explode(lines).alias("l")).select(F.lit(1), F.concat("parts", F.array("l.at")), "l.line"))
    first = first_per_key(edges, "source_file", "target_file", "edge_type")
    style = F.when(F.col("verifiability") == "inferred", "dashed").otherwise(looked_up(EDGE_STYLES, "edge_type", "solid"))
    colour = looked_up(EDGE_COLOURS, "edge_type")
    links = first.select(F.lit(2), F.array("source_file", "target_file", "edge_type"), F.format_string('  "%s" -> "%s" [label="%s", style=%s%s];', "source_file", "target_file", "edge_type", style, F.coalesce(F.concat(F.lit(', color="'), colour, F.lit('"')), F.lit(""))))
    return head.union(nodes).union(links).orderBy("section", "place", "line").select("section", "line")


def export_json(g: Graph, clusters: DataFrame | None = None, membership: DataFrame | None = None) -> DataFrame:
    """section, json: a summary and one document for each file, symbol and edge, and each cluster and membership, if given."""
    n = [d.agg(F.count("*").alias(k)) for d, k in ((g.files, "files"), (g.symbols, "symbols"), (g.edges, "edges"))]
    parts = [n[0].crossJoin(n[1]).crossJoin(n[2]).select(F.lit("summary").alias("section"), F.to_json(F.struct("files", "symbols", "edges")).alias("json"))]
    for name, d in (("file", g.files), ("symbol", g.symbols), ("edge", g.edges), ("cluster", clusters), ("membership", membership)):
        if d is None:
            continue
        parts.append(d.select(F.lit(name), F.to_json(F.struct(*d.columns))))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def toon_quoted(value: Column | str, delimiter: str = ",") -> Column:
    """A value in quotes where it could be read as something else."""
    v = F.col(value) if isinstance(value, str) else value
    needs = (
        (v == "") | v.rlike(r"^\s|\s$") | v.isin("true", "false", "null") | v.rlike(r"^-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")
        | v.rlike(r'[:"\\\[\]{}\x00-\x1F\x7F-\x9F]') | (v == "-") | v.rlike(r"^-\S") | v.contains(delimiter)
    )
    escaped = v
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return F.when(needs, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(v)


def fitted(lines: DataFrame, budget: int, *order) -> DataFrame:
    """The first lines that together take at most `budget` tokens of four bytes, by a running sum. A line takes a byte at
    least, so the sum runs over the first 4 * budget lines, which each task picks from its own first."""
    size = F.sum(F.octet_length("line") + 1).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.orderBy(*order).limit(4 * max(0, budget)).withColumn("__n", size).where(F.ceil(F.col("__n") / 4) <= budget).drop("__n")


def plain_number(value: Column) -> Column:
    """At most six digits after the point, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def toon_rows(delimiter: str, *columns: Column) -> Column:
    return F.concat(F.lit("  "), F.array_join(F.array(*columns), delimiter))


def toon_parts(g: Graph, file_ranks: DataFrame, symbol_ranks: DataFrame, clusters: DataFrame | None, delimiter: str) -> dict[str, DataFrame]:
    """files, symbols and clusters as place (from 0), line; edges as need, place, line, where need is how many symbols must
    be there for both its ends (null: no number is enough)."""
    quoted = lambda c: toon_quoted(F.coalesce(F.col(c).cast("string"), F.lit("")), delimiter)
    many = g.symbols.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n"))
    files = g.files.join(file_ranks.select("path", "pagerank"), "path", "left").join(many, "path", "left").na.fill(0.0, ["pagerank"])
    files = numbered(files.select("path", "language", F.coalesce("n", F.lit(0)).alias("n"), "pagerank"), "place", F.desc("pagerank"), "path")
    files = files.select("place", toon_rows(delimiter, quoted("path"), quoted("language"), F.col("n").cast("string"), plain_number(F.col("pagerank"))).alias("line"))
    symbols = g.symbols.join(symbol_ranks.groupBy("file_path", "name").agg(F.max("pagerank").alias("pagerank")), ["file_path", "name"], "left").na.fill(0.0, ["pagerank"])
    symbols = numbered(symbols.select("file_path", "name", "kind", "scope", "start_line", "pagerank"), "place", F.desc("pagerank"), "file_path", "name", "start_line", "kind")
    named = symbols.select(F.col("file_path").alias("file"), F.explode(F.array_compact(F.array("name", F.concat("scope", F.lit("::"), "name")))).alias("symbol"), "place").groupBy("file", "symbol").agg(F.min("place").alias("at"))
    ends = numbered(g.edges.select(*EDGE_ORDER), "place", *EDGE_ORDER)
    for side in ("source", "target"):
        own = named.select(F.col("file").alias(f"{side}_file"), F.col("symbol").alias(f"{side}_symbol"), (F.col("at") + 1).alias(f"{side}_need"))
        ends = ends.join(own, [f"{side}_file", f"{side}_symbol"], "left")
        ends = ends.withColumn(f"{side}_need", F.when(F.coalesce(F.col(f"{side}_symbol"), F.lit("")) == "", F.lit(0).cast("long")).otherwise(F.col(f"{side}_need")))
    edges = ends.select(
        F.when(F.col("source_need").isNotNull() & F.col("target_need").isNotNull(), F.greatest("source_need", "target_need")).alias("need"), "place",
        toon_rows(delimiter, *map(quoted, ("source_file", "target_file", "edge_type", "source_symbol", "target_symbol")), plain_number(F.coalesce("weight", F.lit(1.0)))).alias("line"),
    )
    parts = {"files": files, "symbols": symbols.select("place", toon_rows(delimiter, *map(quoted, ("name", "kind", "file_path", "scope")), plain_number(F.col("pagerank"))).alias("line")), "edges": edges}
    if clusters is not None:
        own = numbered(clusters, "place", "source", "name")
        parts["clusters"] = own.select("place", toon_rows(delimiter, *map(quoted, ("name", "source", "parent_name")), F.col("depth").cast("string"), F.col("file_count").cast("string")).alias("line"))
    return {k: cut(d) for k, d in parts.items()}


def export_toon(g: Graph, file_ranks: DataFrame, symbol_ranks: DataFrame, clusters: DataFrame | None = None, budget: int = 8192, delimiter: str = ",", repo: str = "all", generated: str = "", files_stay: bool = False) -> DataFrame:
    """section, place, line: a document within a budget of tokens of four bytes: a header, counts and languages, files by
    rank, as many symbols by rank as fit, the edges whose symbols are there, clusters (name, source, parent_name, depth,
    file_count), and what was cut. If it does not fit without any symbol, edges are cut; if not without these, all goes, or,
    with files_stay, all files and clusters are listed over the budget, and nothing else.

    The size of a document is a function of the cut: of prefix sums of bytes, and the digits of counts. It is searched by
    halving, each time with one sum over narrow tables of sizes.
    """
    parts = toon_parts(g, file_ranks, symbol_ranks, clusters, delimiter)
    spark = g.files.sparkSession
    size = lambda d: tuple(d.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0))).first())
    all_ = {k: size(d) for k, d in parts.items()}
    n_symbols, n_edges = all_["symbols"][0], all_["edges"][0]
    # a language is one of a fixed table
    languages = [r[0] for r in g.files.where("language <> ''").select("language").distinct().orderBy("language").select(toon_quoted("language", delimiter)).collect()]

    def lines(kept: dict[str, tuple[int, int]], edges: int, cut_symbols: bool, cut_edges: bool) -> dict[str, list[str]]:
        """All lines of a document but those of the tables."""
        out = {"head": ["version: 1", f"generated: {generated}", f"repo: {repo}", f"tokenBudget: {budget}", "", "summary:", f"  files: {kept['files'][0]}", f"  symbols: {n_symbols}", f"  edges: {edges}"], "foot": []}
        if kept["files"][0] and languages:
            out["head"].append(f"  languages[{len(languages)}]: {delimiter.join(languages)}")
        out["head"].append("")
        for name, columns in TOON_COLUMNS.items():
            if kept.get(name, (0,))[0]:
                out[name] = [f"{name}[{kept[name][0]}]{{{columns}}}:", ""]
        if cut_symbols:
            out["foot"] = ["truncated: true", "truncatedAt: symbols", f"includedSymbols: {kept['symbols'][0]}", f"totalSymbols: {n_symbols}"]
            if cut_edges:
                out["foot"] += ["edgesTruncated: true", f"includedEdges: {kept['edges'][0]}", f"totalEdges: {edges}"]
        return out

    def fits(kept: dict[str, tuple[int, int]], *what) -> bool:
        own = sum(len(x.encode()) + 1 for part in lines(kept, *what).values() for x in part)
        return -(-(own + sum(b for _, b in kept.values()) - 1) // 4) <= budget

    def most(upper: int, kept: Callable[[int], dict], what: Callable[[int], tuple]) -> int | None:
        low, high, best = 0, upper, None
        while low <= high:
            m = (low + high) // 2
            if fits(kept(m), *what(m)):
                low, best = m + 1, m
            else:
                high = m - 1
        return best

    whole = {k: v for k, v in all_.items() if k in ("files", "clusters")}
    some_symbols = lambda m: whole | {"symbols": size(parts["symbols"].where(F.col("place") < m)), "edges": size(parts["edges"].where(F.col("need") <= m))}
    some_edges = lambda k: whole | {"symbols": (0, 0), "edges": size(parts["edges"].where((F.col("need") == 0) & (F.col("place") < k)))}
    rows = {k: parts[k] for k in whole}
    if (m := most(n_symbols, some_symbols, lambda m: (n_edges, m < n_symbols, False))) is not None:
        fixed = lines(some_symbols(m), n_edges, m < n_symbols, False)
        rows |= {"symbols": parts["symbols"].where(F.col("place") < m), "edges": parts["edges"].where(F.col("need") <= m)}
    elif (k := most(n_edges, some_edges, lambda k: (k, True, k < n_edges))) is not None:
        fixed = lines(some_edges(k), k, True, k < n_edges)
        rows["edges"] = parts["edges"].where((F.col("need") == 0) & (F.col("place") < k))
    elif files_stay:
        fixed = lines(whole, n_edges, False, False)
    else:
        fixed, rows = lines({"files": (0, 0), "symbols": (0, 0), "edges": (0, 0)}, 0, True, False), {}
    order = ["head", *TOON_COLUMNS, "foot"]
    own = []
    for name, part in fixed.items():
        ends = [(order.index(name), -1, part[0]), (order.index(name), 1 << 62, part[1])] if name in TOON_COLUMNS else [(order.index(name), i, x) for i, x in enumerate(part)]
        own += ends
    last = max(own)
    if last[2] == "":
        own.remove(last)  # no line end at the document's
    out = spark.createDataFrame(own, "section int, place long, line string")
    for name, part in rows.items():
        out = out.unionByName(part.select(F.lit(order.index(name)).alias("section"), F.col("place").cast("long").alias("place"), "line"))
    return out.orderBy("section", "place")


# The tables of a document, and their columns.
TOON_COLUMNS = {"files": "path,language,symbols,pagerank", "symbols": "name,kind,file,scope,pagerank", "edges": "sourceFile,targetFile,edgeType,sourceSymbol,targetSymbol,weight", "clusters": "name,source,parentName,depth,fileCount"}


def llm_dependencies(edges: DataFrame) -> DataFrame:
    """file, line: each file's dependencies once each, `[inferred]` where they are."""
    first = first_per_key(edges, "source_file", "target_file", "edge_type")
    item = F.concat("target_file", F.lit(" ("), "edge_type", F.lit(")"), F.when(F.col("verifiability") == "inferred", " [inferred]").otherwise(""))
    return first.groupBy(F.col("source_file").alias("file")).agg(F.array_join(F.array_sort(F.collect_list(item)), ", ").alias("line"))


def export_llm(g: Graph, ranks: DataFrame, budget: int = 8192) -> DataFrame:
    """section, line: files by rank (path, pagerank) with a summary of their symbols and dependencies, within a budget."""
    info = llm_file_summary(g.symbols).select(F.col("file_path").alias("path"), "kinds")
    rows = g.files.join(ranks.select("path", "pagerank"), "path", "left").join(info, "path", "left").join(llm_dependencies(g.edges).withColumnRenamed("file", "path"), "path", "left")
    text = F.concat(F.lit("- "), "path", F.lit(" ["), "language", F.lit("] "), F.coalesce("kinds", F.lit("no symbols")), F.coalesce(F.concat(F.lit(" -> "), "line"), F.lit("")))
    return fitted(rows.select(F.lit(1).alias("section"), (-F.coalesce("pagerank", F.lit(0.0))).alias("key"), text.alias("line")), budget, "key", "line").select("section", "line")


def llm_symbol_cap(budget: int) -> int:
    """Lines of about forty characters."""
    return budget * 4 // 40


def llm_route_groups(routes: DataFrame) -> DataFrame:
    """source, controller, routes: each address with its verbs. routes: source, controller, uri, verb."""
    verbs = routes.groupBy("source", "controller", "uri").agg(F.array_join(F.array_sort(F.collect_set("verb")), "/").alias("verbs"))
    return verbs.groupBy("source", "controller").agg(F.array_join(F.array_sort(F.collect_list(F.concat("verbs", F.lit(" "), "uri"))), ", ").alias("routes"))


def export_svg(g: Graph, ranks: DataFrame, columns: int = 6, width: int = 180, height: int = 60) -> DataFrame:
    """line: cards of the files on a grid, by rank, and lines between them."""
    own = numbered(g.files.join(ranks.select("path", "pagerank"), "path", "left").na.fill(0.0, ["pagerank"]), "i", F.desc("pagerank"), "path")
    at = own.select("path", "language", (F.col("i") % columns * (width + 20) + 10).alias("x"), (F.floor(F.col("i") / columns) * (height + 20) + 10).alias("y"))
    safe = F.col("path")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    cards = at.select(F.lit(2).alias("z"), F.format_string('<g><rect x="%d" y="%d" width="%d" height="%d" fill="%s"/><text x="%d" y="%d">%s</text></g>', F.col("x").cast("int"), F.col("y").cast("int"), F.lit(width), F.lit(height), looked_up(LANGUAGE_COLOURS, "language", "#CCCCCC"), (F.col("x") + 8).cast("int"), (F.col("y") + 24).cast("int"), safe).alias("line"))
    s, t = at.select(F.col("path").alias("source_file"), F.col("x").alias("x1"), F.col("y").alias("y1")), at.select(F.col("path").alias("target_file"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    links = g.edges.select("source_file", "target_file").distinct().join(s, "source_file").join(t, "target_file").select(F.lit(1), F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d" stroke="#999"/>', *(F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2"))))
    frame = g.files.sparkSession.createDataFrame([(0, '<svg xmlns="http://www.w3.org/2000/svg">'), (3, "</svg>")], "z int, line string")
    return frame.union(links).union(cards).orderBy("z", "line").select("line")
