"""The code graph's tables, and the graph derived from order tables that the queries run on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut, dropped

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "map": T.MapType(T.StringType(), T.StringType())}


def _schema(text: str) -> T.StructType:
    """Columns as `name type`, with ! after the type of those that are never null."""
    return T.StructType([T.StructField(n, _TYPES[t.rstrip("!")], not t.endswith("!")) for n, t in (c.split() for c in text.split(","))])


FILES = _schema("path string!, repo string!, language string!, git_blob_hash string, content_hash string, last_scanned timestamp, size_bytes long, lines long, metadata map, namespace string")
SYMBOLS = _schema("id long!, file_path string!, repo string!, name string!, kind string!, scope string, signature string, start_line int, end_line int, metadata map")
EDGES = _schema("id long!, source_file string!, target_file string!, source_symbol string, target_symbol string, edge_type string!, repo string!, target_repo string, weight double, verifiability string, metadata map")

#: The kinds of symbols and edges.
SYMBOL_KINDS = "class method function interface trait constant enum property namespace struct module field".split()
DATA_EDGES = "call instantiation param_type return_type relation dispatch notify route render".split()
STRUCTURAL_EDGES = "import require extends implements binding middleware".split()
UNTRACED_EDGES = "hook graphql_resolver message_handler websocket_handler".split()
FRAMEWORK_EDGES = "route middleware hook graphql_resolver message_handler websocket_handler".split()

G_FILES = """
SELECT concat('src/', lower(p_type), '/', lower(replace(p_brand, '#', '_')), '/', replace(p_name, ' ', '_'), '_',
              CAST(p_partkey AS VARCHAR(20)), CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.php' ELSE '.go' END) AS path,
       p_partkey AS file_id,
       concat('repo_', CAST(p_partkey % 2 AS VARCHAR(20))) AS repo,
       CASE p_partkey % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'php' ELSE 'go' END AS language,
       p_size * 10 AS lines, CAST(round(p_retailprice * 100) AS BIGINT) AS size_bytes,
       CASE WHEN p_partkey % 4 = 2 THEN concat('App', chr(92), p_type, chr(92), replace(p_brand, '#', '')) END AS namespace
FROM part"""
G_SYMBOLS = """
SELECT f.path AS file_path, f.repo, replace(p.p_name, ' ', '') AS name, 'class' AS kind, CAST(NULL AS VARCHAR(20)) AS scope,
       1 AS start_line, f.lines AS end_line
FROM g_files f JOIN part p ON p.p_partkey = f.file_id
UNION ALL
SELECT DISTINCT f.path, f.repo, concat('on', l.l_returnflag, l.l_linestatus), 'method', replace(p.p_name, ' ', ''),
       CASE l.l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 4 ELSE 6 END + CASE l.l_linestatus WHEN 'F' THEN 0 ELSE 1 END,
       CASE l.l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 4 ELSE 6 END + CASE l.l_linestatus WHEN 'F' THEN 0 ELSE 1 END
FROM lineitem l JOIN g_files f ON f.file_id = l.l_partkey JOIN part p ON p.p_partkey = l.l_partkey"""
G_EDGES = """
SELECT s.path AS source_file, t.path AS target_file,
       concat(replace(sp.p_name, ' ', ''), '::on', a.l_returnflag, a.l_linestatus) AS source_symbol,
       CASE WHEN b.l_linestatus = 'F' THEN replace(tp.p_name, ' ', '') ELSE concat('on', b.l_returnflag, b.l_linestatus) END AS target_symbol,
       CASE a.l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN 'import' ELSE 'extends' END AS edge_type,
       s.repo, a.l_quantity AS weight,
       CASE a.l_linestatus WHEN 'F' THEN 'verified' ELSE 'inferred' END AS verifiability,
       CASE WHEN s.repo <> t.repo THEN t.repo END AS target_repo
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
JOIN g_files s ON s.file_id = a.l_partkey JOIN g_files t ON t.file_id = b.l_partkey
JOIN part sp ON sp.p_partkey = a.l_partkey JOIN part tp ON tp.p_partkey = b.l_partkey"""

#: For SQL over the order tables.
WITH = f"WITH RECURSIVE g_files AS ({G_FILES}), g_symbols AS ({G_SYMBOLS}), g_edges AS ({G_EDGES})"

#: The order in which the first of several equal edges is found: the derived graph has no ids.
EDGE_ORDER = ("source_file", "target_file", "edge_type", "source_symbol", "target_symbol", "weight", "verifiability")


@dataclass
class Graph:
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    #: What was computed from them, by name.
    kept: dict[str, DataFrame] = field(default_factory=dict)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_derived: dict[tuple, Graph] = {}


def state(spark: SparkSession, *tables: DataFrame) -> tuple:
    """The files of tables, with their sizes and times: what is derived from them holds as long as these do."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for f in sorted(x for t in tables for x in t.inputFiles()):
        status = path(f).getFileSystem(conf).getFileStatus(path(f))
        found.append((f, status.getLen(), status.getModificationTime()))
    return tuple(found)


def derived_edges(part: DataFrame, lineitem: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of G_EDGES, with less on disk than its joins: lines meet the next ones of their order in one shuffle, as keys
    and flags alone, and a part's name comes with its file. Each step is written, so that its shuffles go before the next."""
    following = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1)
    lines = lineitem.where("l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    after = F.collect_list(F.struct(F.col("l_partkey").alias("next_partkey"), F.col("l_returnflag").alias("next_returnflag"), F.col("l_linestatus").alias("next_linestatus"))).over(following)
    pairs = cut(lines.withColumn("after", after).select("l_partkey", "l_quantity", "l_returnflag", "l_linestatus", F.inline("after")))
    named = cut(files.join(part, F.col("file_id") == F.col("p_partkey")).select("p_partkey", "p_name", "path", "repo"))
    half = cut(pairs.join(named.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey").drop("l_partkey"))
    dropped(pairs)
    whole = half.join(named.toDF("next_partkey", "next_name", "next_path", "next_repo"), "next_partkey").selectExpr(
        "struct(l_quantity, l_returnflag, l_linestatus) AS a", "struct(next_returnflag AS l_returnflag, next_linestatus AS l_linestatus) AS b",
        "struct(path, repo) AS s", "struct(next_path AS path, next_repo AS repo) AS t", "struct(p_name) AS sp", "struct(next_name AS p_name) AS tp",
    )
    edges = cut(part.sparkSession.sql(G_EDGES[: G_EDGES.index("FROM lineitem")] + "FROM {whole}", whole=whole))
    dropped(half, named)
    return edges


def derived(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts as files, line items as methods, consecutive lines of an order as references.

    The three tables are written to the shared folder once for each state of the input, and read from there by all queries
    of the application.
    """
    part, lineitem = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    key = (spark.sparkContext.applicationId, sf_dir, state(spark, part, lineitem))
    if key not in _derived:
        files = cut(spark.sql(G_FILES.replace("FROM part", "FROM {part}"), part=part))

        def run(sql: str) -> DataFrame:
            for name in ("part", "lineitem", "g_files"):
                sql = sql.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
            return cut(spark.sql(sql, **{n: d for n, d in (("part", part), ("lineitem", lineitem), ("g_files", files)) if f"{{{n}}}" in sql}))

        edges = derived_edges(part, lineitem, files)
        _derived[key] = Graph(files, run(G_SYMBOLS), edges)
    return _derived[key]
