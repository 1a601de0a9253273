"""Small graphs with results worked out by hand."""

from __future__ import annotations

import duckdb

from cartomill.sources.graph_tables import Graph

FILES = "path string, repo string, language string, lines long, size_bytes long, namespace string"
SYMBOLS = "file_path string, repo string, name string, kind string, scope string, start_line int, end_line int"
EDGES = "source_file string, target_file string, source_symbol string, target_symbol string, edge_type string, repo string, weight double, verifiability string, target_repo string"


def graph(spark, edges, files=None, symbols=()):
    """edges: (source, target[, type[, verifiability[, source symbol, target symbol]]])."""
    rows = []
    for e in edges:
        s, t, kind, v, a, b = (*e, *(None,) * (6 - len(e)))
        rows.append((s, t, a, b, kind or "call", "r", 1.0, v or "verified", None))
    names = files or sorted({x for e in edges for x in e[:2]})
    own = [(f if isinstance(f, tuple) else (f, "r", "typescript", 10, 100, None)) for f in names]
    return Graph(spark.createDataFrame(own, FILES), spark.createDataFrame(list(symbols), SYMBOLS), spark.createDataFrame(rows, EDGES))


def search_symbols(spark):
    data = [
        ("UserService", "class", None, "src/services/UserService.ts", 10, 100), ("AuthService", "class", None, "src/services/AuthService.ts", 5, 80),
        ("UserController", "class", None, "src/controllers/UserController.ts", 1, 150), ("User", "interface", None, "src/models/User.ts", 1, 50),
        ("getUser", "method", "UserService", "src/services/UserService.ts", 20, 35), ("createUser", "method", "UserService", "src/services/UserService.ts", 40, 60),
        ("login", "method", "AuthService", "src/services/AuthService.ts", 10, 30), ("UserType", "enum", None, "src/models/User.ts", 30, 40),
        ("MAX_RETRIES", "constant", None, "src/services/AuthService.ts", 3, 3),
    ]
    return spark.createDataFrame([(f, "r", n, k, s, a, b) for n, k, s, f, a, b in data], SYMBOLS)


def oracle(sf="sf0.001"):
    con = duckdb.connect()
    for t in ("region", "nation", "part", "orders", "lineitem", "documents", "events"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/{sf}/{t}.parquet')")
    return con
