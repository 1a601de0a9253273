import pytest
from pyspark.sql import functions as F

from cartomill.functions.languages import compatible, language_of
from cartomill.operators import predicates as P
from cartomill.operators import relational as R
from cartomill.operators.resolve import resolve_symbol

from .fixtures import SYMBOLS, graph, search_symbols


@pytest.mark.parametrize(
    "where, n",
    [
        ({"term": "*"}, 9), ({"term": "*Service"}, 2), ({"term": "get*"}, 1), ({"term": "*Controller*"}, 1), ({"term": "*", "kind": "CLASS"}, 3),
        ({"term": "*Service", "kind": "class"}, 2), ({"term": "*", "kind": "enum"}, 1), ({"term": "userservice", "exact": True}, 1), ({"term": "*", "kind": "constant"}, 1),
        ({"term": "models"}, 2), ({"term": "*models*"}, 0), ({"term": "*", "prefix": "SRC/models"}, 2), ({"term": "App\\Models"}, 0),
    ],
)
def test_symbol_filter(spark, where, n):
    assert R.symbol_filter(search_symbols(spark), **where).count() == n


def test_symbol_pages(spark):
    s = search_symbols(spark)
    assert R.symbol_search(s, limit=3).count() == 3
    assert [r.name for r in R.symbol_search(s, limit=2, offset=1).collect()] == ["UserController", "UserService"]
    assert {r.broadened for r in R.broaden_search(s, "login", "enum").collect()} == {True}
    assert {r.broadened for r in R.broaden_search(s, "login", "method").collect()} == {False}


def test_names_with_scopes(spark):
    s = search_symbols(spark)
    assert R.scoped("A::B::c") == ("A::B", "c") and R.scoped("c") == (None, "c")
    assert R.symbol_by_name(s, "UserService::getUser").first().start_line == 20
    assert R.symbol_by_name(s, "userservice").first() is None


def test_coupling(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d", "call", "inferred")])
    got = [(r.path, r.afferent, r.efferent, r.instability) for r in R.file_coupling(g.files, g.edges).collect()]
    assert got == [("b", 1, 2, 2 / 3), ("a", 1, 1, 0.5), ("c", 1, 1, 0.5), ("d", 1, 0, 0.0)]
    assert {r.path: r.efferent for r in R.file_coupling(g.files, g.edges, verified_only=True).collect()}["b"] == 1


def test_triangle(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert R.graph_density(g.files, g.edges).first().density == 0.5
    assert R.graph_transitivity(g.edges).first().transitivity == 1.0
    one = graph(spark, [], files=["a"])
    assert R.graph_density(one.files, one.edges).first().density == 0 and R.graph_transitivity(one.edges).first().transitivity == 0


def test_clusters(spark):
    ns = ("x/Core.php", "r", "php", 1, 1, "Mapper\\Core")
    g = graph(spark, [], files=[ns, ("src/utils/a.ts", "r", "ts", 1, 1, None), ("src/utils/b.ts", "r", "ts", 1, 1, None), ("top.ts", "r", "ts", 1, 1, None)])
    got = {(r.name, r.source, r.parent_name, r.depth) for r in R.primary_clusters(g.files).collect()}
    assert got == {("Mapper", "namespace", None, 0), ("Mapper.Core", "namespace", "Mapper", 1), ("src", "directory", None, 1), ("src.utils", "directory", "src", 2)}
    members = {r.file_path: r.cluster_name for r in R.primary_memberships(g.files).collect()}
    assert members == {"x/Core.php": "Mapper.Core", "src/utils/a.ts": "src.utils", "src/utils/b.ts": "src.utils"}
    assert {r.name: r.file_count for r in R.cluster_file_counts(R.primary_memberships(g.files)).collect()} == {"Mapper": 1, "Mapper.Core": 1, "src": 2, "src.utils": 2}


def test_paths(spark):
    df = spark.createDataFrame([("src/a/b.ts",), ("src/a/c.test.ts",), ("node_modules/x.js",), ("lib/tests/y.py",)], "path string")
    keep = {r.path for r in df.where(P.included("path", ["src/**", "*.js"], ["node_modules", "**/*.test.ts"])).collect()}
    assert keep == {"src/a/b.ts"}
    assert {r.path for r in df.where(P.is_test_file("path")).collect()} == {"src/a/c.test.ts", "lib/tests/y.py"}
    assert {r.path for r in df.where(P.dir_excluded("path", ["src/a"])).collect()} == {"src/a/b.ts", "src/a/c.test.ts"}


def test_metadata_merge(spark):
    files = spark.createDataFrame([("a", None, {"k": "1", "o": "x"}), ("b", "N", None)], "path string, namespace string, metadata map<string,string>")
    news = spark.createDataFrame([("a", {"k": "2", "namespace": "App"}), ("b", {"z": "3"})], "path string, metadata map<string,string>")
    got = {r.path: (r.namespace, r.metadata) for r in R.merge_file_metadata(files, news).collect()}
    assert got == {"a": ("App", {"k": "2", "o": "x", "namespace": "App"}), "b": ("N", {"z": "3"})}


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("e", "1")], "path string, hash string")
    symbols = spark.createDataFrame([("a",), ("b",)], "file_path string")
    assert {r.path: r.status for r in R.change_classify(old, new, symbols).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "incomplete", "e": "new"}


def test_languages(spark):
    df = spark.createDataFrame([("a.TS", "typescript"), ("b.h", "c"), ("Makefile", None), ("x.unknown", None)], "path string, want string")
    assert df.where(~F.col("want").eqNullSafe(language_of("path"))).count() == 0
    pairs = spark.createDataFrame([("vue", "typescript", True), ("c", "cpp", True), ("java", "python", False), ("Go", "go", True)], "a string, b string, want boolean")
    assert pairs.where(compatible("a", "b") != F.col("want")).count() == 0


def test_resolution(spark):
    g = graph(spark, [], files=[("a.php", "r", "php", 1, 1, None), ("m.php", "r", "php", 1, 1, None), ("m.py", "r", "python", 1, 1, None)])
    symbols = spark.createDataFrame([("m.php", "r", "User", "class", None, 1, 9), ("m.py", "r", "Order", "class", None, 1, 9), ("m.php", "r", "OrderLine", "class", None, 10, 19)], SYMBOLS)
    refs = spark.createDataFrame([("a.php", s) for s in ("User", "App\\Models\\User", "Order", "nothing", "")], "source_file string, symbol string")
    got = {r.symbol: (r.target, r.how) for r in resolve_symbol(refs, symbols, g.files).collect()}
    assert got == {"User": ("m.php", "exact"), "App\\Models\\User": ("m.php", "short"), "Order": ("m.php", "contains"), "nothing": (None, None), "": (None, None)}


def test_empty_tables(spark):
    g = graph(spark, [], files=[("a", "r", "go", 1, 1, None)])
    none = g.files.where("false")
    for out in (R.file_coupling(none, g.edges), R.cluster_edges(g.edges, R.primary_memberships(none)), R.edge_rollup(g.edges), R.llm_file_summary(g.symbols), R.dir_rollup(g.edges), R.cluster_tree(R.primary_clusters(none))):
        assert out.count() == 0
