"""Declarations and references by lexer: what misleads patterns, and work that grows with the text."""

import time

import pytest

from cartomill.functions.declarations import found
from cartomill.functions.extract import parsed
from cartomill.plans.language_queries import SAMPLES


def symbols(text, language):
    return [(r[1], r[2], r[3]) for r in found(text, language) if r[0] == "symbol"]


def references(text, language):
    return [(r[1], r[2]) for r in found(text, language) if r[0] == "reference"]


def test_comments_strings_and_regular_expressions():
    assert references("// new Ghost();\n/* call() */ run();", "typescript") == [("run", "call")]
    assert symbols('const s = "class Ghost { m() {} }"; class A {}', "typescript") == [("A", "class", None)]
    text = "class A {\n  m() { return /x{/.test(1); }\n}\nfunction top() {}\n"
    assert symbols(text, "javascript") == [("A", "class", None), ("m", "method", "A"), ("top", "function", None)]
    assert symbols("class A { one() { return 1; } two() { return `${{}}}`; } }\nfunction f() {}", "typescript") == [("A", "class", None), ("one", "method", "A"), ("two", "method", "A"), ("f", "function", None)]
    assert references("x = a / b; y = /c(d/.test(e) / f(1);", "javascript") == [("test", "call"), ("f", "call")]


def test_scope_of_an_implementation():
    assert symbols("impl Foo { fn a() {} }\nimpl<T> Bar for Baz<T> { fn b() {} }", "rust") == [("Foo", "class", None), ("a", "method", "Foo"), ("Baz", "class", None), ("b", "method", "Baz")]


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_samples(language):
    _, text, want_symbols, want_references = SAMPLES[language]
    text, fill = text.replace("%C", "Thing").replace("%k", "thing"), lambda v: v and v.replace("%C", "Thing").replace("%k", "thing")
    rows = list(parsed(text, language))
    assert [(r[1], r[2], r[3], r[5], r[6]) for r in rows if r[0] == "symbol"] == [(fill(n), k, fill(s), a, b) for n, k, s, a, b in want_symbols]
    assert [(r[1], r[2], r[5]) for r in rows if r[0] == "reference"] == [(fill(n), k, a) for n, k, a in want_references]


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_broken_text_gives_rows_and_no_error(language):
    """Any cut of a text can be read, and ends within it."""
    text = SAMPLES[language][1].replace("%C", "Thing").replace("%k", "thing")
    for cut in range(0, len(text), 7):
        for part in (text[:cut], text[cut:]):
            rows = list(parsed(part, language))
            assert not [r for r in rows if r[0] == "error"], (part, rows)
            assert all(r[5] <= (r[6] or r[5]) <= part.count("\n") + 1 for r in rows)


@pytest.mark.parametrize("language", ["typescript", "java", "go", "ruby", "php", "elixir", "lua", "cpp", "pascal"])
def test_work_grows_with_the_text(language):
    text = SAMPLES.get(language, (0, "<?php class %C { function f() { g('x'); } }\n"))[1].replace("%C", "Thing").replace("%k", "thing")
    took = []
    for times in (40, 160):
        began = time.process_time()
        list(found(text * times, language))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.1  # four times the text


def test_texts_are_dealt_to_all_cores(spark, tmp_path):
    """A table in one file and one row group is one task to read, but its texts are many tasks' work."""
    from cartomill.plans.language_queries import _files, _laravel_files

    spark.range(40).selectExpr("id AS p_partkey", "'red box' AS p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for files in (_files(spark, str(tmp_path), "src/%k.go", "package main\n", "go"), _laravel_files(spark, str(tmp_path))):
        sizes = files.rdd.glom().map(len).collect()
        assert sum(size > 0 for size in sizes) == spark.sparkContext.defaultParallelism


def test_only_laravel_files_with_typed_calls_are_followed():
    from cartomill.functions.laravel import _File

    plain = _File("<?php\nclass A { public function b($c) { $c->d(); } }\n", "app/A.php").read()
    assert not plain.rows and [f[:2] for f in plain.facts()] == [("class", "A")]
    sent = _File("<?php\nclass A { public function b() { event(new C()); } }\n", "app/A.php").read()
    assert ("dispatch", "event", "C") in [f[:3] for f in sent.facts()]
    heard = _File("<?php\nclass A { public function handle(C $c) {} }\n", "app/Listeners/A.php").read()
    assert ("listen", "C", "A") in [f[:3] for f in heard.facts()]
