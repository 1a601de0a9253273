"""Symbols and references of source texts.

Python is read with its own parser, other languages by a lexer and a stack of scopes (lexer.py, declarations.py). A backend
of another kind only has to give the same rows. Errors are rows, never exceptions.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .declarations import found
from .lexer import SCRIPT
from .php import php_found
from .ship import ship

# Methods so common that a call of one says little, and names every script has.
COMMON_METHODS = frozenset("save delete find findOrFail create update get all toArray toJson rules handle boot register on off emit once then catch finally toString valueOf call apply bind".split())
BUILTIN_GLOBALS = frozenset("Date Error Map Set Promise Object Array String Number Boolean Function RegExp Symbol JSON Math console Console TypeError RangeError ReferenceError SyntaxError URIError EvalError".split())
# Names of a framework that are not the project's own.
IGNORED_SYMBOLS = {
    "vue-router": frozenset(
        "ref computed reactive watch watchEffect defineComponent setup onMounted onUnmounted onBeforeMount onBeforeUnmount onUpdated onBeforeUpdate"
        " provide inject nextTick defineProps defineEmits defineExpose defineModel defineOptions withDefaults toRef toRefs unref isRef isReactive isProxy"
        " shallowRef shallowReactive readonly markRaw useRoute useRouter createRouter createWebHistory useStore defineStore storeToRefs"
        " useI18n t te tm rt d n useHead useMeta useFetch useAsyncData".split()
    )
}
# What a captured reference is; all others are calls.
REFERENCE_TYPES = {k: k for k in "import require extends implements call instantiation render param_type return_type".split()} | {"import_name": "import"}
# Fixed formats: the signature in a declaration's first line, by kind.
SIGNATURES = {
    "function": r"(?:export\s+)?(?:async\s+)?function\s+\w+[^{]*",
    "method": r"(?:abstract\s+)?(?:private|protected|public)?\s*(?:async\s+)?(?:get\s+|set\s+)?\w+\s*\([^)]*\)(\s*:\s*[^{;]+)?",
    "class": r"(?:export\s+)?(?:abstract\s+)?class\s+\w+[^{]*",
    "interface": r"(?:export\s+)?interface\s+\w+[^{]*",
    "enum": r"(?:export\s+)?enum\s+\w+",
}

ROWS = "path string, repo string, row string, name string, kind string, scope string, signature string, start_line int, end_line int, verifiability string"
def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def reference_type(kind: Column | str) -> Column:
    """REFERENCE_TYPES of a column; unknown kinds are calls."""
    table = F.create_map(*(F.lit(x) for kv in REFERENCE_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.col(kind) if isinstance(kind, str) else kind), F.lit("call"))


def clean_target(name: Column | str, kind: Column | str) -> Column:
    """A target without the quotes around it, where it is imported or required."""
    name, kind = (F.col(c) if isinstance(c, str) else c for c in (name, kind))
    return F.when(kind.isin("import", "require"), F.regexp_replace(name, "^['\"]|['\"]$", "")).otherwise(name)


def ignored_symbols(frameworks: Iterable[str]) -> frozenset[str]:
    """The names that all of these frameworks bring."""
    return frozenset().union(*(IGNORED_SYMBOLS.get(f, ()) for f in frameworks))


def signature(line: str, kind: str, name: str) -> str:
    found = re.search(SIGNATURES[kind], line.strip()) if kind in SIGNATURES else None
    return found.group().strip() if found else name


def generic(text: str, language: str) -> Iterator[tuple]:
    """row, name, kind, scope, signature, start_line, end_line, verifiability of a text."""
    for row, name, kind, *rest in found(text, language):
        if row == "symbol":
            scope, line, start, end = rest
            yield row, name, kind, scope, signature(line, kind, name), start, end, None
        elif not (language in SCRIPT and name in BUILTIN_GLOBALS):
            yield row, name, kind, None, None, rest[0], None, "inferred" if kind == "call" and name in COMMON_METHODS else "verified"


def python(text: str, language: str = "python") -> Iterator[tuple]:
    def walk(node: ast.AST, scope: str | None) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                yield "symbol", child.name, kind, scope, text.splitlines()[child.lineno - 1].strip().rstrip(":"), child.lineno, child.end_lineno, None
                for base in getattr(child, "bases", ()):
                    yield "reference", ast.unparse(base), "extends", None, None, child.lineno, None, "verified"
                yield from walk(child, child.name)
                continue
            if isinstance(child, ast.Assign) and isinstance(node, ast.Module):
                for t in child.targets:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        yield "symbol", t.id, "constant", None, t.id, child.lineno, child.end_lineno, None
            if isinstance(child, ast.Import):
                for a in child.names:
                    yield "reference", a.name, "import", None, None, child.lineno, None, "verified"
            if isinstance(child, ast.ImportFrom):
                yield "reference", "." * child.level + (child.module or ""), "import", None, None, child.lineno, None, "verified"
            if isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    yield "reference", name, "instantiation" if name[:1].isupper() else "call", None, None, child.lineno, None, "inferred" if name in COMMON_METHODS else "verified"
            yield from walk(child, scope)

    yield from walk(ast.parse(text), None)


def php(text: str, language: str = "php", path: str = "") -> Iterator[tuple]:
    """Like generic(), with full names and typed calls (php.py). A reference's scope is the symbol it is in, its signature
    what more is known: the relation, the binding and its class, the way something is dispatched, the facade."""
    for row, name, kind, *rest in php_found(text, path):
        if row == "symbol":
            scope, line, start, end = rest
            yield row, name, kind, scope, signature(line, kind, name), start, end, None
        elif row == "role":
            yield row, name, kind, None, None, rest[0], None, None
        else:
            line, source, detail, sure = rest
            common = kind == "call" and name.rsplit("::", 1)[-1] in COMMON_METHODS
            yield row, name, kind, source, detail, line, None, "inferred" if common else sure or "verified"


def blocks(text: str, tag: str = "script") -> Iterator[tuple[str, int]]:
    """The bodies of all blocks of a tag, and the line before each."""
    for m in re.finditer(rf"<{tag}\b[^>]*>(.*?)</{tag}>", text, re.S):
        yield m.group(1), text.count("\n", 0, m.start(1))


def parsed(text: str, language: str, path: str = "") -> Iterator[tuple]:
    """Rows of one text; what cannot be read gives one row of kind error."""
    try:
        if language in ("vue", "svelte"):
            for body, before in blocks(text):
                for r in generic(body, language):
                    yield (*r[:5], r[5] + before, r[6] + before if r[6] else None, r[7])
        elif language == "php":
            yield from php(text, language, path)
        else:
            yield from {"python": python}.get(language, generic)(text, language)
    except (SyntaxError, ValueError, RecursionError) as e:
        yield "error", str(e)[:200], type(e).__name__, None, None, getattr(e, "lineno", None), None, None


def extract(files: DataFrame, frameworks: Iterable[str] = ()) -> DataFrame:
    """ROWS of files (path, repo, language, text): symbols, references and errors, without the names that the frameworks
    in use bring."""
    ship(files.sparkSession)
    ignored = ignored_symbols(frameworks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cartomill.functions.extract import parsed as read

        names = [c.split()[0] for c in ROWS.split(", ")]
        types = [pa.int32() if c.endswith(" int") else pa.string() for c in ROWS.split(", ")]
        for batch in batches:
            for a in range(0, batch.num_rows, 500):  # a file may have many rows
                files = zip(*(c.to_pylist() for c in batch.slice(a, 500).columns))
                rows = [(path, repo, *r) for path, repo, language, text in files for r in read(text or "", language, path) if r[1] not in ignored]
                columns = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return files.select("path", "repo", "language", "text").mapInArrow(run, ROWS)


def symbols_of(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'symbol'").select(F.col("path").alias("file_path"), "repo", "name", "kind", "scope", "signature", "start_line", "end_line")


def references_of(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'reference'").select(F.col("path").alias("source_file"), "repo", F.col("name").alias("symbol"), F.col("kind").alias("edge_type"), F.col("start_line").alias("line"), "verifiability")


def roles_of(rows: DataFrame) -> DataFrame:
    """path, name, role of the classes that a framework gives a part."""
    return rows.where("row = 'role'").select("path", "name", F.col("kind").alias("role"))


def namespaces_of(rows: DataFrame) -> DataFrame:
    """path, namespace: the first that a file declares."""
    return rows.where("row = 'symbol' AND kind = 'namespace'").groupBy("path").agg(F.min_by("name", "start_line").alias("namespace"))


def in_try(text: str, line: int, start: int, is_python: bool) -> bool:
    """Whether a line lies in a try block that begins after `start`."""
    before = text.split("\n")[max(0, start - 1) : line - 1]
    if is_python:
        depth = lambda s: len(s) - len(s.lstrip())
        block = None
        for s in before:
            if re.search(r"\btry\s*:", s):
                block = depth(s)
            elif block is not None and s.strip() and depth(s) <= block and not re.match(r"\s*(except|finally)\b", s):
                block = None
        lines = text.split("\n")
        return block is not None and line <= len(lines) and depth(lines[line - 1]) > block
    level, block = 0, None
    for s in before:
        for c in s:
            level += (c == "{") - (c == "}")
            if c == "}" and block is not None and level < block:
                block = None
        if re.search(r"\btry\b", s):
            block = level
    return block is not None


def calls_in_try(calls: DataFrame, files: DataFrame) -> DataFrame:
    """file, line of the calls (file, line, start_line) that lie in a try block."""
    from pyspark.sql.functions import pandas_udf

    ship(calls.sparkSession)

    @pandas_udf("boolean")
    def guarded(text: pd.Series, line: pd.Series, start: pd.Series, path: pd.Series) -> pd.Series:
        from cartomill.functions.extract import in_try as f

        return pd.Series([f(t or "", n, s, p.endswith(".py")) for t, n, s, p in zip(text, line, start, path)])

    joined = calls.join(files.select(F.col("path").alias("file"), "text"), "file")
    return joined.where(guarded("text", "line", "start_line", "file")).select("file", "line").distinct()
