"""Name and path matching: one place for what counts as a match.

Comparison without case folds ASCII letters only; Spark's and DuckDB's ILIKE fold more.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(c: Column | str) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def folded_text(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _LOWER))


def is_wildcard(term: Column | str) -> Column | bool:
    """Whether a term stands for everything: nothing but white space, or one star."""
    return term.strip() in ("", "*") if isinstance(term, str) else F.regexp_replace(term, r"^\s+|\s+$", "").isin("", "*")


def is_glob(term: Column | str) -> Column | bool:
    return "*" in term or "?" in term if isinstance(term, str) else term.contains("*") | term.contains("?")


def glob_to_like(term: str) -> str:
    """* and ? become % and _; a literal % or _ keeps its meaning as a wildcard."""
    return term.replace("*", "%").replace("?", "_")


def like(c: Column | str, pattern: str) -> Column:
    """LIKE without case; backslashes are ordinary characters."""
    return folded(c).like(folded_text(pattern).replace("\\", "\\\\"))


def same(c: Column | str, value: str) -> Column:
    return folded(c) == folded_text(value)


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ** crosses folders, * and ? do not; braces and classes work."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{" and "}" in glob[i:]:
            j = glob.index("}", i)
            out, i = out + "(?:" + "|".join(map(glob_regex_part, glob[i + 1 : j].split(","))) + ")", j + 1
        elif c == "[" and "]" in glob[i:]:
            j = glob.index("]", i)
            out, i = out + glob[i : j + 1].replace("[!", "[^"), j + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


def glob_regex_part(glob: str) -> str:
    return glob_regex(glob)


def path_matches(path: Column | str, globs: list[str]) -> Column:
    """The path matches a glob as a whole, or one of its segments is the glob's very text."""
    path = F.col(path) if isinstance(path, str) else path
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(f"^{glob_regex(g)}$") | F.array_contains(F.split(path, "/"), g)
    return found


def included(path: Column | str, include: list[str], exclude: list[str]) -> Column:
    """Excludes win; without includes everything is included."""
    return (path_matches(path, include) if include else F.lit(True)) & ~path_matches(path, exclude)


def dir_excluded(path: Column | str, patterns: list[str]) -> Column:
    """The folder itself, what is below it, or a segment of its name."""
    path = F.col(path) if isinstance(path, str) else path
    found = F.lit(False)
    for p in patterns:
        found = found | path.rlike(f"^{glob_regex(p)}$") | F.concat(path, F.lit("/")).rlike(f"^{glob_regex(p.rstrip('/') + '/**')}$") | F.array_contains(F.split(path, "/"), p)
    return found


def matches_symbol(node: Column, edge: Column) -> Column:
    """Unknown on either side, equal, or the node's name without its scope."""
    return node.isNull() | edge.isNull() | (node == edge) | (F.split_part(node, F.lit("::"), F.lit(2)) == edge)


#: Fixed pattern of test files.
TEST_FILE = r"\.(test|spec)\.[a-z]+$|/[tT][eE][sS][tT][sS]?/|__tests__"


def is_test_file(path: Column | str) -> Column:
    return (F.col(path) if isinstance(path, str) else path).rlike(TEST_FILE)
