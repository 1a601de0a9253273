"""The languages, their file extensions, and which may refer to each other."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each language; of one extension, the first language counts.
EXTENSIONS = {
    "php": ".php .phtml .php3 .php4 .php5 .php7",
    "javascript": ".js .mjs .cjs .jsx",
    "typescript": ".ts .cts .mts",
    "tsx": ".tsx",
    "python": ".py",
    "go": ".go",
    "rust": ".rs",
    "java": ".java",
    "c-sharp": ".cs",
    "ruby": ".rb",
    "c": ".c .h",
    "cpp": ".cpp .hpp .cc .cxx .hh",
    "swift": ".swift",
    "kotlin": ".kt .kts",
    "svelte": ".svelte",
    "vue": ".vue",
    "lua": ".lua",
    "elixir": ".ex .exs",
    "zig": ".zig",
    "bash": ".sh .bash",
    "pascal": ".pas .pp",
    "dart": ".dart",
    "scala": ".scala .sc",
}
# Groups of languages whose symbols may refer to each other.
COMPATIBLE = ("javascript typescript tsx vue svelte astro", "c cpp c++ objective-c objective-cpp", "java kotlin scala groovy")


def extension_map(user: dict[str, list[str]] | None = None) -> dict[str, str]:
    out: dict[str, str] = {}
    for language, extensions in chain(((k, v.split()) for k, v in EXTENSIONS.items()), (user or {}).items()):
        for e in extensions:
            out.setdefault(e, language)
    return out


def language_of(path: Column | str, user: dict[str, list[str]] | None = None) -> Column:
    """By the last extension; null for others. A constant map: no join."""
    table = F.create_map(*(F.lit(x) for kv in extension_map(user).items() for x in kv))
    return F.try_element_at(table, F.concat(F.lit("."), F.lower(F.element_at(F.split(path, r"\."), -1))))


def group_of(language: Column | str) -> Column:
    table = {name: group.split()[0] for group in COMPATIBLE for name in group.split()}
    own = F.lower(language)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), own), own)


def compatible(a: Column | str, b: Column | str) -> Column:
    return group_of(a) == group_of(b)
