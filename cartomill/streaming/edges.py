"""Edges kept up to date: after some files have changed, only references whose answer may be another are resolved again.

A reference is answered by names: its own, the last part of a qualified one, a class and its member, or any name that
contains it. So a definition that comes, goes or moves can only change references whose text is in its name. The index of
a reference is its text; the changed definitions ask for all runs of characters in their names, by one equi-join. What the
join does not meet keeps its edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators.resolve import resolve_symbol
from .incremental import TableSet

SYMBOL = ("file_path", "name", "kind", "scope", "start_line")
#: What a reference is resolved by.
KEY = ("source_file", "symbol")
REFERENCE = (*KEY, "edge_type", "line", "verifiability")


def texts(symbol: Column) -> Column:
    """What of a reference can be in a name: its last part, and of a member its class too."""
    last = F.lower(F.element_at(F.split(symbol, r"\\"), -1))
    owner = F.substring_index(F.substring_index(last, "::", -2), "::", 1)
    return F.array_distinct(F.when(last.contains("::"), F.array(last, owner)).otherwise(F.array(last)))


def runs_of(name: Column) -> Column:
    """All runs of characters of a name, the empty one too: what a reference that it answers can be."""
    n = F.length(name)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.when(k == 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(name, i, k))))))


def touched(references: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """source_file, symbol of the references whose answer may change when the symbols `gone` become the symbols `come`."""
    rows = lambda d: d.select(*SYMBOL)
    differ = rows(gone).exceptAll(rows(come)).union(rows(come).exceptAll(rows(gone)))
    names = differ.select(F.explode(F.array_compact(F.array("name", F.concat("scope", F.lit("::"), "name")))).alias("name")).select(F.lower("name").alias("name")).distinct()
    asked = names.select(F.explode(runs_of(F.col("name"))).alias("text")).distinct()
    index = references.select(*KEY).distinct().select(*KEY, F.explode(texts(F.col("symbol"))).alias("text"))
    return index.join(asked, "text", "left_semi").select(*KEY).distinct()


def resolved(references: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """REFERENCE, target, how of all references, answered or not."""
    return resolve_symbol(references.select(*REFERENCE), symbols, files).select(*REFERENCE, "target", "how")


def changed_edges(old: dict[str, DataFrame], changed: DataFrame, files: DataFrame, symbols: DataFrame, references: DataFrame) -> dict[str, DataFrame]:
    """The tables files (path, language), symbols (SYMBOL) and edges (resolved()) after a change; and `redone`, the
    references that were resolved for it.

    old: these tables before; changed: path of all files that are new, changed or gone; files, symbols, references: what
    the changed files that are still there now hold.
    """
    paths = cut(changed.select("path").distinct())
    of = lambda d, c: d.join(paths.select(F.col("path").alias(c)), c, "left_anti")
    new_files = of(old["files"], "path").unionByName(files.select(*old["files"].columns))
    new_symbols = cut(of(old["symbols"], "file_path").unionByName(symbols.select(*SYMBOL)))
    kept = of(old["edges"], "source_file")
    gone = old["symbols"].join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    again = cut(touched(kept, gone, symbols))
    redo = cut(kept.join(again, list(KEY), "left_semi").select(*REFERENCE).unionByName(references.select(*REFERENCE)))
    edges = kept.join(again, list(KEY), "left_anti").unionByName(resolved(redo, new_symbols, new_files))
    return {"files": new_files, "symbols": new_symbols, "edges": edges, "redone": redo}


def follow(tables: TableSet, read: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges a batch of files (path, language, text; a null text for one that is gone) into the tables.
    read(files) gives the files' symbols and references. A batch that was merged before a restart changes nothing again."""

    def merge(batch: DataFrame, number: int) -> None:
        batch = cut(batch.groupBy("path").agg(F.max_by(F.struct("language", "text"), "at").alias("f")).select("path", "f.*"))
        there = batch.where("text IS NOT NULL")
        symbols, references = map(cut, read(there))
        old = {name: tables.read(name) for name in ("files", "symbols", "edges")}
        with tables.transaction() as t:
            for name, df in changed_edges(old, batch, there, symbols, references).items():
                if name != "redone":
                    t.write(name, df)

    return merge
