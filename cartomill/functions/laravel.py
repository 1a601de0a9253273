"""What single PHP files of a Laravel project say, joined over all files.

Each file gives facts: aliases and groups of middleware, where these are used, prefixes and middleware of route files,
bindings, listeners, and what is dispatched. Which class stands behind a name is known only when all facts are: groups hold
aliases and other groups, and are closed by joins until nothing new is found; then names meet classes, and classes files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import Rounds, cut
from .php import BINDINGS, Php, unread
from .ship import ship

FACTS = "repo string, path string, fact string, key string, value string, kind string, source string, line int"
#: Properties that name middleware, and what they say.
_NAMED = {"$middlewareAliases": "alias", "$routeMiddleware": "alias", "$middlewareGroups": "group"}


#: Calls that send or bind something.
_MEANT = BINDINGS | {"event", "notify", "notifyNow", "send", "sendNow", "when"}


class _File(Php):
    def followed(self) -> bool:
        """Only sent and bound classes, and what a listener handles, come from typed calls."""
        return "/Listeners/" in "/" + self.path_name or any(w in _MEANT or w.startswith("dispatch") for w in self.words)

    def item(self, j: int) -> tuple[str, str] | None:
        """class or name, and which: X::class, or a text without what follows its colon."""
        if self.word(j) and self.at(j + 1) == "::" and self.word(j + 2) == "class":
            return "class", self.full(self.word(j))
        text = self.string(j)
        if not text:
            return None
        text = text.replace("\\\\", "\\")
        return ("class", text.lstrip("\\")) if "\\" in text else ("name", text.split(":")[0])

    def items(self, j: int) -> Iterator[tuple[str, str, int]]:
        """Those of the list at j, or the one at j."""
        if self.at(j) in ("[", "("):
            k = j + 1
            while k < self.close[j]:
                found = self.item(k)
                if found and self.at(k - 1) in ("[", "(", ","):
                    yield (*found, k)
                k = self.close[k] + 1 if self.at(k) in ("[", "(", "{") else k + 1
        elif found := self.item(j):
            yield (*found, j)

    def pairs(self, j: int) -> Iterator[tuple[str, int]]:
        """key, and where the value begins, of the array at j."""
        k = j + 1
        while k < self.close[j]:
            if self.at(k) == "=>":
                key = self.item(k - 1) or (self.item(k - 3) if self.word(k - 1) == "class" else None)
                if key:
                    yield key[1], k + 1
            k = self.close[k] + 1 if self.at(k) in ("[", "(", "{") else k + 1

    def facts(self) -> Iterator[tuple]:
        """fact, key, value, kind of the value, source symbol, token."""
        methods = [(s.start, s.end, s.name) for s in self.symbols if s.kind in ("method", "function")]
        owner = lambda i: next((name for a, b, name in methods if a <= i <= b), None)
        for s in self.symbols:
            if s.kind in ("class", "interface", "trait", "enum"):
                yield "class", self.full(s.name), s.name, "", None, s.start
        for i, w in enumerate(self.words):
            if not w:
                continue
            if w in _NAMED and self.at(i + 1) == "=" and self.at(i + 2) == "[":
                yield from self.named_middleware(i + 2, _NAMED[w])
            elif w == "$listen" and self.at(i + 1) == "=" and self.at(i + 2) == "[":
                for event, j in self.pairs(i + 2):
                    for kind, listener, k in self.items(j):
                        yield "listen", event, listener, kind, None, k
            elif w == "alias" and self.at(i - 1) == "->" and self.word(i - 2) == "$middleware" and self.at(i + 2) == "[":
                yield from self.named_middleware(i + 2, "alias")
            elif w in ("group", "appendToGroup", "prependToGroup") and self.at(i - 1) == "->" and self.word(i - 2) == "$middleware" and self.string(i + 2):
                for kind, value, k in self.items(i + 4):
                    yield "group", self.string(i + 2), value, kind, None, k
            elif w == "middleware" and self.at(i + 1) == "(" and self.at(i - 1) in ("->", "::"):
                target = self.routed(i)
                for kind, value, k in self.items(i + 2 if self.at(i + 2) == "[" else i + 1):
                    yield ("wrap" if target else "use"), target or "", value, kind, owner(i), k
            elif w == "prefix" and self.at(i + 1) == "(" and self.at(i - 1) in ("->", "::") and (target := self.routed(i)) and self.string(i + 2):
                yield "prefix", target, self.string(i + 2).strip("/"), "name", owner(i), i
            elif w == "listen" and self.at(i - 1) == "::" and self.word(i - 2) == "Event" and (event := self.item(i + 2)):
                for kind, listener, k in self.items(next((x for x in range(i + 2, self.close[i + 1]) if self.at(x) == ","), i) + 1):
                    yield "listen", event[1], listener, kind, owner(i), k
        for s in self.symbols:  # a listener is found by what it handles
            if s.kind == "method" and s.name == "handle" and s.scope and "/Listeners/" in "/" + self.path_name:
                for row in self.rows:
                    if row[1] == "param_type" and s.start <= row[4] <= s.end:
                        yield "listen", row[0], self.full(s.scope), "class", "handle", s.start
                        break
        for name, kind, source, detail, i, _ in self.rows:
            if kind == "dispatch":
                yield "dispatch", (detail or "").rsplit(": ", 1)[-1], name, "class", source, i
            elif kind == "notify":
                yield "dispatch", "notification", name, "class", source, i
            elif kind == "binding":
                how, concrete, _ = detail.split(": ", 2)
                yield "binding", name, concrete, how, source, i

    def named_middleware(self, j: int, fact: str) -> Iterator[tuple]:
        for key, k in self.pairs(j):
            for kind, value, x in self.items(k):
                yield fact, key, value, kind, None, x

    def routed(self, i: int) -> str | None:
        """The route file that the chain around i loads: group(base_path('routes/api.php'))."""
        j = self.close[i + 1] + 1
        while self.at(j) == "->" and self.at(j + 2) == "(":
            if self.word(j + 1) == "group" and self.word(j + 3) == "base_path":
                return self.string(j + 5)
            j = self.close[j + 2] + 1
        return None


def facts(files: DataFrame) -> DataFrame:
    """FACTS of files (repo, path, text)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FACTS.split(", ")]
        types = [pa.int32() if c.endswith(" int") else pa.string() for c in FACTS.split(", ")]
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                rows = []
                for repo, path, text in zip(*(c.to_pylist() for c in batch.slice(a, 1000).columns)):
                    if text and not unread(path):
                        r = _File(text, path).read()
                        rows.append((repo, path, "file", "", "", "", None, 1))
                        rows += [(repo, path, *fact, r.t.line(i)) for *fact, i in r.facts()]
                columns = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return files.where(F.col("path").endswith(".php")).select("repo", "path", "text").mapInArrow(run, FACTS)


def middleware_classes(found: DataFrame) -> DataFrame:
    """repo, name, class: the classes behind each alias and group, through groups in groups; written."""
    steps = cut(found.where("fact IN ('alias', 'group')").select("repo", F.col("key").alias("name"), "value", "kind").distinct())
    out = Rounds(found.sparkSession, "repo string, name string, value string, kind string")
    n = out.add(steps)
    while n:
        inner = out.last().where("kind = 'name'").select("repo", "name", F.col("value").alias("via"))
        new = inner.join(steps.select("repo", F.col("name").alias("via"), "value", "kind"), ["repo", "via"]).select("repo", "name", "value", "kind").distinct()
        n = out.add(new.join(out.all().drop("round"), ["repo", "name", "value", "kind"], "left_anti"))
    return out.all().where("kind = 'class'").select("repo", "name", F.col("value").alias("class"))


def edges(found: DataFrame) -> DataFrame:
    """repo, source_file, target_file, source_symbol, target_symbol, edge_type, line, detail.

    middleware: from where a name or class is used, and from route files that a provider wraps, to the class; binding: from
    the provider to the class that is made, and from what is asked for to it; dispatch: to jobs, events and notifications;
    hook: from where an event is dispatched to each of its listeners. found: facts(), written.
    """
    classes = found.where("fact = 'class'").groupBy("repo", F.col("key").alias("class")).agg(F.min("path").alias("target_file"))
    behind = middleware_classes(found)
    own = found.where("fact = 'use'").select("repo", "path", "value", "kind", F.col("source").alias("source_symbol"), "line")
    # a wrapped route file is named from the project's root
    last = lambda c: F.substring_index(c, "/", -1).alias("last")
    wrapped = found.where("fact = 'wrap'").select("repo", last("key"), "key", "value", "kind").join(found.select("repo", last("path"), F.col("path").alias("file")).distinct(), ["repo", "last"]).where((F.col("file") == F.col("key")) | F.endswith("file", F.concat(F.lit("/"), F.col("key"))))
    used = own.unionByName(wrapped.select("repo", F.col("file").alias("path"), "value", "kind", F.lit(None).cast("string").alias("source_symbol"), F.lit(1).alias("line")))
    direct = used.where("kind = 'class'").withColumnRenamed("value", "class").withColumn("detail", F.lit("class"))
    by_name = used.where("kind = 'name'").join(behind.withColumnRenamed("name", "value"), ["repo", "value"]).withColumnRenamed("value", "detail")
    columns = ["repo", F.col("path").alias("source_file"), "target_file", "source_symbol", F.substring_index("class", "\\", -1).alias("target_symbol"), "edge_type", "line", "detail"]

    def met(rows: DataFrame, kind: str) -> DataFrame:
        return rows.withColumn("edge_type", F.lit(kind)).join(classes, ["repo", "class"]).select(*columns)

    middleware = met(direct.select("repo", "path", "class", "source_symbol", "line", "detail").unionByName(by_name.select("repo", "path", "class", "source_symbol", "line", "detail")), "middleware")
    bound = found.where("fact = 'binding' AND value <> ''").select("repo", "path", F.col("key").alias("asked"), F.col("value").alias("class"), F.col("source").alias("source_symbol"), "line", F.col("kind").alias("detail"))
    asked = bound.join(classes.select("repo", F.col("class").alias("asked"), F.col("target_file").alias("asked_file")), ["repo", "asked"])
    binding = met(bound, "binding").unionByName(met(asked.withColumn("path", F.col("asked_file")).withColumn("source_symbol", F.substring_index("asked", "\\", -1)), "binding"))
    sent = found.where("fact = 'dispatch'").select("repo", "path", F.col("value").alias("class"), F.col("source").alias("source_symbol"), "line", F.col("key").alias("detail"))
    heard = found.where("fact = 'listen'").select("repo", F.col("key").alias("event"), F.col("value").alias("listener")).distinct()
    hooks = sent.withColumnRenamed("class", "event").join(heard, ["repo", "event"]).select("repo", "path", F.col("listener").alias("class"), "source_symbol", "line", F.substring_index("event", "\\", -1).alias("detail"))
    return middleware.unionByName(binding).unionByName(met(sent, "dispatch")).unionByName(met(hooks, "hook")).distinct()


def route_prefixes(found: DataFrame) -> DataFrame:
    """repo, route_file, prefix, middleware (the names, in order) that providers give route files."""
    rows = found.where("fact IN ('prefix', 'wrap')")
    return rows.groupBy("repo", F.col("key").alias("route_file")).agg(
        F.coalesce(F.concat(F.lit("/"), F.min(F.when(F.col("fact") == "prefix", F.col("value")))), F.lit("")).alias("prefix"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("fact") == "wrap", F.col("value")))), ",").alias("middleware"),
    )
