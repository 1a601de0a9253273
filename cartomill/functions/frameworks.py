"""Routes and hooks of web frameworks, from paths and texts.

A framework is a row of a table: which files it looks at, and patterns whose named groups are the verb, the address, the
handler or the hook. Routers by file path need no text at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ship import ship

ROUTES = "framework string, method string, path string, handler string, handler_file string, line int, confidence double"
HOOKS = "framework string, type string, name string, handler string, file string, line int"
# Fixed values of confidence.
CONFIDENCE = {"declared": 1.0, "inferred": 0.8, "low": 0.3}
LEAST_CONFIDENCE = 0.5
_Q = r"['\"](?P<path>[^'\"]*)['\"]"
_VERBS = "get|post|put|patch|delete|options|head"
RESOURCE = (("GET", ""), ("GET", "/create"), ("POST", ""), ("GET", "/{id}"), ("GET", "/{id}/edit"), ("PUT", "/{id}"), ("PATCH", "/{id}"), ("DELETE", "/{id}"))
_GROUPS = [r"Route::(?:\w+\([^()]*\)->)*prefix\(\s*['\"](?P<prefix>[^'\"]+)['\"]\s*\)(?:->\w+\([^()]*\))*->group\(", r"Route::group\(\s*\[[^\]]*['\"]prefix['\"]\s*=>\s*['\"](?P<prefix>[^'\"]+)['\"][^\]]*\]"]
API_RESOURCE = tuple(x for x in RESOURCE if x[1] not in ("/create", "/{id}/edit"))


@dataclass
class Framework:
    files: str
    routes: list[str] = field(default_factory=list)
    hooks: dict[str, str] = field(default_factory=dict)
    #: Address prefixes by variable: groups var and prefix.
    prefixes: list[str] = field(default_factory=list)
    verb: str = "ANY"
    confidence: str = "declared"
    #: Patterns with a group `resource`, and the rows each makes.
    resources: dict[str, tuple] = field(default_factory=dict)
    #: What a text must hold.
    marker: str = ""
    #: Patterns before a block in braces, whose group `prefix` comes before all addresses inside.
    groups: list[str] = field(default_factory=list)


FRAMEWORKS = {
    "laravel": Framework(r"routes/.*\.php$|Providers?/.*\.php$|Middleware/.*\.php$|Controllers?/.*\.php$", [rf"Route::(?P<verb>{_VERBS}|any)\(\s*{_Q}\s*,\s*(?:\[\s*(?P<handler>[\w\\]+)::class\s*,\s*['\"](?P<method>\w+)|['\"](?P<handler2>[\w\\@]+)|function)"], {"middleware": r"class\s+(?P<name>\w*Middleware\w*)|function\s+handle\(\s*Request.*?(?P<handler>)", "service_provider": r"class\s+(?P<name>\w+ServiceProvider)\b"}, resources={r"Route::resource\(\s*['\"](?P<resource>[^'\"]+)['\"]\s*,\s*(?P<handler>[\w\\]+)": RESOURCE, r"Route::apiResource\(\s*['\"](?P<resource>[^'\"]+)['\"]\s*,\s*(?P<handler>[\w\\]+)": API_RESOURCE}, groups=_GROUPS),
    "django": Framework(r"urls\.py$", [rf"\b(?:path|re_path|url)\(\s*r?{_Q}\s*,\s*(?P<handler>[\w.]+)"], resources={r"\.register\(\s*r?['\"](?P<resource>[^'\"]+)['\"]\s*,\s*(?P<handler>[\w.]+)": API_RESOURCE}),
    "flask": Framework(r"\.py$", [rf"@(?P<var>\w+)\.route\(\s*{_Q}(?:[^)]*methods\s*=\s*\[(?P<verbs>[^\]]*)\])?[^)]*\)\s*(?:@[^\n]*\n\s*)*(?:async\s+)?def\s+(?P<handler>\w+)"], prefixes=[r"(?P<var>\w+)\s*=\s*Blueprint\([^)]*url_prefix\s*=\s*['\"](?P<prefix>[^'\"]+)"], verb="GET"),
    "fastapi": Framework(r"\.py$", [rf"@(?P<var>\w+)\.(?P<verb>{_VERBS}|trace)\(\s*{_Q}[^\n]*\)\s*(?:@[^\n]*\n\s*)*(?:async\s+)?def\s+(?P<handler>\w+)"], prefixes=[r"(?P<var>\w+)\s*=\s*APIRouter\(\s*(?:prefix\s*=\s*)?['\"](?P<prefix>[^'\"]+)", r"include_router\(\s*(?:\w+\.)*(?P<var>\w+)\s*,\s*prefix\s*=\s*['\"](?P<prefix>[^'\"]+)"]),
    "express": Framework(r"\.[cm]?[jt]sx?$", [rf"\b(?P<var>app|router|\w+Router)\.(?P<verb>{_VERBS}|all)\(\s*{_Q}\s*,\s*(?:[\w.]+\s*,\s*)*(?P<handler>[\w.]+)?"], prefixes=[r"\.use\(\s*['\"](?P<prefix>[^'\"]+)['\"]\s*,\s*(?P<var>\w+)"]),
    "nestjs": Framework(r"\.ts$", [r"@(?P<verb>Get|Post|Put|Patch|Delete|Options|Head|All)\(\s*(?:['\"](?P<path>[^'\"]*)['\"])?\s*\)\s*(?:@[^\n]*\n\s*)*(?:async\s+)?(?P<handler>\w+)\s*\("], {"graphql_resolver": r"@(?:Query|Mutation|ResolveField)\([^)]*\)\s*(?:async\s+)?(?P<name>\w+)\s*\(", "message_handler": r"@(?:MessagePattern|EventPattern)\(\s*['\"](?P<name>[^'\"]+)['\"]\s*\)\s*(?:async\s+)?(?P<handler>\w+)", "websocket_handler": r"@SubscribeMessage\(\s*['\"](?P<name>[^'\"]+)['\"]\s*\)\s*(?:async\s+)?(?P<handler>\w+)", "middleware": r"class\s+(?P<name>\w+)\s+implements\s+NestMiddleware"}, prefixes=[r"@Controller\(\s*['\"](?P<prefix>[^'\"]*)['\"](?P<var>)"], marker="@nestjs"),
    "react-router": Framework(r"\.[jt]sx?$", [rf"<Route\b[^>]*\bpath\s*=\s*\{{?{_Q}[^>]*?\b(?:element|component)\s*=\s*\{{\s*<?(?P<handler>\w+)", rf"\{{\s*path\s*:\s*{_Q}\s*,\s*element\s*:\s*<(?P<handler>\w+)"], verb="GET", marker="react-router"),
    "vue-router": Framework(r"\.(?:[jt]s|vue)$", [rf"\{{\s*path\s*:\s*{_Q}[^}}]*?component\s*:\s*(?:\(\)\s*=>\s*import\(\s*['\"])?(?P<handler>[\w@/.]+)"], verb="GET", marker="vue-router"),
    "tanstack-router": Framework(r"\.[jt]sx?$", [rf"(?:createFileRoute|createRoute|new\s+Route)\(\s*(?:\{{[^}}]*?path\s*:\s*)?{_Q}"], verb="GET", marker="tanstack"),
    "spring": Framework(r"\.(?:java|kt)$", [r"@(?P<verb>Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:(?:value|path)\s*=\s*)?['\"{]+(?P<path>[^'\"]*)['\"][^)]*\)\s*(?:@[^\n]*\n\s*)*(?:public|private|protected|fun|suspend|\s)*(?:[\w<>\[\]?, ]+\s+)?(?P<handler>\w+)\s*\("], verb="ANY"),
    "rails": Framework(r"routes\.rb$", [rf"^\s*(?P<verb>get|post|put|patch|delete)\s+{_Q}(?:\s*(?:=>|,\s*to:)\s*['\"](?P<handler>[^'\"]+))?"], resources={r"^\s*resources\s+:(?P<resource>\w+)(?P<handler>)": RESOURCE}),
    "go-web": Framework(r"\.go$", [rf"\.(?P<verb>GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\(\s*\"(?P<path>[^\"]*)\"\s*,\s*(?P<handler>[\w.]+)", r"HandleFunc\(\s*\"(?P<path>[^\"]*)\"\s*,\s*(?P<handler>[\w.]+)"], confidence="inferred"),
    "rust-web": Framework(r"\.rs$", [r"\.route\(\s*\"(?P<path>[^\"]*)\"\s*,\s*(?P<verb>get|post|put|patch|delete)\(\s*(?P<handler>[\w:]+)", r"#\[(?P<verb>get|post|put|patch|delete)\(\s*\"(?P<path>[^\"]*)\"[^\]]*\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(?P<handler>\w+)"]),
    "aspnet": Framework(r"\.cs$", [r"\[Http(?P<verb>Get|Post|Put|Patch|Delete)(?:\(\s*\"(?P<path>[^\"]*)\"[^\]]*)?\]\s*(?:\[[^\]]*\]\s*)*public\s+(?:async\s+)?[\w<>\[\]]+\s+(?P<handler>\w+)"]),
    "vapor": Framework(r"\.swift$", [r"\b(?:app|routes?|\w+)\.(?P<verb>get|post|put|patch|delete)\(\s*\"(?P<path>[^\"]*)\"(?:[^)]*use:\s*(?P<handler>[\w.]+))?"], confidence="inferred"),
    "symfony": Framework(r"\.php$", [r"#\[Route\(\s*['\"](?P<path>[^'\"]*)['\"](?:[^\]]*methods:\s*\[(?P<verbs>[^\]]*)\])?[^\]]*\]\s*(?:public\s+)?function\s+(?P<handler>\w+)"], {"event_subscriber": r"class\s+(?P<name>\w+)[^{]*implements[^{]*EventSubscriberInterface"}),
    "yii": Framework(r"\.php$", [r"['\"](?:(?P<verb>GET|POST|PUT|PATCH|DELETE)\s+)?(?P<path>[\w/<>:\\+-]+)['\"]\s*=>\s*['\"](?P<handler>[\w-]+/[\w/-]+)['\"]", r"Route::(?P<verb>get|post|put|delete)\(\s*['\"](?P<path>[^'\"]*)['\"]\)->action\(\s*\[?(?P<handler>[\w\\]+)"], marker="rules"),
    "drupal": Framework(r"\.routing\.yml$|\.module$", [r"^\s+path:\s*['\"]?(?P<path>/[^'\"\n]*)['\"]?\s*\n(?:(?!^\S)[^\n]*\n)*?\s+_controller:\s*['\"]?(?P<handler>[^'\"\n]+)"], {"hook": r"^function\s+(?P<name>\w+_(?:alter|preprocess|form|theme|menu|cron|install|help|page|node|user|entity)\w*)\s*\("}, verb="GET"),
    "wordpress": Framework(r"\.php$", [r"register_rest_route\(\s*['\"](?P<prefix>[^'\"]+)['\"]\s*,\s*['\"](?P<path>[^'\"]*)['\"](?:[^;]*?['\"]methods['\"]\s*=>\s*['\"]?(?P<verb>\w+))?(?:[^;]*?['\"]callback['\"]\s*=>\s*['\"]?(?P<handler>\w+))?"], {"action": r"add_action\(\s*['\"](?P<name>[^'\"]+)['\"]\s*,\s*['\"]?(?P<handler>\w+)?", "filter": r"add_filter\(\s*['\"](?P<name>[^'\"]+)['\"]\s*,\s*['\"]?(?P<handler>\w+)?", "shortcode": r"add_shortcode\(\s*['\"](?P<name>[^'\"]+)['\"]\s*,\s*['\"]?(?P<handler>\w+)?", "post_type": r"register_post_type\(\s*['\"](?P<name>[^'\"]+)"}, verb="GET"),
}


@dataclass
class Pages:
    """A router by file path: where its files lie, what they answer, and which exported functions are verbs or actions."""

    #: Patterns of paths, whose group `at` is the address: of pages, of servers, and of files with form actions.
    pages: list[str]
    servers: list[str] = field(default_factory=list)
    actions: str = ""
    verbs: str = ""


# Fixed formats: paths and exports of routers by file path.
PAGES = {
    "nextjs": Pages([r"(?:^|/)pages/(?P<at>.*?)(?:/?index)?\.[jt]sx?$", r"(?:^|/)app/(?:(?P<at>.*)/)?page\.[jt]sx$"], [r"(?:^|/)app/(?:(?P<at>.*)/)?route\.[jt]s$"], r"['\"]use server['\"]", r"export\s+(?:async\s+)?function\s+(\w+)"),
    "sveltekit": Pages([r"(?:^|/)src/routes/(?:(?P<at>.*)/)?\+page\.svelte$"], [r"(?:^|/)src/routes/(?:(?P<at>.*)/)?\+server\.[jt]s$"], r"export\s+const\s+actions\s*=\s*\{", r"export\s+(?:const|async\s+function|function)\s+(\w+)"),
}
HTTP = "GET POST PUT DELETE PATCH OPTIONS HEAD".split()


def address(at: str | None) -> str:
    """The address of a place: groups in brackets left out, parameters in braces."""
    return joined(*(re.sub(r"\[(?:\.\.\.)?(\w+)\]", r"{\1}", part) for part in (at or "").split("/") if not re.fullmatch(r"\(.*\)", part)))


def page_routes_of(path: str, text: str, name: str) -> Iterator[tuple]:
    router, confidence = PAGES[name], CONFIDENCE["inferred"]
    line = lambda at: text.count("\n", 0, at) + 1
    for pattern in router.pages:
        if m := re.search(pattern, path):
            to = address(m["at"])
            yield name, "ALL" if to.startswith("/api/") else "GET", to, "default", path, 1, confidence
    exported = [(m[1], line(m.start())) for m in re.finditer(router.verbs, text)]
    for pattern in router.servers:
        if m := re.search(pattern, path):
            for verb, at in exported:
                if verb in HTTP:
                    yield name, verb, address(m["at"]), verb, path, at, confidence
    found = re.search(router.actions, text)
    if found and name == "nextjs":
        for function, at in exported:
            yield name, "POST", f"/action/{function}", function, path, at, confidence
    elif found and (m := re.search(r"(?:^|/)src/routes/(?:(?P<at>.*)/)?\+page\.server\.[jt]s$", path)):
        for key in re.finditer(r"^\s*(\w+)\s*:", text[found.end() :], re.M):
            yield name, "POST", address(m["at"]) + f"?/{key[1]}", key[1], path, line(found.end() + key.start(1)), confidence


@dataclass
class Sign:
    """What shows that a project uses a framework: a path, or words in the text of a manifest."""

    paths: str = ""
    manifests: str = ""
    words: str = ""


_NODE = r"(?:^|/)package\.json$"
_PYTHON = r"(?:^|/)(?:requirements\.txt|pyproject\.toml|Pipfile|setup\.py)$"
_COMPOSER = r"(?:^|/)composer\.json$"
SIGNS = {
    "laravel": Sign(r"(?:^|/)artisan$", _COMPOSER, r'"laravel/framework"\s*:'),
    "django": Sign(r"manage\.py$", _PYTHON, r"(?i)django"),
    "flask": Sign(r"(?:wsgi|app)\.py$", _PYTHON, r"(?i)flask"),
    "fastapi": Sign(r"main\.py$", _PYTHON, r"(?i)fastapi"),
    "express": Sign("", _NODE, r'"express"\s*:'),
    "nestjs": Sign("", _NODE, r'"@nestjs/(?:core|common)"\s*:'),
    "nextjs": Sign("", _NODE, r'"next"\s*:'),
    "react-router": Sign("", _NODE, r'"react-router(?:-dom)?"\s*:'),
    "tanstack-router": Sign("", _NODE, r'"@tanstack/react-router"\s*:'),
    "sveltekit": Sign(r"(?:^|/)svelte\.config\.js$", _NODE, r'"(?:@sveltejs/kit|svelte)"\s*:'),
    "vue-router": Sign("", _NODE, r'"(?:vue-router|vue)"\s*:'),
    "spring": Sign(r"\.(?:java|kt)$|(?:^|/)(?:pom\.xml|build\.gradle)$"),
    "rails": Sign(r"routes\.rb$", r"(?:^|/)Gemfile$", "rails"),
    "go-web": Sign(r"\.go$|(?:^|/)go\.mod$"),
    "rust-web": Sign(r"\.rs$|(?:^|/)Cargo\.toml$"),
    "aspnet": Sign(r"\.(?:csproj|sln|cs)$"),
    "vapor": Sign(r"\.swift$"),
    "symfony": Sign(r"(?:^|/)symfony\.lock$|config/routes\.yaml|src/Controller/", _COMPOSER, r'"symfony/[\w-]+"\s*:'),
    "yii": Sign(r"config/(?:web|routes)\.php", _COMPOSER, r'"yiisoft/[\w-]+"\s*:'),
    "drupal": Sign(r"(?:^|/)core/lib/Drupal\.php$|\.routing\.yml$"),
    "wordpress": Sign(r"(?:^|/)wp-config\.php$|wp-(?:content|includes)/"),
}


def active_frameworks(files: DataFrame) -> DataFrame:
    """repo, framework: what each repository uses, by its paths and manifests. files: repo, path, text."""
    signs = []
    for name, sign in SIGNS.items():
        shows = F.lit(False)
        if sign.paths:
            shows = shows | F.col("path").rlike(sign.paths)
        if sign.manifests:
            shows = shows | (F.col("path").rlike(sign.manifests) & F.coalesce(F.col("text").rlike(sign.words), F.lit(False)))
        signs.append(F.when(shows, F.lit(name)))
    return files.select("repo", F.explode(F.array_compact(F.array(*signs))).alias("framework")).distinct()


def joined(*parts: str) -> str:
    return "/" + "/".join(p.strip("/") for p in parts if p and p.strip("/"))


def closing(text: str, at: int) -> int:
    """Where the next block in braces ends; the end of the text, if it has no end."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if depth <= 0:
            return m.end()
    return len(text)


def routes_of(path: str, text: str, name: str) -> Iterator[tuple]:
    if name in PAGES:
        yield from page_routes_of(path, text, name)
        return
    fw = FRAMEWORKS[name]
    if not re.search(fw.files, path) or fw.marker not in text:
        return
    prefix = {m["var"] or "": m["prefix"] for p in fw.prefixes for m in re.finditer(p, text)}
    around = sorted((m.start(), closing(text, m.end()), m["prefix"]) for p in fw.groups for m in re.finditer(p, text))
    within = lambda at: "/".join(p for a, b, p in around if a < at < b)
    confidence = CONFIDENCE[fw.confidence]
    for pattern in fw.routes:
        for m in re.finditer(pattern, text, re.M):
            g = m.groupdict()
            verbs = re.findall(r"\w+", g.get("verbs") or "") or [g.get("verb") or fw.verb]
            handler = g.get("handler") or g.get("handler2") or ""
            handler += "@" + g["method"] if g.get("method") else ""
            before = g.get("prefix") or prefix.get(g.get("var") or "", "")
            for v in verbs:
                v = {"REQUEST": "ANY", "ALL": "ALL"}.get(v.upper(), v.upper())
                yield name, v, joined(within(m.start()), before, g.get("path") or ""), handler, path, text.count("\n", 0, m.start()) + 1, confidence
    for pattern, rows in fw.resources.items():
        for m in re.finditer(pattern, text, re.M):
            for verb, tail in rows:
                yield name, verb, joined(within(m.start()), m["resource"] + tail), m["handler"] or "", path, text.count("\n", 0, m.start()) + 1, confidence


def hooks_of(path: str, text: str, name: str) -> Iterator[tuple]:
    fw = FRAMEWORKS.get(name)
    if fw and re.search(fw.files, path) and fw.marker in text:
        for kind, pattern in fw.hooks.items():
            for m in re.finditer(pattern, text, re.M):
                if m.groupdict().get("name"):
                    yield name, kind, m["name"], m.groupdict().get("handler"), path, text.count("\n", 0, m.start()) + 1


def detect_routes(files: DataFrame, frameworks: list[str] | None = None) -> DataFrame:
    """ROUTES of files (path, text), each method, path and handler once; those of little confidence are left out."""
    found = _mapped(files, ROUTES, "routes_of", frameworks).where(f"confidence >= {LEAST_CONFIDENCE}")
    return found.groupBy("framework", "method", "path", "handler", "handler_file").agg(F.min("line").alias("line"), F.max("confidence").alias("confidence"))


def detect_hooks(files: DataFrame, frameworks: list[str] | None = None) -> DataFrame:
    return _mapped(files, HOOKS, "hooks_of", frameworks)


def _mapped(files: DataFrame, schema: str, function: str, frameworks: list[str] | None) -> DataFrame:
    ship(files.sparkSession)
    chosen = frameworks or [*FRAMEWORKS, *PAGES]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from cartomill.functions import frameworks as module

        names = [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            yield pd.DataFrame([r for path, text in frame.itertuples(index=False) for n in chosen for r in getattr(module, function)(path, text or "", n)], columns=names)

    return files.select("path", "text").mapInPandas(run, schema)


def file_route(path: Column | str) -> Column:
    """The address of a page by its path: Next.js pages/ and app/, SvelteKit +page; null for other files."""
    p = F.col(path) if isinstance(path, str) else path
    pages = F.regexp_extract(p, r"(?:^|/)pages/(.*)\.[jt]sx?$", 1)
    app = F.regexp_extract(p, r"(?:^|/)app/(?:(.*)/)?(?:page|route)\.[jt]sx?$", 1)
    kit = F.regexp_extract(p, r"(?:^|/)routes/(?:(.*)/)?\+(?:page\.svelte|server\.[jt]s)$", 1)
    raw = F.when(p.rlike(r"(?:^|/)pages/.*\.[jt]sx?$"), F.regexp_replace(pages, r"(^|/)index$", "")).when(p.rlike(r"(?:^|/)app/(.*/)?(page|route)\.[jt]sx?$"), app).when(p.rlike(r"(?:^|/)routes/(.*/)?\+(page\.svelte|server\.[jt]s)$"), kit)
    plain = F.regexp_replace(F.regexp_replace(raw, r"\([^)]*\)/?", ""), r"\[(?:\.\.\.)?([^\]]+)\]", "{$1}")
    return F.concat(F.lit("/"), F.regexp_replace(plain, r"/$", ""))


def load_registry(spark: SparkSession, path: str, kind: str = "routes") -> DataFrame:
    """Routes or hooks of a JSON file with a list of them; a file that is missing or no JSON has none."""
    schema = ROUTES if kind == "routes" else HOOKS
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    return rows.where("framework IS NOT NULL")


def route_query(routes: DataFrame, framework: str | None = None, method: str | None = None, path: str | None = None) -> DataFrame:
    out = routes
    for column, value in (("framework", framework), ("method", method)):
        out = out.where(F.lower(column) == value.lower()) if value else out
    return out.where(F.lower("path").contains(path.lower())) if path else out


def hook_query(hooks: DataFrame, framework: str | None = None, type: str | None = None, name: str | None = None) -> DataFrame:
    out = hooks
    for column, value in (("framework", framework), ("type", type)):
        out = out.where(F.lower(column) == value.lower()) if value else out
    return out.where(F.lower("name").contains(name.lower())) if name else out
