"""PHP: classes by their full names, calls by the classes of what they are called on, and what a framework means by them.

Each function has an environment, from variable to class: of its parameters, of `new`, of other variables, of catch, and
of docblocks (@var, @param); each class has one of its properties, typed, promoted or assigned. A call on a variable, a
property, `$this`, `self`, `static` or `parent` then names the class's method; others keep the method's name alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from .declarations import Braces, Symbol

# Facades, and the classes behind them.
FACADES = {
    "App": "Illuminate\\Foundation\\Application",
    "Auth": "Illuminate\\Auth\\AuthManager",
    "Bus": "Illuminate\\Contracts\\Bus\\Dispatcher",
    "Cache": "Illuminate\\Cache\\CacheManager",
    "Config": "Illuminate\\Config\\Repository",
    "Cookie": "Illuminate\\Cookie\\CookieJar",
    "Crypt": "Illuminate\\Encryption\\Encrypter",
    "DB": "Illuminate\\Database\\DatabaseManager",
    "Event": "Illuminate\\Events\\Dispatcher",
    "File": "Illuminate\\Filesystem\\Filesystem",
    "Gate": "Illuminate\\Auth\\Access\\Gate",
    "Hash": "Illuminate\\Hashing\\HashManager",
    "Http": "Illuminate\\Http\\Client\\Factory",
    "Lang": "Illuminate\\Translation\\Translator",
    "Log": "Illuminate\\Log\\LogManager",
    "Mail": "Illuminate\\Mail\\Mailer",
    "Notification": "Illuminate\\Notifications\\ChannelManager",
    "Password": "Illuminate\\Auth\\Passwords\\PasswordBrokerManager",
    "Queue": "Illuminate\\Queue\\QueueManager",
    "RateLimiter": "Illuminate\\Cache\\RateLimiter",
    "Redirect": "Illuminate\\Routing\\Redirector",
    "Request": "Illuminate\\Http\\Request",
    "Response": "Illuminate\\Routing\\ResponseFactory",
    "Schema": "Illuminate\\Database\\Schema\\Builder",
    "Session": "Illuminate\\Session\\SessionManager",
    "Storage": "Illuminate\\Filesystem\\FilesystemManager",
    "URL": "Illuminate\\Routing\\UrlGenerator",
    "Validator": "Illuminate\\Validation\\Factory",
    "View": "Illuminate\\View\\Factory",
}
# Relations and how many they join.
RELATIONS = {
    "hasOne": "one-to-one", "morphOne": "one-to-one", "hasOneOfMany": "one-to-many", "hasMany": "one-to-many", "morphMany": "one-to-many", "hasOneThrough": "one-to-many", "hasManyThrough": "one-to-many",
    "belongsTo": "many-to-one", "morphTo": "many-to-one", "belongsToMany": "many-to-many", "morphToMany": "many-to-many", "morphedByMany": "many-to-many",
}
BINDINGS = frozenset("bind singleton scoped instance alias".split())
# Types that are no class of the project.
SCALARS = frozenset("string int integer float double bool boolean array object callable iterable void null never mixed self static parent false true Collection Builder Request Response".split())
# Roles by what a class extends, in order of rank, then by folder, ending or interface.
ROLE_BASES = (("model", ("Model", "Authenticatable", "Pivot")), ("controller", ("Controller", "BaseController")), ("service_provider", ("ServiceProvider",)))
ROLE_SIGNS = (("event", "/Events/", "Event", ("ShouldBroadcast", "ShouldBroadcastNow")), ("job", "/Jobs/", "Job", ("ShouldQueue", "ShouldBeUnique")), ("notification", "/Notifications/", "Notification", ()), ("listener", "/Listeners/", "Listener", ()))
FILE_ROLES = (("migration", "/migrations/", ("Migration",)), ("seeder", "/seeders/", ("Seeder", "DatabaseSeeder")), ("factory", "/factories/", ("Factory",)))
_DOC = re.compile(r"/\*\*(.*?)\*/", re.S)
_TAG = re.compile(r"@(var|param)\s+\??([\\\w]+)(?:\|[\\\w]+)*(?:[ \t]+(\$\w+))?")
_CLASSES = frozenset("class interface trait enum".split())


class Php(Braces):
    def __init__(self, text: str, path: str = ""):
        super().__init__(text, "php")
        self.path_name = path
        self.rows: list[tuple] = []

    # --- names

    def short(self, name: str) -> str:
        return name.rsplit("\\", 1)[-1]

    def full(self, name: str) -> str:
        """A class name by the file's use table, then its namespace."""
        first, _, rest = name.partition("\\")
        if name.startswith("\\"):
            return name[1:]
        if first in self.used:
            return self.used[first] + (f"\\{rest}" if rest else "")
        return f"{self.namespace}\\{name}" if self.namespace else name

    def uses(self) -> dict[str, str]:
        """Aliases of imported classes."""
        out, classes = {}, [(s.start, s.end) for s in self.symbols if s.kind in _CLASSES]
        i = 0
        while i < self.n:
            if self.words[i] == "use" and self.word(i + 1) and not any(a < i < b for a, b in classes[:1]):
                j = i + 1
                prefix = ""
                while j < self.n and self.at(j) != ";":
                    w = self.word(j)
                    if w and self.at(j + 1) == "{":
                        prefix = w.lstrip("\\")
                    elif w and w not in ("as", "function", "const"):
                        name = (prefix + w).lstrip("\\")
                        alias = self.word(j + 2) if self.word(j + 1) == "as" else self.short(name)
                        out.setdefault(alias, name)
                        j += 2 if self.word(j + 1) == "as" else 0
                    j += 1
                i = j
            i += 1
        return out

    # --- the second pass

    def read(self) -> Php:
        super().read()
        self.used = self.uses()
        self.namespace = next((s.name for s in self.symbols if s.kind == "namespace"), "")
        bases = {"extends": {}, "implements": {}}
        order = sorted((s for s in self.symbols if s.kind in _CLASSES), key=lambda s: s.start)
        at = 0
        for name, kind, i in sorted(self.references, key=lambda r: r[2]):
            if kind in bases:
                while at + 1 < len(order) and order[at + 1].start <= i:
                    at += 1
                if order and order[at].start <= i <= order[at].end:
                    bases[kind].setdefault(order[at].name, []).append(name)
        self.parents = {c: self.full(b[0]) for c, b in bases["extends"].items()}
        self.bases = bases
        self.docs = self.doc_types()
        if self.followed():
            self.flow()
        return self

    def followed(self) -> bool:
        """Whether the third pass is needed, which types variables and calls."""
        return True

    def doc_types(self) -> dict[int, list[tuple[str, str, str | None]]]:
        """What the docblock before a token says: (tag, class, variable)."""
        out: dict[int, list[tuple[str, str, str | None]]] = {}
        at = 0
        for m in _DOC.finditer(self.t.text):
            while at < self.n and self.t.starts[at] < m.end():
                at += 1
            if at < self.n and (at == 0 or self.t.starts[at - 1] + len(self.t.texts[at - 1]) <= m.start()):  # not in a string
                out[at] = [(t[1], t[2], t[3]) for t in _TAG.finditer(m[1]) if t[2] not in SCALARS]
        return out

    def flow(self) -> None:
        begins: dict[int, list[Symbol]] = {}
        for s in self.symbols:
            if s.kind in _CLASSES or s.kind in ("method", "function"):
                begins.setdefault(s.start, []).append(s)
        open_: list[tuple[int, str, str | None, dict[str, str]]] = []  # end, kind, name, environment
        properties: dict[str, dict[str, str]] = {}
        self.relations: set[str] = set()
        self.providers: set[str] = set()
        pending: dict[int, dict[str, str]] = {}
        at = None  # the scope that the next three belong to
        words, marks, docs, n = self.words, self.marks, self.docs, self.n
        for i in range(n):
            while open_ and open_[-1][0] < i:
                open_.pop()
            if i in begins:
                for s in begins[i]:
                    open_.append((s.end, "class" if s.kind in _CLASSES else "function", s.name, {}))
            w = words[i]
            if not w and i not in docs:
                continue
            top = open_[-1] if open_ else ()
            if top is not at:
                at = top
                cls = next((name for _, kind, name, _ in reversed(open_) if kind == "class"), None)
                method = next((name for _, kind, name, _ in reversed(open_) if kind == "function" and name), None)
            env = open_[-1][3] if open_ and open_[-1][1] == "function" else {} if cls else pending.setdefault(-1, {})
            own = properties.setdefault(cls or "", {})
            for tag, type_, variable in docs.get(i, ()):
                if variable:
                    env.setdefault(variable, self.full(type_))
                elif tag == "var":
                    name = next((self.word(k) for k in range(i, min(i + 6, self.n)) if self.word(k).startswith("$")), None)
                    if name and open_ and open_[-1][1] == "class":
                        own.setdefault(name[1:], self.full(type_))
                    elif name:
                        env[name] = self.full(type_)
            if w == "function" and not self.named(i):
                j = i + 1 + (self.at(i + 1) == "&")
                if self.at(j) == "(":
                    inner: dict[str, str] = {}
                    k = self.close[j] + 1
                    if self.word(k) == "use" and self.at(k + 1) == "(":
                        inner = {v: env[v] for x in range(k + 2, self.close[k + 1]) if (v := self.word(x)) in env}
                    brace = self.body(k, False)[0]
                    if brace is not None:
                        open_.append((self.close[brace], "function", None, inner))
                        env = inner
            if w in ("function", "fn"):
                self.parameters(i, env, own, method, cls)
            elif w == "catch" and self.at(i + 1) == "(":
                types = [x for k in range(i + 2, self.close[i + 1]) if (x := self.word(k))]
                if len(types) > 1 and types[-1].startswith("$"):
                    env[types[-1]] = self.full(types[0])
            elif w.startswith("$"):
                self.variable(i, w, env, own, cls, bool(open_) and open_[-1][1] == "class", method)
            if w and i + 1 < n and marks[i + 1] == "(" and w not in ("function", "fn"):
                self.call(i, w, env, own, cls, method)

    def named(self, i: int) -> bool:
        return bool(self.word(i + 1)) and self.word(i + 1) != "use" or self.at(i + 1) == "&" and bool(self.word(i + 2))

    def hints(self, a: int, b: int, kind: str, source: str | None) -> str | None:
        """Type references between a and b; the first class, in full."""
        first = None
        for k in range(a, b):
            w = self.word(k)
            if w and not w.startswith("$") and w not in SCALARS and w.lower() not in SCALARS and w not in ("public", "private", "protected", "readonly", "static", "var", "final"):
                if not w.lstrip("\\").startswith("Illuminate\\"):
                    self.rows.append((self.full(w), kind, source, None, k, "verified"))
                first = first or self.full(w)
        return first

    def parameters(self, i: int, env: dict, own: dict, method: str | None, cls: str | None) -> None:
        j = i + 1
        while j < self.n and self.at(j) != "(":
            j += 1
        if j >= self.n:
            return
        at, end = j + 1, self.close[j]
        k = at
        while k < end:
            if self.at(k) == "[" and self.t.texts[k - 1] == "#":
                k = at = self.close[k] + 1
                continue
            w = self.word(k)
            if w.startswith("$"):
                type_ = self.hints(at, k, "param_type", method or cls)
                if type_:
                    env[w] = type_
                    if any(self.word(x) in ("public", "private", "protected", "readonly") for x in range(at, k)):
                        own[w[1:]] = type_
                while k < end and self.at(k) != ",":
                    k = self.close[k] + 1 if self.at(k) in ("(", "[", "{") else k + 1
                at = k + 1
            k += 1
        if self.at(end + 1) == "use" and self.at(end + 2) == "(":
            end = self.close[end + 2]
        if self.at(end + 1) == ":":
            stop = end + 2
            while stop < self.n and (self.word(stop) or self.at(stop) in ("?", "|", "&")):
                stop += 1
            self.hints(end + 2, stop, "return_type", method or cls)

    def variable(self, i: int, w: str, env: dict, own: dict, cls: str | None, in_class: bool, method: str | None) -> None:
        if in_class and self.at(i - 1) not in ("->", "::", "(", ","):  # a property, after its type
            a = i
            while a > 0 and (self.word(a - 1) or self.at(a - 1) in ("?", "|", "&")) and not self.word(a - 1).startswith("$"):
                a -= 1
            type_ = self.hints(a, i, "param_type", cls)
            if type_:
                own[w[1:]] = type_
            return
        target = None
        if self.at(i + 1) == "=" and self.at(i + 2) not in ("=", ">"):
            target, j = w, i + 2
        elif w == "$this" and self.at(i + 1) == "->" and self.word(i + 2) and self.at(i + 3) == "=" and self.at(i + 4) not in ("=", ">"):
            target, j = self.word(i + 2), i + 4
        if target is None:
            return
        type_ = None
        if self.word(j) == "new" and self.word(j + 1) not in ("class", "static", "self", ""):
            type_ = self.full(self.word(j + 1)) if not self.word(j + 1).startswith("$") else None
        elif self.word(j) == "new" and self.word(j + 1) in ("static", "self") and cls:
            type_ = self.full(cls)
        elif self.word(j).startswith("$") and self.at(j + 1) in (";", ",", ")"):
            type_ = env.get(self.word(j))
        elif self.word(j) == "$this" and self.at(j + 1) == "->" and self.at(j + 3) == ";":
            type_ = own.get(self.word(j + 2))
        elif self.word(j) in ("app", "resolve") and self.at(j + 1) == "(" and self.at(j + 3) == "::":
            type_ = self.full(self.word(j + 2))
        place = env if target.startswith("$") else own
        if type_:
            place[target] = type_
        elif place is env and not any(variable == target for _, _, variable in self.docs.get(i, ())):
            env.pop(target, None)  # something else from here on

    def argument(self, j: int, nth: int) -> tuple[str | None, bool]:
        """The nth argument of the call whose bracket is at j, and whether it is X::class."""
        k = j + 1
        for _ in range(nth):
            while k < self.close[j] and self.at(k) != ",":
                k = self.close[k] + 1 if self.at(k) in ("(", "[", "{") else k + 1
            k += 1
        if k >= self.close[j]:
            return None, False
        if self.word(k) and self.at(k + 1) == "::" and self.word(k + 2) == "class":
            return self.word(k), True
        return (self.string(k), False) if self.string(k) is not None else (None, False)

    def receiver(self, i: int, env: dict, own: dict, cls: str | None) -> str | None:
        """The class of what the method named at i is called on."""
        if self.at(i - 1) == "::":
            w = self.word(i - 2)
            if w in ("self", "static"):
                return cls and self.full(cls)
            if w == "parent":
                return self.parents.get(cls or "")
            return env.get(w) if w.startswith("$") else FACADES.get(self.short(self.full(w))) or self.full(w) if w else None
        if self.at(i - 1) in ("->", "?.") or self.at(i - 1) == "?":
            j = i - 2
            w = self.word(j)
            if w == "$this":
                return cls and self.full(cls)
            if w.startswith("$"):
                return env.get(w)
            if w and self.at(j - 1) == "->" and self.word(j - 2) == "$this":
                return own.get(w)
            if self.at(j) == ")":
                begin = next((k for k in range(j, max(-1, j - 60), -1) if self.at(k) == "(" and self.close[k] == j), None)
                if begin and self.word(begin - 1) and self.word(begin - 2) == "new":
                    return self.full(self.word(begin - 1))
                if begin and self.at(begin - 1) == "(" and self.word(begin + 1) == "new":
                    return self.full(self.word(begin + 2))
                if begin and self.word(begin + 1) == "new":
                    return self.full(self.word(begin + 2))
                if begin and self.word(begin - 1) in ("app", "resolve") and self.argument(begin, 0)[1]:
                    return self.full(self.argument(begin, 0)[0])
        return None

    def call(self, i: int, w: str, env: dict, own: dict, cls: str | None, method: str | None) -> None:
        before, j = self.at(i - 1), i + 1
        on = self.receiver(i, env, own, cls)
        if on and before in ("::", "->"):
            self.rows.append((f"{on}::{w}", "method_call", method or cls, None, i, "verified"))
        if w in RELATIONS and before == "->" and self.word(i - 2) == "$this" and cls:
            self.relations.add(cls)
            name, constant = self.argument(j, 0)
            if name:
                self.rows.append((self.full(name) if constant else name, "relation", cls, f"{w}: {RELATIONS[w]}", i, "verified" if constant else "inferred"))
        on_app = before == "->" and (self.word(i - 2) in ("app", "$app") or self.at(i - 2) == ")" and self.word(i - 4) == "app") or before == "::" and self.word(i - 2) == "App"
        if w in BINDINGS and on_app:
            self.providers.add(cls or "")
            name, constant = self.argument(j, 0)
            concrete, named = self.argument(j, 1)
            if name:
                detail = f"{w}: {self.full(concrete) if named else concrete or ''}: {'boot' if method == 'boot' else 'register'}"
                self.rows.append((self.full(name) if constant else name, "binding", method or "register", detail, i, "verified" if constant else "inferred"))
        if w == "when" and on_app:
            self.contextual(i, method, cls)
        if w in ("dispatch", "event", "dispatch_sync", "dispatch_now") and before not in ("->", "::") and self.word(j + 1) == "new":
            self.rows.append((self.full(self.word(j + 2)), "dispatch", method, f"{w}: {'event' if w == 'event' else 'job'}", j + 2, "verified"))
        elif w.startswith("dispatch") and before == "::" and self.word(i - 2) not in ("self", "static", "parent", "Bus", "Event"):
            self.rows.append((self.full(self.word(i - 2)), "dispatch", method, f"{w}: job", i - 2, "verified"))
        elif w == "dispatch" and (before == "->" and self.word(i - 2) == "$this" or before == "::") and self.word(j + 1) == "new":
            self.rows.append((self.full(self.word(j + 2)), "dispatch", method, f"{w}: {'event' if self.word(i - 2) == 'Event' else 'job'}", j + 2, "verified"))
        sends = w if w in ("notify", "notifyNow") and before == "->" else f"Notification::{w}" if w in ("send", "sendNow") and before == "::" and self.word(i - 2) == "Notification" else None
        if sends:
            k = next((k for k in range(j + 1, self.close[j]) if self.word(k) == "new"), None)
            if k is not None:
                self.rows.append((self.full(self.word(k + 1)), "notify", method, sends, k + 1, "verified"))

    def contextual(self, i: int, method: str | None, cls: str | None) -> None:
        """when(A)->needs(B)->give(C): B is bound to C within A."""
        who, needs, j = self.argument(i + 1, 0)[0], None, self.close[i + 1] + 1
        while self.at(j) == "->" and self.at(j + 2) == "(":
            name, constant = self.argument(j + 2, 0)
            if self.word(j + 1) == "needs" and name:
                needs = self.full(name) if constant else name
            elif self.word(j + 1) == "give" and needs and who:
                self.providers.add(cls or "")
                self.rows.append((needs, "binding", method or "register", f"when {self.full(who)}: {self.full(name) if constant and name else name or ''}: {'boot' if method == 'boot' else 'register'}", i, "verified"))
            j = self.close[j + 2] + 1

    # --- roles

    def roles(self) -> Iterator[tuple[str, str, int]]:
        """class, role, its token."""
        path = "/" + self.path_name.replace("\\", "/")
        bases = {self.short(b) for b in sum(self.bases["extends"].values(), [])}
        whole = next((role for role, folder, names in FILE_ROLES if folder in path or bases & set(names)), None)
        handles = {s.scope for s in self.symbols if s.kind == "method" and s.name == "handle"}
        for s in self.symbols:
            if s.kind != "class":
                continue
            extends = {self.short(b) for b in self.bases["extends"].get(s.name, ())}
            implements = {self.short(b) for b in self.bases["implements"].get(s.name, ())}
            role = whole or next((role for role, names in ROLE_BASES if extends & set(names) or role == "model" and s.name in self.relations or role == "service_provider" and s.name in self.providers), None)
            role = role or next((role for role, folder, ending, faces in ROLE_SIGNS if folder in path or s.name.endswith(ending) or implements & set(faces) or role == "notification" and "Notification" in extends or role == "listener" and s.name in handles and "ShouldQueue" in implements), None)
            if role:
                yield s.name, role, s.start

    def file_role(self) -> str | None:
        path = "/" + self.path_name.replace("\\", "/")
        bases = {self.short(b) for b in sum(self.bases["extends"].values(), [])}
        return next((role for role, folder, names in FILE_ROLES if folder in path or bases & set(names)), "route_file" if "routes/" in path else None)


def unread(path: str) -> bool:
    """Generated files and templates are not read."""
    return "bootstrap/cache/" in path or path.endswith(".blade.php")


def php_found(text: str, path: str) -> Iterator[tuple]:
    """("symbol", name, kind, scope, line text, first and last line), ("reference", name, kind, line, source symbol, detail,
    verifiability) and ("role", class, role, line); files of migrations, seeds and factories have no references."""
    if unread(path):
        return
    r = Php(text, path).read()
    for s in sorted(r.symbols, key=lambda s: (s.start, -s.end)):
        yield "symbol", s.name, s.kind, s.scope, r.t.line_text(s.start), r.t.line(s.start), r.t.last_line(s.end)
    for name, role, i in r.roles():
        yield "role", name, role, r.t.line(i)
    if r.file_role() in ("migration", "seeder", "factory"):
        return
    sent = {(row[0], r.t.line(row[4])) for row in r.rows if row[1] in ("dispatch", "notify")}
    typed = {row[4]: row for row in r.rows if row[1] == "method_call"}
    related = {row[4] for row in r.rows if row[1] == "relation"}
    out = []
    for name, kind, i in r.references:
        source, detail, sure = None, None, None
        if kind in ("extends", "implements", "instantiation"):
            name = r.full(name)
        elif kind == "import":
            name = name.lstrip("\\")
        elif kind == "call" and i in related:
            continue
        elif kind == "call" and i in typed:
            name, _, source, _, _, sure = typed[i]
        elif kind == "call" and r.at(i - 1) == "->":
            sure = "inferred"
        if kind in ("instantiation", "call") and ((name, r.t.line(i)) in sent or kind == "call" and (name.split("::")[0], r.t.line(i)) in sent):
            continue
        facade = FACADES.get(r.short(name)) if kind == "instantiation" else None
        if facade:
            name, detail, sure = facade, r.short(name), "inferred"
        elif kind == "call" and r.at(i - 1) == "::" and (alias := r.short(r.full(r.word(i - 2)))) in FACADES:
            detail, sure = alias, "inferred"
        out.append((i, name, kind, source, detail, sure))
    out += [(i, name, kind, source, detail, sure) for name, kind, source, detail, i, sure in r.rows if kind != "method_call"]
    for i, name, kind, source, detail, sure in sorted(out, key=lambda x: (x[0], x[2])):
        yield "reference", name, kind, r.t.line(i), source, detail, sure
