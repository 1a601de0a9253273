"""Declarations and references in the tokens of a text, in one pass with a stack of open scopes.

Languages with braces share one reader and differ by tables; Ruby, Lua, Elixir, Pascal and Bash have readers of their own
over the same stack. A reader never looks back over what it has read, and brackets are matched once, so the work grows
with the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from .lexer import SCRIPT, Tokens, family_of, tokens

#: Kinds whose body makes what is declared in it theirs.
CONTAINERS = frozenset("class interface trait enum struct module".split())
_SCRIPT_TYPES = {"class": "class", "interface": "interface", "enum": "enum", "namespace": "namespace"}
#: Words that declare a type, and its kind.
TYPES = {
    "script": _SCRIPT_TYPES, "php": {"class": "class", "interface": "interface", "trait": "trait", "enum": "enum"}, "java": {"class": "class", "interface": "interface", "enum": "enum", "record": "class"},
    "c-sharp": {"class": "class", "interface": "interface", "enum": "enum", "struct": "struct", "record": "class", "namespace": "namespace"}, "kotlin": {"class": "class", "interface": "interface", "object": "class"},
    "scala": {"class": "class", "object": "class", "trait": "interface"}, "swift": {"class": "class", "actor": "class", "struct": "struct", "protocol": "interface", "enum": "enum", "extension": "class"},
    "dart": {"class": "class", "enum": "enum", "mixin": "trait", "extension": "class"}, "rust": {"struct": "struct", "union": "struct", "trait": "interface", "enum": "enum", "mod": "module", "impl": "class"},
    "go": {}, "c": {"struct": "struct", "union": "struct", "enum": "enum"}, "cpp": {"class": "class", "struct": "struct", "union": "struct", "enum": "enum", "namespace": "namespace"}, "zig": {},
}
#: Words that declare a function.
FUNCTIONS = {"script": ("function",), "php": ("function",), "kotlin": ("fun",), "scala": ("def",), "swift": ("func",), "rust": ("fn",), "go": ("func",), "zig": ("fn",)}
#: Languages whose members and functions have their type, or nothing, before the name.
TYPED = frozenset("java c-sharp dart c cpp".split())
#: Words that declare a value in a type's body or anywhere, and its kind.
VALUES = {"kotlin": {"val": "property", "var": "property", "typealias": "constant"}, "scala": {"val": "constant", "var": "property", "type": "constant"}, "swift": {"let": "property", "var": "property", "typealias": "constant"}, "rust": {"const": "constant", "static": "constant", "type": "constant"}, "zig": {"const": "constant", "var": "constant"}}
MODIFIERS = frozenset(
    "abstract async await base const constexpr crate data declare default delegate event explicit export extern external factory final fileprivate friend get global implicit in infix inline inner internal late lazy let mut mutable native new"
    " noexcept open operator out override package partial private protected pub public readonly ref register required sealed set static strictfp suspend synchronized throws transient unsafe value var virtual volatile where with".split()
)
NOT_CALLS = frozenset(
    "if for while switch catch return function func fn fun def new class match elseif foreach sizeof and or not in is with await typeof throw do else try unless until when case guard"
    " yield assert super base this self import export declare instanceof alignof decltype static_assert noexcept catch sub module impl struct enum union where let var val const".split()
)
_NOT_CALLS_OF = {"php": frozenset("array list isset empty unset echo print include include_once require require_once use exit die".split()), "script": frozenset(("require",)), "c": frozenset(("int", "void", "char", "long")), "go": frozenset("go defer select".split()), "c-sharp": frozenset("using lock fixed checked unchecked".split())}
#: What follows a word that called() takes, words that imported() takes, and punctuation that marked() takes.
_CALLING = frozenset(("(", "<", "::", "!", "{"))
_IMPORTERS = frozenset("import export from require require_once include include_once use part using".split())
_MARKS = frozenset("@[<")
_STOPS = frozenset("if for while switch return throw do else try case".split())


@dataclass
class Symbol:
    name: str
    kind: str
    scope: str | None
    start: int
    end: int


class Reader:
    """What all languages share: the stack of scopes, and what was found."""

    def __init__(self, text: str, language: str):
        self.t: Tokens = tokens(text, language)
        self.language, self.family = language, family_of(language)
        self.n = len(self.t.texts)
        # what word() and at() give
        self.words = [x if k == "w" else "" for k, x in zip(self.t.kinds, self.t.texts)]
        self.marks = [x if k != "s" else "" for k, x in zip(self.t.kinds, self.t.texts)]
        self.symbols: list[Symbol] = []
        self.references: list[tuple[str, str, int]] = []
        self.open: list[tuple[int, Symbol | None]] = []  # where each scope ends, and whose it is
        self.names: set[int] = set()  # places of declared names, which are no calls

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < self.n else ""

    def at(self, i: int) -> str:
        return self.marks[i] if 0 <= i < self.n else ""

    def string(self, i: int) -> str | None:
        return self.t.texts[i].strip("\"'`") if 0 <= i < self.n and self.t.kinds[i] == "s" else None

    def container(self) -> Symbol | None:
        return next((s for _, s in reversed(self.open) if s and s.kind in CONTAINERS), None)

    def direct(self) -> Symbol | None:
        """The type in whose own body this is."""
        s = self.open[-1][1] if self.open else None
        return s if s and s.kind in CONTAINERS else None

    def symbol(self, name: str, kind: str, start: int, end: int, at: int, scope: str | None = None) -> Symbol:
        around = self.container()
        found = Symbol(name, kind, scope if scope is not None else around.name if around else None, start, max(start, min(end, self.n - 1)))
        self.symbols.append(found)
        self.names.add(at)
        return found

    def refer(self, name: str, kind: str, i: int) -> None:
        if name:
            self.references.append((name, kind, i))

    def enter(self, end: int, symbol: Symbol | None) -> None:
        self.open.append((end, symbol))

    def leave(self, i: int) -> None:
        while self.open and self.open[-1][0] < i:
            self.open.pop()

    def read(self) -> Reader:
        raise NotImplementedError


class Braces(Reader):
    """Languages whose scopes are in braces."""

    def __init__(self, text: str, language: str):
        super().__init__(text, language)
        self.close = self.t.closing()
        self.types, self.functions, self.values = TYPES.get(self.family, _SCRIPT_TYPES), FUNCTIONS.get(self.family, ()), VALUES.get(self.family, {})
        self.own = getattr(self, "own_" + self.family.replace("-", "_"), None)
        self.uncalled = NOT_CALLS | _NOT_CALLS_OF.get(self.family, frozenset())
        self.bodies: dict[int, Symbol | None] = {}  # braces that a declaration has announced
        self.starts: set[int] = set()  # what follows annotations and the like

    # --- parts of declarations

    def body(self, i: int, lines: bool = True) -> tuple[int | None, int]:
        """The brace that begins the body of what stands at i, if any, and the last token of the whole. lines: a new line may end it."""
        j = i
        while j < self.n:
            t = self.at(j)
            if t == "{":
                return j, self.close[j]
            if t == ";":
                return None, j
            if t in ("=", "=>") and self.family in ("kotlin", "scala", "dart", "c-sharp", "script", "swift"):
                return self.expression(j + 1)
            if t in ("}", ")", "]") or lines and j > i and self.t.fresh[j] and not self.goes_on(j):
                return None, j - 1
            j = self.close[j] + 1 if t in ("(", "[") else j + 1
        return None, self.n - 1

    def goes_on(self, j: int) -> bool:
        """Whether the line that begins at j belongs to what is before it."""
        return self.at(j) in ("{", ":", ",", "->", "=>", ".", "=") or self.word(j) in ("extends", "implements", "where", "with", "throws", "permits") or self.at(j - 1) in (",", ":", "->", "=>", "=", "|", "&", "(") or self.word(j - 1) in ("extends", "implements", "with")

    def expression(self, i: int) -> tuple[int | None, int]:
        """A value's end: a semicolon, a comma or a closing bracket on its level, or the next line."""
        j = i
        while j < self.n:
            t = self.at(j)
            if t in (";", ","):
                return None, j
            if t in ("}", ")", "]") or j > i and self.t.fresh[j] and t not in (".", "?.", "{", "?", ":", "&&", "||", "=>", "->") and self.at(j - 1) not in ("=", "=>", "(", ",", "&&", "||", "+", "?", ":", "->"):
                return None, j - 1
            j = self.close[j] + 1 if t in ("(", "[", "{") else j + 1
        return None, self.n - 1

    def angles(self, j: int) -> int:
        """Past the type arguments that begin at j."""
        depth = 0
        while j < self.n:
            t = self.at(j)
            if t in ("(", "["):
                j = self.close[j]
            depth += (t == "<") - (t == ">")
            if depth <= 0 or t in ("{", ";"):
                return j + 1
            j += 1
        return j

    def path(self, j: int) -> tuple[str, int]:
        """A name with its dots or colons, and what follows it."""
        out = self.word(j)
        j += 1
        while self.at(j) in (".", "::") and self.word(j + 1):
            out += self.at(j) + self.word(j + 1)
            j += 2
        return out, j

    def heritage(self, i: int, end: int) -> None:
        """Base types between a type's name and its body."""
        mode = None
        j = i
        while j < end:
            t, w = self.at(j), self.word(j)
            if t == "<":
                j = self.angles(j)
                continue
            if t in ("(", "["):
                j = self.close[j] + 1
                continue
            if w in ("extends", "implements", "with"):
                mode = "implements" if w == "implements" else "extends"
            elif w in ("permits", "where", "throws", "on"):
                mode = None
            elif t == ":" and self.family in ("c-sharp", "kotlin", "swift", "cpp"):
                mode = "extends"
            elif w and mode and w not in MODIFIERS:
                name, after = self.path(j)
                kind = "implements" if self.family == "kotlin" and self.at(self.angles(after) if self.at(after) == "<" else after) != "(" else mode
                self.refer(name, kind, j)
                j = after
                continue
            j += 1

    # --- one token at a time

    def read(self) -> Braces:
        i, n, texts, kinds, names, open_ = 0, self.n, self.t.texts, self.t.kinds, self.names, self.open
        script = self.family == "script"
        while i < n:
            while open_ and open_[-1][0] < i:
                open_.pop()
            t, kind = texts[i], kinds[i]
            if kind == "w":
                if i not in names:
                    after = self.declared(i)
                    if after is not None:
                        i = max(after, i + 1)
                        continue
                    if t in _IMPORTERS or t[0] in "#@":
                        self.imported(i)
                    self.called(i)
            elif kind == "p":
                if t in _MARKS:
                    self.marked(i)
                if t in "([{":
                    open_.append((self.close[i], self.bodies.get(i)))
                elif t == "*" and script and self.direct() and self.begins(i):
                    self.starts.add(i + 1)  # a generator
            i += 1
        return self

    def begins(self, i: int) -> bool:
        """Whether a statement or member begins at i."""
        return i == 0 or self.t.fresh[i] or self.at(i - 1) in ("{", "}", ";", ",") or i in self.starts or self.at(i - 1) == "]" and self.family in TYPED

    def announce(self, symbol: Symbol, brace: int | None) -> None:
        if brace is not None:
            self.bodies[brace] = symbol

    def declared(self, i: int) -> int | None:
        """Takes the declaration that the word at i begins; where to go on, or None if there is none."""
        w = self.word(i)
        if self.at(i - 1) in (".", "?.", "::", "->") and w not in ("function",):
            return None
        if w in self.types:
            return self.type_at(i)
        if w in self.functions:
            return self.function_at(i)
        found = self.own(i, w) if self.own else None
        if found is not None:
            return found
        if w in self.values and self.word(i + 1):
            return self.value_at(i)
        if self.family in TYPED and self.begins(i) and (self.direct() or self.family in ("c", "cpp", "dart") and not self.inside_function()):
            return self.typed_at(i)
        return None

    def inside_function(self) -> bool:
        return any(s is None or s.kind in ("function", "method") for _, s in self.open)

    def type_at(self, i: int) -> int | None:
        w, kind = self.word(i), self.types[self.word(i)]
        if self.family == "rust" and w == "impl":
            return self.impl_at(i)
        j = i + 1
        if w == "class" and self.word(i - 1) == "enum":
            kind = "enum"
        while self.word(j) in ("class", "struct") and w == "enum" or self.family == "cpp" and self.at(j) == "[" or w == "record" and self.word(j) in ("class", "struct") or self.family == "kotlin" and w == "object" and self.at(j) == ":":
            j = self.close[j] + 1 if self.at(j) == "[" else j + 1
        if self.family == "kotlin" and self.word(i - 1) == "companion" and w == "object":
            self.bodies[self.body(j)[0] or 0] = self.direct()
        if not self.word(j) or self.word(j) in ("extends", "implements") or w in ("record", "module", "mixin", "extension", "union", "actor", "namespace", "object") and self.at(j) in ("(", "=", "."):
            return None
        if self.family in ("c", "cpp") and w in ("struct", "union", "enum", "class") and self.at(j + 1) not in ("{", ":") and self.word(j + 1) != "final":
            return None  # a type that is only named
        if self.family == "php" and self.at(i - 1) == "::":
            return None
        name, after = self.path(j)
        if kind != "namespace" and self.family not in ("swift", "kotlin"):
            name, after = self.word(j), j + 1
        header = after
        if self.family in ("kotlin", "scala", "c-sharp", "java") and self.at(after) == "(":
            header = self.close[after] + 1  # a constructor's or record's parts
        elif self.at(after) == "<":
            header = self.angles(after)
            header = self.close[header] + 1 if self.at(header) == "(" else header
        brace, end = self.body(header, self.family in ("kotlin", "scala", "swift"))
        symbol = self.symbol(name, kind, self.first(i), end, j)
        self.heritage(after, brace if brace is not None else end + 1)
        self.announce(symbol, brace)
        if kind == "enum" and brace is not None:
            self.enum_cases(brace, symbol)
        return brace if brace is not None and self.family in TYPED else header

    def first(self, i: int) -> int:
        """The declaration's first token: modifiers before a keyword on its line belong to it."""
        while i > 0 and not self.t.fresh[i] and (self.word(i - 1) in MODIFIERS or self.word(i - 1) == "enum"):
            i -= 1
        return i

    def enum_cases(self, brace: int, symbol: Symbol) -> None:
        """Names of an enumeration in the languages that count them as constants."""
        if self.family not in ("java", "c-sharp", "kotlin", "rust"):
            return
        j, begins = brace + 1, True
        while j < self.close[brace]:
            t = self.at(j)
            if t == ";":
                return
            if begins and t in ("@", "#"):
                j = self.close[j + 1] if self.at(j + 1) == "[" else j + 1
                j = self.close[j + 1] if self.at(j + 1) == "(" else j
            elif begins and self.word(j):
                self.symbols.append(Symbol(self.word(j), "constant", symbol.name, j, j))
                self.names.add(j)
                begins = False
            elif t == ",":
                begins = True
            j = self.close[j] + 1 if t in ("(", "[", "{") else j + 1

    def impl_at(self, i: int) -> int | None:
        j = self.angles(i + 1) if self.at(i + 1) == "<" else i + 1
        trait, j = self.path(j)
        j = self.angles(j) if self.at(j) == "<" else j
        name, place = trait, j - 1
        if self.word(j) == "for":
            self.refer(trait.rsplit("::", 1)[-1], "implements", j - 1)
            while self.at(j + 1) in ("&", "'"):
                j += 1
            place = j + 1
            name, j = self.path(j + 1)
        if not name:
            return None
        brace, end = self.body(j, False)
        self.announce(self.symbol(name.rsplit("::", 1)[-1], "class", i, end, place), brace)
        return brace if brace is not None else j

    def function_at(self, i: int) -> int | None:
        j, scope = i + 1, None
        if self.at(j) in ("*", "&"):
            j += 1
        if self.family == "go" and self.at(j) == "(":
            inner = [self.word(k) for k in range(j + 1, self.close[j]) if self.word(k)]
            scope = next((x for x in reversed(inner)), None)
            if "[" in (self.at(k) for k in range(j + 1, self.close[j])):
                scope = next((self.word(k - 1) for k in range(j + 1, self.close[j]) if self.at(k) == "["), scope)
            j = self.close[j] + 1
        if self.family == "kotlin":
            j = self.angles(j) if self.at(j) == "<" else j
            while self.at(j + 1) in (".", "?.", "<") and self.at(j) != "(":
                j = self.angles(j + 1) if self.at(j + 1) == "<" else j + 2
        name = self.word(j)
        if not name or name in ("use",):
            return None  # a function without a name
        k = self.angles(j + 1) if self.at(j + 1) in ("<",) else j + 1
        k = self.close[k] + 1 if self.at(k) == "[" else k
        brace, end = self.body(self.close[k] + 1 if self.at(k) == "(" else k, self.family not in ("php", "rust", "zig"))
        if self.at(k) != "(" and self.family != "scala":
            return None
        direct = self.direct()
        member = bool(scope) or bool(direct) and direct.kind != "module"
        symbol = self.symbol(name, "method" if member else "function", self.first(i), end, j, scope)
        self.announce(symbol, brace)
        return k

    def value_at(self, i: int) -> int | None:
        w, j = self.word(i), i + 1
        if self.word(j) in ("mut", "fn", "unsafe", "async", "class", "case", "lazy") or self.family == "swift" and self.word(i - 1) in ("if", "guard", "while", "case") or self.family == "swift" and self.at(i - 1) == ",":
            return None
        if self.family in ("rust", "zig") and self.inside_function():
            return None
        if self.family == "scala" and self.inside_function():
            return None
        kind = self.values[w]
        k = j + 1
        if self.family == "zig" and self.at(k) == "=":
            k += 1
            while self.word(k) in ("packed", "extern"):
                k += 1
            if self.word(k) in ("struct", "union", "enum", "error", "opaque"):
                brace, end = self.body(k, False)
                symbol = self.symbol(self.word(j), "enum" if self.word(k) == "error" else "struct", self.first(i), end, j)
                self.announce(symbol, brace)
                return brace if brace is not None else k
        end = self.expression(j + 1)[1]
        self.symbol(self.word(j), kind, self.first(i), end, j)
        return j + 1

    def typed_at(self, i: int) -> int | None:
        """A field, method or function that begins with its type."""
        j, at, words, static = i, i, 0, set()
        if self.word(i) in _STOPS or self.word(i) in ("using", "import", "package", "extends", "implements", "throws", "typedef", "template", "goto", "break", "continue", "delete", "namespace", "template", "part", "library"):
            return None
        direct = self.direct()
        while j < self.n:
            t, w = self.at(j), self.word(j)
            if t == "@":
                j = self.path(j + 1)[1]
                j = self.close[j] + 1 if self.at(j) == "(" else j
                continue
            if w:
                if w in self.types or w in _STOPS or w == "operator":
                    return None
                static |= {w} & {"static", "final", "const"}
                words += w not in MODIFIERS
                at = j
                j += 1
            elif t == "<":
                j = self.angles(j)
            elif t in (".", "::", "*", "&", "?", "[", "~"):
                j = self.close[j] + 1 if t == "[" else j + 1
            else:
                break
        t, name = self.at(j), self.word(at)
        if not name or name in NOT_CALLS or name in MODIFIERS and words < 1:
            return None
        if t == "(":
            constructor = bool(direct) and name.lstrip("~") == direct.name
            if words < 2 and not constructor and not (self.family in ("c", "cpp", "dart") and not direct):
                return None
            if self.family == "cpp" and name.startswith("~") and not direct and self.at(at - 1) != "::":
                return None
            brace, end = self.signature_end(self.close[j] + 1)
            if self.family in ("c", "cpp") and brace is None:
                return self.close[j]  # only named
            if self.family == "dart" and not direct and brace is None and self.at(end) != ";":
                return None
            scope = self.word(at - 2) if self.at(at - 1) == "::" else None
            kind = "function" if self.family in ("c", "cpp") or not direct else "method"
            self.announce(self.symbol(name, kind, self.first(i), end, at, scope), brace)
            return j
        if direct and self.family in ("java", "c-sharp") and (words >= 2) and t in ("=", ";", ",", "{", "=>"):
            brace, end = (j, self.close[j]) if t == "{" else self.expression(j + 1) if t in ("=", "=>") else (None, j)
            constant = "const" in static or {"static", "final"} <= static
            self.symbol(name, "constant" if constant else "property", self.first(i), end, at)
            return j
        if self.family == "dart" and not self.inside_function() and not direct and static and t in ("=", ";"):
            self.symbol(name, "constant", self.first(i), self.expression(j + 1)[1], at)
            return j
        return None

    def signature_end(self, j: int) -> tuple[int | None, int]:
        """Past a parameter list: the body, or the end without one."""
        while j < self.n:
            t = self.at(j)
            if t == "{":
                return j, self.close[j]
            if t == ":" and self.family in ("cpp", "dart", "c-sharp"):  # what initialises members
                j += 1
                while j < self.n and self.at(j) not in (";",):
                    if self.at(j) == "{" and not (self.word(j - 1) and self.at(j - 2) in (":", ",")):
                        return j, self.close[j]
                    if self.family == "cpp" and self.word(j):
                        self.names.add(j)
                    j = self.close[j] + 1 if self.at(j) in ("(", "{", "[") else j + 1
                return None, j
            if t == "=>":
                return self.expression(j + 1)
            if t in (";", "="):
                return None, self.expression(j)[1] if t == "=" else j
            if t in ("}", ")", ","):
                return None, j - 1
            j = self.close[j] + 1 if t in ("(", "[") else j + 1
        return None, self.n - 1

    # --- what single languages have

    def own_script(self, i: int, w: str) -> int | None:
        direct = self.direct()
        if direct and direct.kind in ("class", "interface") and self.begins(i) or direct and self.at(i - 1) == ")" and self.t.fresh[i]:
            return self.script_member(i, direct)
        if w in ("const", "let", "var") and self.word(i + 1):
            j = i + 2
            if self.at(j) == ":":
                while j < self.n and self.at(j) not in ("=", ";", "}") and not (self.t.fresh[j] and self.at(j - 1) != "|"):
                    j = self.close[j] + 1 if self.at(j) in ("(", "[", "{") else self.angles(j) if self.at(j) == "<" else j + 1
            if self.at(j) != "=":
                return None
            j += 2 if self.word(j + 1) == "async" and self.word(j + 2) != "" or self.word(j + 1) == "async" and self.at(j + 2) in ("(", "<") else 1
            arrow = j
            if self.at(j) == "<":
                arrow = self.angles(j)
            if self.at(arrow) == "(":
                arrow = self.close[arrow] + 1
                if self.at(arrow) == ":":
                    while arrow < self.n and self.at(arrow) not in ("=>", ";", "}"):
                        arrow = self.close[arrow] + 1 if self.at(arrow) in ("(", "[", "{") else arrow + 1
            elif self.word(j) and self.word(j) != "function":
                arrow = j + 1
            if self.at(arrow) == "=>" or self.word(j) == "function":
                brace, end = (arrow + 1, self.close[arrow + 1]) if self.at(arrow + 1) == "{" and self.at(arrow) == "=>" else self.body(j) if self.word(j) == "function" else self.expression(arrow + 1)
                end = end + 1 if self.at(end + 1) == ";" and not self.t.fresh[end + 1] else end
                symbol = self.symbol(self.word(i + 1), "function", self.first(i), end, i + 1)
                self.announce(symbol, brace)
                return j + 1 if self.word(j) == "function" else j
            return None
        if w == "type" and self.language in ("typescript", "tsx") and self.word(i + 1) and self.at(i + 2) in ("=", "<") and self.begins(self.first(i)):
            k = self.angles(i + 2) if self.at(i + 2) == "<" else i + 2
            if self.at(k) == "=":
                self.symbol(self.word(i + 1), "constant", self.first(i), self.expression(k + 1)[1], i + 1)
                return k + 1
        return None

    def script_member(self, i: int, direct: Symbol) -> int | None:
        j = i
        while self.word(j) in ("public", "private", "protected", "static", "readonly", "async", "get", "set", "abstract", "override", "declare", "accessor") and (self.word(j + 1) or self.at(j + 1) in ("*", "[") or self.t.kinds[min(j + 1, self.n - 1)] == "s"):
            j += 1
        j += self.at(j) == "*"
        name, k = self.word(j), j + 1
        if not name:
            return None
        k += self.at(k) in ("?", "!")
        k = self.angles(k) if self.at(k) == "<" else k
        if self.at(k) == "(":
            brace, end = self.body(self.close[k] + 1)
            if brace is None and direct.kind == "class" and self.language == "javascript":
                return None
            if self.at(self.close[k] + 1) == ":":
                brace, end = self.typed_body(self.close[k] + 2)
            self.announce(self.symbol(name, "method", i, end, j), brace)
            return k
        if direct.kind == "class" and self.language in ("typescript", "tsx", "vue", "svelte") and (self.at(k) in (":", "=", ";", "}") or self.t.fresh[min(k, self.n - 1)]):
            end = self.expression(k + 1)[1] if self.at(k) in (":", "=") else j
            self.symbol(name, "property", i, end, j)
            return k
        return None

    def typed_body(self, j: int) -> tuple[int | None, int]:
        """Past a return type, which may itself have braces."""
        if self.at(j) == "{":
            j = self.close[j] + 1
        return self.body(j)

    def own_php(self, i: int, w: str) -> int | None:
        if w == "namespace" and self.word(i + 1):
            brace, end = self.body(i + 2, False)
            self.symbol(self.word(i + 1), "namespace", i, end, i + 1)
            return i + 2
        if w == "const" and self.word(i + 1):
            j = i + 1
            while self.word(j) and self.word(j + 1):
                j += 1  # a type before the name
            if self.at(j + 1) == "=":
                self.symbol(self.word(j), "constant", self.first(i), self.expression(j + 2)[1], j)
                return j + 1
        if w == "define" and self.at(i + 1) == "(" and self.string(i + 2):
            self.symbol(self.string(i + 2), "constant", i, self.close[i + 1], i + 2)
        if w == "case" and self.direct() and self.direct().kind == "enum" and self.word(i + 1):
            self.symbol(self.word(i + 1), "constant", i, self.expression(i + 2)[1], i + 1)
            return i + 2
        if w.startswith("$") and self.direct() and self.at(i + 1) in ("=", ";", ","):
            self.symbol(w, "property", i, self.expression(i + 2)[1] if self.at(i + 1) == "=" else i + 1, i)
            return i + 1
        return None

    def own_java(self, i: int, w: str) -> int | None:
        if w == "package" and not self.open:
            name, j = self.path(i + 1)
            self.symbol(name, "namespace", i, j, i + 1)
            return j
        return None

    def own_c_sharp(self, i: int, w: str) -> int | None:
        if w == "delegate":
            j = i + 1
            while j < self.n and self.at(j) not in ("(", ";", "{"):
                j = self.angles(j) if self.at(j) == "<" else j + 1
            if self.at(j) == "(" and self.word(j - 1) and j - 1 > i:
                self.symbol(self.word(j - 1), "interface", self.first(i), self.close[j] + 1, j - 1)
                return self.close[j]
        return None

    def own_go(self, i: int, w: str) -> int | None:
        if w == "package" and self.t.fresh[i] and self.word(i + 1):
            self.symbol(self.word(i + 1), "namespace", i, i + 1, i + 1)
            return i + 2
        if w in ("type", "const", "var") and not self.inside_function() and self.t.fresh[i]:
            places, end = ([i + 1], i + 2) if self.at(i + 1) != "(" else (self.lines(i + 2, self.close[i + 1]), i + 2)
            for j in places:
                self.go_spec(w, j, i if self.at(i + 1) != "(" else j)
            return end
        return None

    def lines(self, a: int, b: int) -> list[int]:
        """Places of words that begin a line between a and b, outside inner brackets."""
        out, j = [], a
        while j < b:
            if self.word(j) and (self.t.fresh[j] or self.at(j - 1) in ("(", ";", "{")):
                out.append(j)
            j = self.close[j] + 1 if self.at(j) in ("(", "[", "{") else j + 1
        return out

    def go_spec(self, w: str, j: int, start: int) -> None:
        name = self.word(j)
        if not name:
            return
        if w != "type":
            self.symbol(name, "constant" if w == "const" else "property", start, self.expression(j + 1)[1], j)
            return
        k = self.close[j + 1] + 1 if self.at(j + 1) == "[" and self.word(j + 2) and self.word(j + 3) else j + 1
        k += self.at(k) == "="
        if self.word(k) in ("struct", "interface") and self.at(k + 1) == "{":
            kind = self.word(k)
            self.announce(self.symbol(name, kind, start, self.close[k + 1], j), k + 1)
            if kind == "interface":
                for x in self.lines(k + 2, self.close[k + 1]):
                    base, after = self.path(x)
                    if self.at(after) not in ("(", "|") and (after >= self.n or self.t.fresh[after] or self.at(after) == "}"):
                        self.refer(base, "extends", x)
                    self.names.add(x)
        else:
            self.symbol(name, "constant", start, self.expression(k)[1], j)

    def own_rust(self, i: int, w: str) -> int | None:
        if w == "macro_rules" and self.at(i + 1) == "!" and self.word(i + 2):
            brace, end = self.body(i + 3, False)
            self.symbol(self.word(i + 2), "function", i, end, i + 2)
            return end
        return None

    def own_swift(self, i: int, w: str) -> int | None:
        if w == "init" and self.direct() and self.at(i + 1) in ("(", "?", "<", "!"):
            j = i + 1
            while self.at(j) != "(" and j < self.n - 1:
                j += 1
            brace, end = self.body(self.close[j] + 1)
            self.announce(self.symbol("init", "method", self.first(i), end, i), brace)
            return j
        return None

    def own_scala(self, i: int, w: str) -> int | None:
        if w == "package" and self.word(i + 1) and self.word(i + 1) != "object":
            name, j = self.path(i + 1)
            self.symbol(name, "namespace", i, j - 1, i + 1)
            return j
        return None

    def own_zig(self, i: int, w: str) -> int | None:
        if w == "test" and (self.string(i + 1) is not None or self.word(i + 1)) and not self.open:
            brace, end = self.body(i + 1, False)
            self.announce(self.symbol(self.string(i + 1) or self.word(i + 1), "function", i, end, i + 1), brace)
            return i + 2
        return None

    def own_c(self, i: int, w: str) -> int | None:
        if w.startswith("#"):
            if w.replace(" ", "") == "#define" and self.word(i + 1):
                self.symbol(self.word(i + 1), "constant", i, i + 1, i + 1)
                return self.line_end(i)
            return None
        if w == "typedef":
            end = self.body_end(i + 1)
            if self.word(end - 1):
                self.symbol(self.word(end - 1), "constant", i, end, end - 1)
                return i + 1
            if self.at(end - 1) == ")":  # a pointer to a function
                j = next((j for j in range(i + 1, end) if self.at(j) == "*" and self.at(j - 1) == "(" and self.word(j + 1)), None)
                if j:
                    self.symbol(self.word(j + 1), "constant", i, end, j + 1)
            return end
        return None

    def own_cpp(self, i: int, w: str) -> int | None:
        if w == "using" and self.word(i + 1) and self.at(i + 2) == "=":
            self.symbol(self.word(i + 1), "constant", i, self.expression(i + 3)[1], i + 1)
            return i + 3
        if w == "template" and self.at(i + 1) == "<":
            self.starts.add(self.angles(i + 1))
            return self.angles(i + 1)
        return self.own_c(i, w)

    def line_end(self, i: int) -> int:
        """Past a directive, whose lines may end in a backslash."""
        j = i + 1
        while j < self.n and (not self.t.fresh[j] or self.at(j - 1) == "\\"):
            j += 1
        return j

    def body_end(self, j: int) -> int:
        while j < self.n and self.at(j) != ";":
            j = self.close[j] + 1 if self.at(j) in ("(", "[", "{") else j + 1
        return min(j, self.n - 1)

    # --- references

    def imported(self, i: int) -> None:
        w, family = self.word(i), self.family
        if family == "script":
            if w in ("import", "export") and self.at(i - 1) != ".":
                j, end = i + 1, min(self.n, i + 400)
                if self.string(j) is not None and w == "import":
                    self.refer(self.string(j), "import", j)
                elif w == "import" and self.at(j) == "(":
                    self.refer(self.string(j + 1) or "", "import", j + 1)
                elif self.word(j) or self.at(j) in ("{", "*"):
                    while j < end and self.word(j) != "from" and self.at(j) not in (";", "=", "(") and self.word(j) not in ("class", "function", "const", "let", "var", "interface", "enum", "default"):
                        j = self.close[j] + 1 if self.at(j) == "{" else j + 1
                    if self.word(j) == "from" and self.string(j + 1) is not None:
                        self.refer(self.string(j + 1), "import", i)
            elif w == "require" and self.at(i + 1) == "(":
                self.refer(self.string(i + 2) or "", "require", i)
        elif family == "php":
            if w in ("require", "require_once", "include", "include_once"):
                self.refer(self.string(i + 1) or (self.string(i + 2) if self.at(i + 1) == "(" else None) or "", "require", i)
            elif w == "use" and not self.inside_function() and self.word(i + 1):
                j = i + 2 if self.word(i + 1) in ("function", "const") else i + 1
                kind = "extends" if self.direct() else "import"
                while self.word(j):
                    name = self.word(j).lstrip("\\")
                    if self.at(j + 1) == "{":
                        for k in range(j + 2, self.close[j + 1]):
                            if self.word(k) and self.at(k - 1) in ("{", ","):
                                self.refer(name + self.word(k), kind, k)
                        break
                    self.refer(name, kind, j)
                    j += 3 if self.word(j + 1) == "as" else 1
                    if self.at(j) != ",":
                        break
                    j += 1
        elif w == "import" and family in ("java", "kotlin", "scala", "swift") and self.t.fresh[i]:
            j = i + 2 if self.word(i + 1) == "static" else i + 1
            name, after = self.path(j)
            if self.at(after) == "." and self.at(after + 1) == "{":
                for k in range(after + 2, self.close[after + 1]):
                    if self.word(k) and self.at(k - 1) in ("{", ","):
                        self.refer(f"{name}.{self.word(k)}", "import", k)
            else:
                self.refer(name, "import", i)
        elif w in ("import", "export", "part") and family == "dart":
            self.refer(self.string(i + 1) or "", "import", i)
        elif w == "using" and family == "c-sharp" and self.t.fresh[i] and self.at(i + 1) != "(":
            j = i + 2 if self.word(i + 1) == "static" else i + 3 if self.at(i + 2) == "=" else i + 1
            if self.word(j) not in ("var",) and self.at(self.path(j)[1]) in (";", "<"):
                self.refer(self.path(j)[0], "import", i)
        elif w == "use" and family == "rust":
            self.refer(self.use_path(i + 1), "import", i)
        elif w == "import" and family == "go":
            for j in range(i + 1, self.close[i + 1] if self.at(i + 1) == "(" else i + 3):
                if self.string(j) is not None:
                    self.refer(self.string(j), "import", j)
        elif family in ("c", "cpp") and w.startswith("#") and w.replace(" ", "") in ("#include", "#import"):
            if self.string(i + 1) is not None:
                self.refer(self.string(i + 1), "import", i)
            elif self.at(i + 1) == "<":
                a = self.t.starts[i + 1] + 1
                self.refer(self.t.text[a : self.t.text.find(">", a)], "import", i)
        elif w == "@import" and family == "zig":
            self.refer(self.string(i + 2) or "", "import", i)

    def use_path(self, j: int) -> str:
        out = ""
        while j < self.n and self.at(j) not in (";", "{") and self.word(j) != "as":
            out += self.at(j)
            j += 1
        return out.removesuffix("::")

    def called(self, i: int) -> None:
        w, after, before = self.word(i), self.at(i + 1), self.word(i - 1)
        family = self.family
        if after not in _CALLING and before != "new":
            return
        if before == "new" and family in ("script", "java", "c-sharp", "cpp", "php", "scala", "dart"):
            name, end = self.path(i)
            if w not in ("class", "static", "self") and not w.startswith("$"):
                self.refer(name, "instantiation", i)
                self.names.update(range(i, end))
            return
        if family == "kotlin" and w in ("get", "set") and self.t.fresh[i]:
            return  # a property's
        if self.at(i - 1) not in (".", "?.", "->") and w in self.uncalled or w.startswith(("#", "$", "@")) and family in ("c", "cpp", "php", "zig"):
            return
        if family == "rust" and after == "!" and self.at(i + 2) in ("(", "[", "{"):
            self.refer(w, "call", i)
            return
        if family in ("go", "rust") and after == "{" and w[:1].isupper() and self.at(i - 1) not in (")", "]", "*") and self.literal_before(i):
            self.refer(w, "instantiation", i)
            return
        if after == "<" and family in ("script", "java", "c-sharp", "kotlin", "swift", "cpp", "dart", "rust"):
            end = self.angles(i + 1)
            after = "(" if self.at(end) == "(" and self.at(end - 1) == ">" else after
        elif after == "::" and self.at(i + 2) == "<" and family == "rust":
            after = self.at(self.angles(i + 2))
        if after == "(" or family == "kotlin" and after == "{" and self.at(i - 1) in (".", "?."):
            capital = w[:1].isupper() and self.at(i - 1) not in (".", "?.", "::")
            kind = "instantiation" if capital and family in ("kotlin", "swift", "dart") else "call"
            self.refer(w.rsplit("\\", 1)[-1] if family == "php" else w, kind, i)

    def literal_before(self, i: int) -> bool:
        """Whether a value may stand at i, with the path before it."""
        j = i - 1
        while self.at(j) in (".", "::") and self.word(j - 1):
            j -= 2
        return self.at(j) in ("=", ":=", "(", ",", "&", "[", "{", ":", ";", "=>", "|") or self.word(j) in ("return", "in") or self.at(j) == "}" and self.t.fresh[j + 1]

    def marked(self, i: int) -> None:
        """References that punctuation begins: annotations, attributes, and elements of JSX."""
        t = self.at(i)
        if t == "@" and self.word(i + 1) not in ("", "interface") and self.family in ("java", "kotlin", "scala", "dart", "script", "swift"):
            name, after = self.path(i + 1)
            self.starts.update((after, self.close[after] + 1) if self.at(after) == "(" else (after,))
            if self.family == "java":
                self.refer(name.rsplit(".", 1)[-1], "call", i + 1)
                self.names.update(range(i + 1, after))
        elif t == "[" and self.family == "c-sharp" and self.begins(i) and self.word(i + 1):
            self.refer(self.word(i + 1), "call", i + 1)
            self.names.add(i + 1)
        elif t == "<" and self.family == "script" and self.word(i + 1)[:1].isupper() and not (self.t.kinds[i - 1] == "w" and self.word(i - 1) != "return" or self.at(i - 1) in (")", "]")) and self.at(i + 2) not in (",",) and i:
            name, after = self.path(i + 1)
            follows = self.at(after)
            if follows in ("/", ">") or self.t.kinds[min(after, self.n - 1)] == "w" or follows == "{":
                self.refer(name, "render", i + 1)


class Ends(Reader):
    """Ruby, Lua and Elixir: a word begins what `end` ends."""

    OPENERS = {
        "ruby": frozenset("class module def if unless while until case begin do for".split()),
        "lua": frozenset("function if do repeat".split()),
        "elixir": frozenset("do fn".split()),
    }

    def read(self) -> Ends:
        self.ends = self.matched()
        for i in range(self.n):
            self.leave(i)
            if self.t.kinds[i] == "w" and i not in self.names:
                getattr(self, self.language)(i, self.word(i))
        return self

    def opens(self, i: int) -> bool:
        w = self.word(i)
        if w not in self.OPENERS[self.language] or self.at(i - 1) in (".", "::") or self.at(i + 1) == ":" and self.language == "ruby" and self.at(i + 2) != ":":
            return False
        if self.language == "ruby":
            if w in ("if", "unless", "while", "until"):
                return self.t.fresh[i] or self.at(i - 1) in ("=", "(", ";", "||", "&&", "[", ",") or self.word(i - 1) in ("then", "else", "do", "return", "begin")
            if w == "do":
                j = i - 1
                while j >= 0 and not self.t.fresh[j + 1]:
                    if self.word(j) in ("while", "until", "for") and self.t.fresh[j]:
                        return False  # the loop's own
                    j -= 1
            if w == "def":
                return not self.endless(i)
            if w == "class" and self.at(i + 1) == "<":
                return True
        if self.language == "lua" and w == "do":
            j = i - 1
            while j >= 0 and self.word(j) not in ("while", "for", "end", "do", "then") and i - j < 200:
                j -= 1
            return True if self.word(j) not in ("while", "for") else True
        return True

    def endless(self, i: int) -> bool:
        """def f(x) = value"""
        j = i + 1
        while j < self.n and not self.t.fresh[j]:
            if self.at(j) == "=" and self.at(j - 1) == ")" and self.at(j + 1) not in ("=", "~", ">"):
                return True
            j += 1
        return False

    def matched(self) -> dict[int, int]:
        out, open_ = {}, []
        for i in range(self.n):
            w = self.word(i)
            if self.opens(i):
                open_.append(i)
            elif (w == "end" and self.at(i - 1) != "." or w == "until" and self.language == "lua") and open_:
                out[open_.pop()] = i
        for i in open_:
            out[i] = self.n - 1
        return out

    def dotted(self, j: int) -> tuple[str, int]:
        out = self.word(j)
        j += 1
        while self.at(j) in (".", "::", ":") and self.word(j + 1) and not self.t.fresh[j + 1]:
            out += self.at(j) + self.word(j + 1)
            j += 2
        return out, j

    def ruby(self, i: int, w: str) -> None:
        end = self.ends.get(i)
        if w in ("class", "module") and end is not None and self.word(i + 1):
            name, j = self.dotted(i + 1)
            symbol = self.symbol(name.rsplit("::", 1)[-1], w, i, end, i + 1)
            self.names.update(range(i + 1, j))
            if w == "class" and self.at(j) == "<" and self.word(j + 1):
                base, _ = self.dotted(j + 1)
                self.refer(base, "extends", j + 1)
            self.enter(end, symbol)
        elif w == "def" and self.word(i + 1):
            j = i + 3 if self.at(i + 2) == "." else i + 1
            last = end if end is not None else self.line_last(i)
            around = self.container()
            self.enter(last, self.symbol(self.word(j), "method" if around else "function", i, last, j))
            self.names.update((i + 1, j))
        elif end is not None:
            self.enter(end, None)
        elif w[:1].isupper() and self.at(i + 1) == "=" and self.at(i + 2) not in ("=", "~", ">") and self.t.fresh[i]:
            self.symbol(w, "constant", i, self.line_last(i), i)
        elif w in ("attr_reader", "attr_writer", "attr_accessor") and self.direct():
            j = i + 1
            while self.word(j).startswith(":"):
                self.symbol(self.word(j)[1:], "property", i, j, j)
                j += 2 if self.at(j + 1) == "," else 1
        elif w in ("require", "require_relative", "load") and self.string(i + 1 + (self.at(i + 1) == "(")) is not None:
            self.refer(self.string(i + 1 + (self.at(i + 1) == "(")), "require", i)
        elif w in ("include", "extend", "prepend") and self.word(i + 1)[:1].isupper():
            self.refer(self.dotted(i + 1)[0], "extends", i)
        elif self.at(i + 1) == "." and self.word(i + 2) == "new" and w[:1].isupper():
            self.refer(w, "instantiation", i)
            self.names.add(i + 2)
        elif (self.at(i + 1) == "(" and not self.t.fresh[i + 1] or self.at(i - 1) in (".", "&.") and w[:1].islower()) and w not in NOT_CALLS and not w.startswith((":", "@", "$")) and w not in ("end", "class"):
            self.refer(w, "call", i)

    def line_last(self, i: int) -> int:
        j = i + 1
        while j < self.n and not self.t.fresh[j]:
            j += 1
        return j - 1

    def lua(self, i: int, w: str) -> None:
        end = self.ends.get(i)
        if w == "function" and end is not None:
            name, j = self.dotted(i + 1) if self.word(i + 1) else ("", i + 1)
            symbol = None
            if name:
                head, _, last = name.replace(":", ".").rpartition(".")
                symbol = self.symbol(last, "method" if ":" in name else "function", i - (self.word(i - 1) == "local"), end, i + 1, head or None)
                self.names.update(range(i + 1, j))
            self.enter(end, symbol)
        elif end is not None:
            self.enter(end, None)
        elif self.at(i + 1) == "=" and self.at(i + 2) != "=" and self.at(i - 1) not in ("=", ".", ":", ",", "{", "(") and not self.open and w not in NOT_CALLS and (self.t.fresh[i] or self.word(i - 1) == "local"):
            kind = "function" if self.word(i + 2) == "function" else "constant"
            self.symbol(w, kind, i - (self.word(i - 1) == "local"), self.ends.get(i + 2, self.line_last(i)), i)
        elif w == "require" and self.string(i + 1 + (self.at(i + 1) == "(")) is not None:
            self.refer(self.string(i + 1 + (self.at(i + 1) == "(")).strip("[]="), "require", i)
        elif (self.at(i + 1) in ("(", "{") or self.string(i + 1) is not None and not self.t.fresh[i + 1]) and w not in NOT_CALLS and w not in ("end", "then", "local", "elseif", "repeat", "nil", "true", "false"):
            if self.at(i + 1) != "{" or self.at(i - 1) in (".", ":"):
                self.refer(w, "call", i)

    def elixir(self, i: int, w: str) -> None:
        if i in self.ends:
            self.enter(self.ends[i], self.begun.pop(i, None) if hasattr(self, "begun") else None)
            return
        self.begun = getattr(self, "begun", {})
        kinds = {"defmodule": "module", "defprotocol": "interface", "def": "function", "defp": "function", "defmacro": "function", "defmacrop": "function", "defimpl": "implements", "defstruct": "struct"}
        if w in kinds and self.at(i - 1) != ".":
            do = self.do_of(i)
            end = self.ends.get(do, self.line_last(i)) if do else self.line_last(i)
            if w == "defimpl":
                self.refer(self.dotted(i + 1)[0], "implements", i)
            elif w == "defstruct":
                around = self.container()
                self.symbol(around.name.rsplit(".", 1)[-1] if around else "struct", "struct", i, end, i)
            elif self.word(i + 1):
                name, j = self.dotted(i + 1) if w in ("defmodule", "defprotocol") else (self.word(i + 1), i + 2)
                symbol = self.symbol(name, kinds[w], i, end, i + 1)
                self.names.update(range(i + 1, j))
                if do:
                    self.begun[do] = symbol
        elif w in ("alias", "import", "require", "use") and self.word(i + 1)[:1].isupper() and self.t.fresh[i]:
            name, j = self.dotted(i + 1)
            self.names.update(range(i + 1, j))
            if self.at(j) == "." and self.at(j + 1) == "{":
                k = j + 2
                while k < self.n and self.at(k) != "}":
                    if self.word(k):
                        self.refer(f"{name}.{self.word(k)}", "import", k)
                    k += 1
            else:
                self.refer(name, "extends" if w == "use" else "import", i)
        elif w.startswith("@") and self.direct() and self.t.fresh[i] and w not in ("@moduledoc", "@doc", "@spec", "@type", "@typep", "@impl", "@behaviour", "@callback", "@opaque", "@derive", "@typedoc"):
            self.symbol(w[1:], "constant", i, self.line_last(i), i)
        elif (self.at(i + 1) == "(" and not self.t.fresh[i + 1] or self.at(i - 1) == "|>") and w[:1].islower() and w not in NOT_CALLS and not w.endswith(":") and w not in ("end", "cond", "receive", "quote", "unquote", "rescue"):
            self.refer(self.dotted(i)[0].rsplit(".", 1)[-1] if self.at(i - 1) == "|>" else w, "call", i)

    def do_of(self, i: int) -> int | None:
        """The `do` of a definition; none if it has `do:`."""
        j, depth = i + 1, 0
        while j < self.n:
            t = self.at(j)
            depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            if depth == 0 and self.word(j) == "do":
                return j
            if depth == 0 and (self.word(j) == "do:" or j > i + 1 and self.t.fresh[j] and self.word(j) in ("def", "defp", "defmodule", "end", "@doc") or j - i > 400):
                return None
            j += 1
        return None


class Bash(Reader):
    def read(self) -> Bash:
        self.close, i = self.t.closing(), 0
        while i < self.n:
            self.leave(i)
            w, t = self.word(i), self.t.texts[i]
            command = self.t.fresh[i] or self.at(i - 1) in (";", "|", "||", "&&", "(", "{", "&", "`") or self.word(i - 1) in ("then", "do", "else", "if", "while", "until", "!", "sudo", "exec")
            if w == "function" and self.word(i + 1) or w and self.at(i + 1) == "(" and self.at(i + 2) == ")" and command:
                j = i + 1 if w == "function" else i
                k = j + 3 if self.at(j + 1) == "(" else j + 1
                end = self.close[k] if self.at(k) in ("{", "(") else j
                symbol = self.symbol(self.word(j), "function", i, end, j)
                if self.at(k) in ("{", "("):
                    self.enter(end, symbol)
                    k += 1
                i = k
                continue
            if w and command:
                if w in ("source", ".") and i + 1 < self.n and not self.t.fresh[i + 1]:
                    self.refer(self.word(i + 1) or self.string(i + 1) or "", "import", i)
                elif w == "alias" and self.word(i + 1):
                    self.symbol(self.word(i + 1), "constant", i, i + 1, i + 1)
                    i += 1
                elif self.at(i + 1) == "=" and self.t.starts[i + 1] == self.t.starts[i] + len(w):
                    self.symbol(w, "constant", i, i + 1, i)
                    i += 2 if i + 2 < self.n and not self.t.fresh[i + 2] and self.at(i + 2) != "$" else 1
                    continue
                elif w in ("export", "local", "readonly", "declare") and self.at(i + 2) == "=":
                    self.symbol(self.word(i + 1), "constant", i, i + 2, i + 1)
                    i += 2
                elif w not in ("if", "then", "else", "elif", "fi", "for", "while", "until", "do", "done", "case", "esac", "in", "function", "return", "export", "local", "readonly", "declare", "exit", "shift", "break", "continue", "set", "unset", "select", "time", "true", "false"):
                    self.refer(w, "call", i)
            i += 1
        return self


class Pascal(Reader):
    """Sections, and `begin` or a type's words up to `end`; words without case."""

    def word(self, i: int) -> str:
        return super().word(i).lower()

    def name(self, i: int) -> str:
        return super().word(i)

    def read(self) -> Pascal:
        section, i = None, 0
        ends = self.matched()
        while i < self.n:
            self.leave(i)
            w = self.word(i)
            if w in ("unit", "program", "library") and not self.symbols and self.name(i + 1):
                self.symbol(self.name(i + 1), "module", i, self.n - 1, i + 1)
                i += 2
                continue
            if w in ("type", "const", "var", "resourcestring", "threadvar") and self.at(i - 1) != "=":
                section = w
            elif w in ("implementation", "interface", "begin", "initialization", "finalization") and self.at(i - 1) != "=":
                section = None if w != "begin" else "code"
            elif w == "uses":
                j = i + 1
                while self.name(j):
                    name = self.name(j)
                    while self.at(j + 1) == "." and self.name(j + 2):
                        name, j = f"{name}.{self.name(j + 2)}", j + 2
                    self.refer(name, "import", j)
                    j += 1
                    if self.word(j) == "in":
                        j += 2
                    if self.at(j) != ",":
                        break
                    j += 1
                i = j
                continue
            if w in ("procedure", "function", "constructor", "destructor", "operator") and self.name(i + 1):
                j, scope = i + 1, None
                while self.at(j + 1) == "." and self.name(j + 2):
                    scope, j = self.name(j), j + 2
                end = next((ends[k] for k in (self.begin_of(j),) if k in ends), self.semicolon(j))
                inside = self.container()
                member = scope is not None or inside is not None and inside.kind != "module"
                self.symbol(self.name(j), "method" if member else "function", i, end, j, scope if scope is not None else None)
                section = None if not member else section
                i = j
            elif section in ("type", "const", "var") and self.name(i) and w not in ("begin", "end", section) and (self.t.fresh[i] or self.at(i - 1) in (";",) or self.word(i - 1) == section) and self.at(i + 1) in ("=", ":"):
                i = self.declared(i, section, ends)
                continue
            elif self.name(i) and self.at(i + 1) == "(" and section == "code" and w not in NOT_CALLS and i not in self.names and w not in ("begin", "then", "of", "until"):
                kind = "instantiation" if w == "create" and self.at(i - 1) == "." else "call"
                self.refer(self.name(i - 2) if kind == "instantiation" else self.name(i), kind, i)
            i += 1
        return self

    def declared(self, i: int, section: str, ends: dict[int, int]) -> int:
        if section == "type":
            j = i + 2 + (self.word(i + 2) == "packed")
            kind = {"class": "class", "record": "struct", "object": "class", "interface": "interface"}.get(self.word(j), "enum" if self.at(j) == "(" else "constant")
            end = ends.get(j, self.semicolon(i))
            symbol = self.symbol(self.name(i), kind, i, end, i)
            if kind in ("class", "interface") and self.at(j + 1) == "(":
                k, mode = j + 2, "extends"
                while k < self.n and self.at(k) != ")":
                    if self.name(k):
                        self.refer(self.name(k), mode, k)
                        mode = "implements" if kind == "class" else "extends"
                    k += 1
            if j in ends:
                self.enter(end, symbol)
            return j + 1
        self.symbol(self.name(i), "constant" if section == "const" else "property", i, self.semicolon(i), i)
        return self.semicolon(i)

    def semicolon(self, i: int) -> int:
        depth = 0
        while i < self.n:
            depth += (self.at(i) == "(") - (self.at(i) == ")")
            if self.at(i) == ";" and depth <= 0:
                return i
            i += 1
        return self.n - 1

    def begin_of(self, i: int) -> int | None:
        """The begin of a routine's body, if it has one before the next routine or section."""
        i = self.semicolon(i) + 1
        while i < self.n:
            if self.word(i) == "begin":
                return i
            if self.word(i) in ("procedure", "function", "constructor", "destructor", "end", "implementation", "private", "public", "protected", "published", "property", "forward"):
                return None
            i += 1
        return None

    def matched(self) -> dict[int, int]:
        out, open_ = {}, []
        for i in range(self.n):
            w = self.word(i)
            if w in ("begin", "case", "try", "record", "asm") or w in ("class", "interface", "object") and self.at(i - 1) == "=" and self.at(i + 1) not in (";",) and self.word(i + 1) != "of" and not self.bare(i):
                open_.append(i)
            elif w == "end" and open_:
                out[open_.pop()] = i
        return out

    def bare(self, i: int) -> bool:
        """class(Base); without a body"""
        j = i + 1
        if self.at(j) != "(":
            return False
        while j < self.n and self.at(j) != ")":
            j += 1
        return self.at(j + 1) == ";"


READERS = {"ruby": Ends, "lua": Ends, "elixir": Ends, "bash": Bash, "pascal": Pascal}


def read(text: str, language: str) -> Reader:
    return READERS.get(language, Braces)(text, language).read()


def found(text: str, language: str) -> Iterator[tuple]:
    """("symbol", name, kind, scope, the line it begins on, its number, that of its last line) and ("reference", name, kind, line)."""
    r = read(text, language)
    for s in sorted(r.symbols, key=lambda s: (s.start, -s.end)):
        yield "symbol", s.name, s.kind, s.scope, r.t.line_text(s.start), r.t.line(s.start), r.t.last_line(s.end)
    for name, kind, i in sorted(r.references, key=lambda x: x[2]):
        yield "reference", name, kind, r.t.line(i)


__all__ = ["CONTAINERS", "SCRIPT", "found", "read"]
