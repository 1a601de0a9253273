"""Tokens of source texts.

One pass over a text, with the states that each family of languages has: comments (nested where they nest), strings, raw
strings, heredocs, templates with code inside, and regular expressions, which only where a value may begin are no
division. What is left are words, strings, numbers and punctuation, each with its place and whether a line begins with it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

SCRIPT = frozenset("javascript typescript tsx vue svelte".split())

_SLASHES, _BLOCK = r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)', r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
_LONG_DOUBLE, _LONG_SINGLE = r'"(?:\\.|[^"\\])*(?:"|\Z)', r"'(?:\\.|[^'\\])*(?:'|\Z)"
_TRIPLE, _TRIPLE_SINGLE = r'"""[\s\S]*?(?:"""|\Z)', r"'''[\s\S]*?(?:'''|\Z)"
_CHAR = r"'(?:\\.[^'\n]{0,8}|[^'\\\n])'"

#: Comments and strings of each language; those named first count first.
_SKIPPED = {
    "java": (_SLASHES, _BLOCK), "c-sharp": (_SLASHES, _BLOCK, r"(?m:^[ \t]*#[^\n]*)"), "go": (_SLASHES, _BLOCK), "c": (_SLASHES, _BLOCK), "cpp": (_SLASHES, _BLOCK), "rust": (_SLASHES, r"'[A-Za-z_]\w*\b(?!')"), "swift": (_SLASHES,),
    "kotlin": (_SLASHES,), "scala": (_SLASHES,), "dart": (_SLASHES,), "zig": (_SLASHES,), "php": (_SLASHES.replace(r"[^\n]*", r"(?:(?!\?>)[^\n])*"), r"#(?!\[)(?:(?!\?>)[^\n])*", _BLOCK, r"\?>[\s\S]*?(?:<\?(?:php\b|=)|\Z)"),
    "ruby": (r"#[^\n]*", r"(?m:^=begin\b[\s\S]*?(?:^=end\b[^\n]*|\Z))", r"(?m:^__END__$)[\s\S]*"), "lua": (r"--\[(?P<lc>=*)\[[\s\S]*?(?:\](?P=lc)\]|\Z)", r"--[^\n]*"), "elixir": (r"#[^\n]*",), "bash": (r"(?<![^\s;&|(])#[^\n]*",),
    "pascal": (_SLASHES, r"\{[^}]*(?:\}|\Z)", r"\(\*[\s\S]*?(?:\*\)|\Z)"), "script": (_SLASHES, _BLOCK, r"\A#![^\n]*"),
}
_STRINGS = {
    "java": (_TRIPLE, _DOUBLE, _CHAR), "c-sharp": (r'\$?@\$?"(?:""|[^"])*(?:"|\Z)', _TRIPLE, r"\$?" + _DOUBLE, _CHAR), "go": (r"`[^`]*(?:`|\Z)", _DOUBLE, _CHAR), "c": (_DOUBLE, _CHAR), "cpp": (r'R"(?P<rd>[^()\s\\]{0,16})\([\s\S]*?(?:\)(?P=rd)"|\Z)', _DOUBLE, _CHAR),
    "rust": (r'b?r(?P<rr>#*)"[\s\S]*?(?:"(?P=rr)|\Z)', "b?" + _LONG_DOUBLE, "b?" + _CHAR), "swift": (_TRIPLE, _DOUBLE), "kotlin": (_TRIPLE, _DOUBLE, _CHAR), "scala": (_TRIPLE, _DOUBLE, _CHAR), "dart": (_TRIPLE, _TRIPLE_SINGLE, r'r"[^"\n]*"', r"r'[^'\n]*'", _DOUBLE, _SINGLE),
    "zig": (r"\\\\[^\n]*", _DOUBLE, _CHAR), "php": (r"<<<[ \t]*(?P<q>[\"']?)(?P<hd>[A-Za-z_]\w*)(?P=q)\n[\s\S]*?(?:\n[ \t]*(?P=hd)\b|\Z)", _LONG_DOUBLE, _LONG_SINGLE, r"`[^`]*(?:`|\Z)"),
    "ruby": (r"<<[~-]?(?P<q>[\"']?)(?P<hd>[A-Z_]\w*)(?P=q)[^\n]*\n[\s\S]*?(?:\n[ \t]*(?P=hd)\b|\Z)", r"%[qQwWiIr]?(?:\[[^\]]*\]|\{[^}]*\}|\([^)]*\)|<[^>]*>|\|[^|]*\|)", _LONG_DOUBLE, _LONG_SINGLE, r"`[^`]*(?:`|\Z)"), "lua": (r"\[(?P<ls>=*)\[[\s\S]*?(?:\](?P=ls)\]|\Z)", _DOUBLE, _SINGLE),
    "elixir": (_TRIPLE, _TRIPLE_SINGLE, r"~[a-zA-Z]+(?:\"\"\"[\s\S]*?\"\"\"|\[[^\]]*\]|\{[^}]*\}|\([^)]*\)|<[^>]*>|/(?:\\.|[^/\\])*/|\|[^|]*\||\"(?:\\.|[^\"\\])*\")[a-z]*", _LONG_DOUBLE, _LONG_SINGLE),
    "bash": (r"<<-?[ \t]*(?P<q>[\"']?)(?P<hd>\w+)(?P=q)[^\n]*\n[\s\S]*?(?:\n[ \t]*(?P=hd)(?=\n|\Z)|\Z)", _LONG_DOUBLE, r"'[^']*(?:'|\Z)"), "pascal": (r"'(?:''|[^'\n])*(?:'|(?=\n)|\Z)",), "script": (_DOUBLE, _SINGLE),
}
_WORDS = {"php": r"\$?[A-Za-z_\\\x80-\uffff][\w\\]*", "ruby": r"(?:@@?|\$|:(?!:))?[A-Za-z_][\w]*[?!]?", "elixir": r"(?:@|:(?!:))?[A-Za-z_][\w]*[?!]?(?::(?!:))?", "bash": r"[A-Za-z_./~][\w./~+-]*", "script": r"#?[A-Za-z_$\x80-\uffff][\w$]*", "c": r"#\s*[a-z]+|[A-Za-z_]\w*", "cpp": r"#\s*[a-z]+|~?[A-Za-z_]\w*", "zig": r"@?[A-Za-z_]\w*", "rust": r"(?:r#)?[A-Za-z_]\w*"}
#: Languages whose block comments nest.
_NESTED = frozenset("rust swift kotlin scala dart".split())
_PUNCTUATION = r"::|=>|->|\?\.|&&|\|\||\|>|\.\.\.|:=|[^\s\w]"
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: After these words a slash begins a regular expression.
_BEFORE_VALUE = frozenset("return typeof case in of delete void instanceof new do else throw yield await and or not if unless when elsif while until then puts".split())


@dataclass
class Tokens:
    """kind (w word, s string, n number, p punctuation), text and place of each token; fresh: a line begins with it."""

    text: str
    kinds: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    fresh: list[bool] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.lines = [m.end() for m in re.finditer("\n", self.text)]

    def line(self, i: int) -> int:
        """The line, from 1, of token i."""
        return bisect_right(self.lines, self.starts[i]) + 1

    def last_line(self, i: int) -> int:
        """The line that token i ends on."""
        return bisect_right(self.lines, self.starts[i] + len(self.texts[i]) - 1) + 1

    def line_text(self, i: int) -> str:
        begin = self.text.rfind("\n", 0, self.starts[i]) + 1
        end = self.text.find("\n", self.starts[i])
        return self.text[begin : end if end >= 0 else len(self.text)]

    def closing(self) -> list[int]:
        """For each opening bracket the place of the one that closes it; of others, their own. Unclosed ones reach the end."""
        out, open_, pair = list(range(len(self.texts))), [], {")": "(", "]": "[", "}": "{"}
        for i, t in enumerate(self.texts):
            if t not in _BRACKETS or self.kinds[i] != "p":
                continue
            if t in "([{":
                open_.append(i)
            elif any(self.texts[j] == pair[t] for j in open_[-3:]):
                while self.texts[open_[-1]] != pair[t]:
                    out[open_.pop()] = i - 1  # never closed
                out[open_.pop()] = i
        for i in open_:
            out[i] = len(out) - 1
        return out


_BRACKETS = frozenset("()[]{}")
_KINDS = frozenset("swnp")
_SPACE = re.compile(r"\s*")
_compiled: dict[str, re.Pattern] = {}


def _pattern(family: str) -> re.Pattern:
    if family not in _compiled:
        skip, strings = (t.get(family, t["java"]) for t in (_SKIPPED, _STRINGS))
        word = _WORDS.get(family, r"[A-Za-z_\x80-\uffff]\w*")
        _compiled[family] = re.compile(rf"(?:(?P<skip>{'|'.join(skip)})|(?P<s>{'|'.join(strings)})|(?P<w>{word})|(?P<n>\d[\w.]*)|(?P<p>{_PUNCTUATION}))\s*")
    return _compiled[family]


def family_of(language: str) -> str:
    return "script" if language in SCRIPT else language


def _nested_end(text: str, at: int) -> int:
    """Past the block comment that begins at `at` and may hold others."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def tokens(text: str, language: str) -> Tokens:
    family = family_of(language)
    out, match, at, n = Tokens(text), _pattern(family).match, 0, len(text)
    script, slash = family == "script", family in ("script", "ruby")
    nested = family in _NESTED and "/*" in text
    kinds, texts, starts, fresh = out.kinds, out.texts, out.starts, out.fresh
    templates: list[int] = []  # of each template that a ${ has left, how many braces are open in it
    if family == "php" and "<?" in text:
        m = re.search(r"<\?(?:php\b|=)", text)
        at = m.end() if m else n
    before = 0  # where the token before ended
    at = _SPACE.match(text, at).end()
    while at < n:
        c = text[at]
        kind = None
        if c == "/":
            if nested and text.startswith("/*", at):
                at = _SPACE.match(text, _nested_end(text, at)).end()
                continue
            if slash and not text.startswith("//", at) and _value_expected(out) and (m := _REGEX.match(text, at)):
                kind, token = "s", m.group()
        elif script and (c == "`" or c == "}" and templates and templates[-1] == 0):
            if c == "}":
                templates.pop()
            end = _template_end(text, at + 1)
            kind, token = "s", text[at:end]
            if text.startswith("${", end - 2) and end - 2 > at - 1 and not text.endswith("`", at, end):
                templates.append(0)
        elif templates and c in "{}":
            templates[-1] += 1 if c == "{" else -1
        if kind:
            after = _SPACE.match(text, at + len(token)).end()
        else:
            m = match(text, at)
            if m is None:
                at = _SPACE.match(text, at + 1).end()
                continue
            kind, after = m.lastgroup, m.end()
            if kind == "skip":
                at = after
                continue
            if kind not in _KINDS:
                kind = "s" if m["s"] is not None else None
                if not kind:
                    at = after
                    continue
            token = m[kind]
        fresh.append(not starts or text.find("\n", before, at) >= 0)
        kinds.append(kind)
        texts.append(token)
        starts.append(at)
        before = at + len(token)
        at = after
    return out


def _value_expected(out: Tokens) -> bool:
    if not out.texts:
        return True
    kind, t = out.kinds[-1], out.texts[-1]
    return t in _BEFORE_VALUE if kind == "w" else kind == "p" and t not in (")", "]", "}", "<")  # </p> closes an element


def _template_end(text: str, at: int) -> int:
    """Past the backquote, or the ${ , that ends this part of a template."""
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1
        elif c == "$" and text.startswith("${", at):
            return at + 2
        else:
            at += 1
    return len(text)
