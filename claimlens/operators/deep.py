"""Deep mode: specifiers found by syntax instead of by pattern alone.

`deep_full` reads comments, strings, templates and regular expressions as wholes,
by one scanning pattern in the JVM, and yields the literals of require calls,
dynamic imports and static imports and exports. Bodies that one pattern cannot scan
(substitutions in templates, regular expressions after a bracket, brackets around a
callee or an argument, escapes in a specifier) go through the lexer below.

`deep_strict` keeps to the places that a walk over statements, calls, function
bodies, let/const initialisers, assignments, if, for and return reaches. It is a
lexer and descent in Python over batches, and answers null where the text is no
plain script (module syntax, or what it cannot read), for which the pattern of
regex mode is used. Lexer and descent keep their own stacks, so that templates,
brackets and statements of any depth are read alike. Specifiers are the values of
their literals: escapes are decoded.
"""

from __future__ import annotations

import re
from collections.abc import Generator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from claimlens.functions.names import regex_references

_TEXT = r"'(?:[^'\\\n]|\\[\s\S])*+'|\"(?:[^\"\\\n]|\\[\s\S])*+\""
#: Group 1 is the quoted specifier; what else matches is passed over as a whole.
_SCAN = (
    r"//[^\n]*+|/\*[\s\S]*?\*/"
    rf"|(?<![\w$.])(?:require\s*+\(\s*+|import\s*+\(\s*+|import\s*+|from\s*+)({_TEXT})"
    rf"|{_TEXT}|`(?:[^`\\]|\\[\s\S])*+`"
    r"|(?<=[=(,:;!&|?{}\[\n])[\t ]*+/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
)


def full_references(body: Column) -> Column:
    """The specifiers of all calls and module statements, in order, as written between the quotes."""
    quoted = F.filter(F.regexp_extract_all(body, F.lit(_SCAN), F.lit(1)), lambda x: x != "")
    return F.transform(quoted, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\")|(?P<template>`(?:[^`\\]|\\.)*`)"
    r"|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<mark>=>|\+\+|--|\*\*=?|[<>]{1,3}=?|[=!]==?|&&=?|\|\|=?|\?\?=?|\?\.|\.{3}|[-+*/%&|^]=|[^\s\w])",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_PAIR = {"(": ")", "[": "]", "{": "}"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "&&=", "||=", "??="}


class _Unreadable(Exception):
    pass


#: A step of the descent: it yields the steps inside it and is sent what they return.
Step = Generator["Step", Any, Any]


def _finished(step: Step) -> None:
    """Run a step and all that it yields."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value


_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
#: A bracket after these is a head: a regular expression may follow it.
_HEADS = {"if", "while", "for", "with"}
#: What stands before a block's brace; after the block a regular expression may follow.
_BEFORE_BLOCK = {"", ";", "{", "}", ")", "=>", "else", "do", "try", "finally"}
#: Names that are no operands.
_OPERATORS = {"return", "typeof", "case", "in", "of", "delete", "void", "instanceof", "new", "do", "else", "await", "yield", "throw"}


class _Lexer:
    """Tokens of a script: a pushdown over brackets and templates, so that `${...}` nests to any depth.

    A template is one token; with `inside`, the tokens of its substitutions stand
    before it, each substitution closed by a semicolon.
    """

    def __init__(self, text: str, inside: bool = False):
        self.text, self.inside = text, inside
        self.out: list[tuple[str, str, bool]] = []
        self.line = False  # whether a line has ended since the last token
        self.brackets: list[bool] = []  # of each open one, whether it ends like a statement: a head or a block
        self.templates: list[tuple[int, int, int, bool]] = []  # start, tokens and brackets before it, line
        self.ended = True  # whether the last token ends like a statement

    def tokens(self) -> list[tuple[str, str, bool]]:
        at = 0
        while at < len(self.text):
            at = self._step(at)
        if self.templates:
            raise _Unreadable
        return self.out

    def _put(self, kind: str, text: str, ended: bool = False) -> None:
        self.out.append((kind, text, self.line))
        self.line, self.ended = False, ended

    def _value(self) -> bool:
        """Whether the last token is an operand, so that a slash after it divides."""
        if not self.out:
            return False
        kind, x, _ = self.out[-1]
        if kind == "mark":
            return x == "]" or x in (")", "}") and not self.ended
        return kind != "name" or x not in _OPERATORS

    def _step(self, at: int) -> int:
        c = self.text[at]
        if c == "`":
            self.templates.append((at, len(self.out), len(self.brackets), self.line))
            return self._template(at + 1)
        if c == "}" and self.templates and len(self.brackets) == self.templates[-1][2]:
            if self.inside:
                self._put("mark", ";")
            return self._template(at + 1)
        m = _REGEX.match(self.text, at) if c == "/" and not self._value() else None
        kind = "regex" if m else None
        m = m or _TOKEN.match(self.text, at)
        if not m or (not kind and m.group() in "'\"`"):
            raise _Unreadable
        kind, x = kind or m.lastgroup, m.group()
        if kind == "space":
            self.line |= "\n" in x
        elif kind == "mark" and x in _PAIR:
            before = self.out[-1][1] if self.out else ""
            member = len(self.out) > 1 and self.out[-2][1] in (".", "?.")
            self.brackets.append(before in _HEADS and not member if x == "(" else x == "{" and before in _BEFORE_BLOCK)
            self._put(kind, x)
        elif kind == "mark" and x in ")]}":
            if not self.brackets:
                raise _Unreadable
            self._put(kind, x, self.brackets.pop())
        else:
            self._put(kind, x)
        return m.end()

    def _template(self, at: int) -> int:
        """Past characters of a template, up to its end or into a substitution."""
        end = _TEMPLATE.match(self.text, at).end()
        if self.text.startswith("${", end):
            return end + 2
        if end >= len(self.text):
            raise _Unreadable
        start, n, _, self.line = self.templates.pop()
        if not self.inside:
            del self.out[n:]
        self._put("template", self.text[start : end + 1])
        return end + 1


def _tokens(text: str, inside: bool = False) -> list[tuple[str, str, bool]]:
    """(kind, text, whether a line ended before it)."""
    return _Lexer(text, inside).tokens()


_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
_PLAIN = {"n": "\n", "t": "\t", "b": "\b", "v": "\v", "f": "\f", "r": "\r", "0": "\0", "\n": "", "\r": "", "\r\n": "", "\u2028": "", "\u2029": ""}


def decoded(quoted: str) -> str:
    """The value of a string literal without its quotes."""
    if "\\" not in quoted:
        return quoted

    def one(m: re.Match) -> str:
        if m[4] is None:
            code = int(m[1] or m[2] or m[3], 16)
            if code > 0x10FFFF:
                raise _Unreadable
            return chr(code)
        if m[4] in "ux":
            raise _Unreadable
        return _PLAIN.get(m[4], m[4])

    # Pairs of surrogates are one character.
    return _ESCAPE.sub(one, quoted).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


class _Walk:
    """Statements of a script, descending only where strict mode looks."""

    def __init__(self, text: str):
        self.t, self.out = _tokens(text), []
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        stack: list[int] = []
        for i, (kind, x, _) in enumerate(self.t):
            if kind == "mark" and x in _PAIR:
                stack.append(i)
            elif kind == "mark" and x in ")]}":
                if not stack or _PAIR[self.t[stack[-1]][1]] != x:
                    raise _Unreadable
                self.close[stack[-1]] = i
                self.open[i] = stack.pop()
        if stack:
            raise _Unreadable

    def at(self, i: int, end: int) -> str:
        return self.t[i][1] if i < end and self.t[i][0] in ("mark", "name") else ""

    def statements(self, i: int, end: int) -> Step:
        while i < end:
            i = yield self.statement(i, end)

    def over(self, i: int, end: int) -> int:
        """The end of the expression that begins at i: a semicolon, or a line that cannot go on."""
        start = i
        while i < end and self.at(i, end) != ";":
            kind, x, line = self.t[i]
            if line and i > start and self.t[i - 1][0] != "mark" or line and i > start and self.t[i - 1][1] in (")", "]", "}"):
                if kind != "mark" or x in ("{", "++", "--"):
                    break
            i = self.close.get(i, i) + 1
        return i

    def statement(self, i: int, end: int) -> Step:
        x = self.at(i, end)
        if x == ";":
            return i + 1
        if x == "{":
            yield self.statements(i + 1, self.close[i])
            return self.close[i] + 1
        if x in ("import", "export") and self.at(i + 1, end) not in ("(", "."):
            raise _Unreadable
        if x == "async" and self.at(i + 1, end) == "function":
            i, x = i + 1, "function"
        if x == "function":
            return (yield self.function(i, end))
        if x in ("var", "let", "const"):
            return (yield self.declaration(i, end, x != "var"))
        if x == "if":
            j = self.paren(i + 1, end)
            yield self.expression(i + 2, j)
            j = yield self.statement(j + 1, end)
            if self.at(j, end) == ";" and self.at(j + 1, end) == "else":
                j += 1
            return (yield self.statement(j + 1, end)) if self.at(j, end) == "else" else j
        if x == "for":
            return (yield self.loop(i, end))
        if x == "return":
            if i + 1 >= end or self.t[i + 1][2] or self.at(i + 1, end) == ";":
                return i + 1
            j = self.over(i + 1, end)
            yield self.expression(i + 1, j)
            return j
        if x in ("while", "switch", "with"):
            j = self.paren(i + 1, end) + 1
            return self.close[j] + 1 if self.at(j, end) == "{" else self.over(j, end)
        if x in ("try", "do", "finally"):
            j = self.close[i + 1] + 1 if self.at(i + 1, end) == "{" else self.over(i + 1, end)
            if self.at(j, end) == "catch":
                j = self.paren(j + 1, end) + 1 if self.at(j + 1, end) == "(" else j + 1
                j = self.close[j] + 1
            if self.at(j, end) == "while" and x == "do":
                j = self.paren(j + 1, end) + 1
            return j
        if x == "class":
            while self.at(i, end) != "{":
                if i >= end:
                    raise _Unreadable
                i += 1
            return self.close[i] + 1
        j = self.over(i, end)
        yield self.expression(i, j)
        return max(j, i + 1)

    def paren(self, i: int, end: int) -> int:
        if self.at(i, end) != "(":
            raise _Unreadable
        return self.close[i]

    def function(self, i: int, end: int) -> Step:
        while self.at(i, end) != "(":
            if i >= end:
                raise _Unreadable
            i += 1
        j = self.close[i] + 1
        if self.at(j, end) != "{":
            raise _Unreadable
        yield self.statements(j + 1, self.close[j])
        return self.close[j] + 1

    def declaration(self, i: int, end: int, visit: bool) -> Step:
        j = self.over(i + 1, end)
        if visit:
            for a, b in self.split(i + 1, j, ","):
                parts = self.split(a, b, "=")
                if len(parts) > 1:
                    yield self.expression(parts[1][0], b)
        return j

    def loop(self, i: int, end: int) -> Step:
        i = i + 1 if self.at(i + 1, end) == "await" else i
        j = self.paren(i + 1, end)
        parts = self.split(i + 2, j, ";")
        if len(parts) == 3:
            a, b = parts[0]
            # Only the initialiser of let and const, as among statements.
            if self.at(a, b) in ("var", "let", "const"):
                yield self.declaration(a, b, self.at(a, b) != "var")
            else:
                yield self.expression(a, b)
            for a, b in parts[1:]:
                yield self.expression(a, b)
            return (yield self.statement(j + 1, end))
        kept = len(self.out)
        k = yield self.statement(j + 1, end)
        del self.out[kept:]
        return k

    def split(self, i: int, end: int, by: str) -> list[tuple[int, int]]:
        out, start = [], i
        while i < end:
            if self.t[i][0] == "mark" and self.t[i][1] == by:
                out.append((start, i))
                start = i + 1
            i = self.close.get(i, i) + 1
        return [*out, (start, end)]

    def expression(self, i: int, end: int) -> Step:
        """A call, a function, an assignment or a bracketed one of these; nothing else is looked into."""
        if i >= end:
            return
        if self.t[i][1] == "(" and self.close.get(i) == end - 1:
            if len(self.split(i + 1, end - 1, ",")) == 1:
                yield self.expression(i + 1, end - 1)
            return
        k = i
        while k < end:
            if self.t[k][0] == "mark" and self.t[k][1] in _ASSIGN:
                yield self.expression(i, k)
                yield self.expression(k + 1, end)
                return
            if self.t[k][1] == "=>":
                return
            k = self.close.get(k, k) + 1
        if self.at(i, end) in ("function", "async"):
            k = i
            while k < end and self.at(k, end) != "(":
                k += 1
            if k < end and self.at(self.close[k] + 1, end) == "{" and self.close[self.close[k] + 1] == end - 1:
                yield self.statements(self.close[k] + 2, end - 1)
                return
        last = self.open.get(end - 1)
        if last is not None and last > i and self.t[last][1] == "(" and self.plain(i, last):
            args = [x for x in self.split(last + 1, end - 1, ",") if x[0] < x[1]]
            callee, own = self.bare(i, last), self.bare(*args[0]) if args else range(0)
            if len(callee) == len(own) == 1 and self.t[callee[0]][:2] == ("name", "require") and self.t[own[0]][0] == "text":
                self.out.append(decoded(self.t[own[0]][1][1:-1]))
            yield self.expression(i, last)
            for a, b in args:
                yield self.expression(a, b)

    def bare(self, i: int, end: int) -> range:
        """The tokens without the brackets that enclose all of them."""
        while i < end and self.t[i][1] == "(" and self.close.get(i) == end - 1:
            i, end = i + 1, end - 1
        return range(i, end)

    def plain(self, i: int, end: int) -> bool:
        """Whether the tokens are one operand: names, literals, member access, calls and brackets side by side."""
        operand = False
        if self.at(i, end) in ("new", "typeof", "void", "delete", "await", "yield"):
            return False
        while i < end:
            kind, x, _ = self.t[i]
            if kind == "mark" and x in (".", "?."):
                operand = False
            elif kind == "mark" and x not in _PAIR:
                return False
            elif operand and kind != "mark" and kind != "template":
                if not (self.at(i - 1, end) in ("function", "async")):
                    return False
            else:
                operand = True
            i = self.close.get(i, i) + 1
        return True


def strict_references(text: str | None) -> list[str] | None:
    """Specifiers in the order of the walk; null if the text is no plain script."""
    try:
        walk = _Walk(text or "")
        _finished(walk.statements(0, len(walk.t)))
        return walk.out
    except (_Unreadable, KeyError, IndexError):
        return None


def strict_or_null(body: Column) -> Column:
    """Specifiers of the strict walk, a batch at a time; null where the text is no plain script."""

    @F.pandas_udf(ArrayType(StringType()))
    def walked(bodies: pd.Series) -> pd.Series:
        return bodies.map(strict_references)

    return walked(body)


def lexed_references(text: str | None) -> list[str] | None:
    """As full_references by tokens, templates' substitutions too, with literals' values; null for what cannot be read."""
    if text is None:
        return None
    try:
        t = _tokens(text, inside=True)
        out = []
        for i, (kind, x, _) in enumerate(t):
            if kind != "name" or x not in ("require", "import", "from") or i and t[i - 1][1] in (".", "?."):
                continue
            k, opened = i + 1, 0
            left = i - 1
            # Brackets around the callee.
            while x == "require" and k < len(t) and left >= 0 and t[k][1] == ")" and t[left][1] == "(" and (left == 0 or t[left - 1][0] == "mark" and t[left - 1][1] not in (")", "]")):
                k, left = k + 1, left - 1
            while k < len(t) and t[k][:2] == ("mark", "("):
                k, opened = k + 1, opened + 1
            if k < len(t) and t[k][0] == "text" and (opened > 0 if x == "require" else opened == 0 or x == "import"):
                out.append(decoded(t[k][1][1:-1]))
        return out
    except (_Unreadable, IndexError):
        return None


#: Bodies that one pattern cannot scan: substitutions, a slash after a bracket, brackets around a callee or argument, escapes in a specifier.
_INTRICATE = r"\$\{|\)\s*+/(?![/*])|\(\s*+require\s*+\)|require\s*+\(\s*+\(|(?:require|import|from)[\s(]*+['\"][^'\"\n]*\\"


def all_references(body: Column) -> Column:
    """full_references with the values of literals; bodies that one pattern cannot scan go through the lexer."""

    @F.pandas_udf(ArrayType(StringType()))
    def lexed(bodies: pd.Series) -> pd.Series:
        return bodies.map(lexed_references)

    return F.coalesce(lexed(F.when(body.rlike(_INTRICATE), body)), full_references(body))


def deep_references(body: Column, strict: bool = False) -> Column:
    return F.coalesce(strict_or_null(body), regex_references(body)) if strict else all_references(body)
