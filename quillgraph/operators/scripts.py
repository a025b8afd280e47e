"""Symbols of JavaScript and TypeScript texts, read token by token.

A text becomes a list of tokens without comments and blanks; strings, templates and regular expressions are one token each,
so nothing inside them counts.  Brackets are paired once.  Then one walk over the tokens keeps the stack of open braces,
some of which carry the name of the function, class or method they are the body of, and asks a table what each word means.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

Found = tuple[str, str, str, int, str | None]

_PIECES = re.compile(
    r"(?P<none>[ \t\r\f\v\u00a0\ufeff]+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<line>\n)|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)"
    r"|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>\.\.\.|=>|[=!]==?|.)",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
# Words that stand before a bracket without being called.
NOT_CALLED = set("if else for while switch catch return throw new delete typeof import export default case break continue try finally do with function class extends implements interface enum const let var".split())
# Words of an import clause that name nothing.
_CLAUSE = {"import", "as", "default", "type", "from"}
# Functions whose only argument selects by style, and how it is read.
_SELECT = {"querySelector": "selector", "querySelectorAll": "selector", "getElementById": "id", "getElementsByClassName": "classes"}
_CLASS_LIST = {"add", "remove", "toggle", "contains"}
_PAIRS = {")": "(", "]": "[", "}": "{"}


class _Text:
    """The tokens of a text: kinds, texts, lines, whether each is the first on its line, and the partner of each bracket."""

    def __init__(self, text: str) -> None:
        self.kind: list[str] = []
        self.text: list[str] = []
        self.line: list[int] = []
        self.first: list[bool] = []
        self.partner: dict[int, int] = {}
        line, fresh, at, waiting = 1, True, 0, []
        while at < len(text):
            m = _REGEX.match(text, at) if text[at] == "/" and self._value_may_begin() else None
            kind = "string" if m else None
            m = m or _PIECES.match(text, at)
            kind, value, at = kind or m.lastgroup, m.group(), m.end()
            if kind == "line":
                line, fresh = line + 1, True
            elif kind == "none":
                line += value.count("\n")
            else:
                here = len(self.kind)
                if kind == "sign" and value in "([{":
                    waiting.append(here)
                elif kind == "sign" and value in _PAIRS and waiting and self.text[waiting[-1]] == _PAIRS[value]:
                    self.partner[waiting.pop()] = here
                self.kind.append(kind)
                self.text.append(value)
                self.line.append(line)
                self.first.append(fresh)
                line, fresh = line + value.count("\n"), False

    def _value_may_begin(self) -> bool:
        return not self.kind or (self.kind[-1] == "sign" and self.text[-1] not in ")]}") or self.text[-1] in ("return", "typeof", "case")

    def at(self, i: int, *wanted: str) -> bool:
        """Whether the tokens from ``i`` on are the wanted ones; "word" and "string" stand for any of the kind."""
        if i < 0 or i + len(wanted) > len(self.kind):
            return False
        return all((self.kind[i + q] == w) if w in ("word", "string") else (self.text[i + q] == w and self.kind[i + q] != "string") for q, w in enumerate(wanted))

    def quoted(self, i: int) -> str:
        return self.text[i][1:-1] if len(self.text[i]) > 1 else ""


class _Reader:
    def __init__(self, text: str) -> None:
        self.t = _Text(text)
        self.out: list[Found] = []
        self.braces: list[str | None] = []  # the open braces and the names of those that are bodies
        self.body: dict[int, str] = {}  # brace -> the name it is the body of
        self.declared: set[int] = set()  # names that are declared where they stand, so not called

    def add(self, name: str, kind: str, role: str, i: int, scoped: bool = True) -> None:
        inside = ".".join(b for b in self.braces if b) if scoped else ""
        self.out.append((name, kind, role, self.t.line[i], inside or None))

    def read(self) -> list[Found]:
        t = self.t
        for i, (kind, text) in enumerate(zip(t.kind, t.text, strict=True)):
            if kind == "word":
                rule = RULES.get(text)
                if rule is not None and not t.at(i - 1, "."):
                    rule(self, i)
                self._used(i)
            elif kind == "sign" and text == "{":
                self.braces.append(self.body.get(i))
            elif kind == "sign" and text == "}" and self.braces:
                self.braces.pop()
        return self.out

    def _defined(self, i: int, kind: str, after: int) -> None:
        """The name at ``i``, whose body is the first brace from ``after`` on, unless the statement ends before."""
        t = self.t
        self.add(t.text[i], kind, "definition", i)
        self.declared.add(i)
        for j in range(after, min(after + 64, len(t.kind))):
            if t.at(j, "{"):
                self.body[j] = t.text[i]
                return
            if t.at(j, ";"):
                return

    def _used(self, i: int) -> None:
        """A word before a bracket: a method if a body follows the brackets, else a call; and what style it selects."""
        t, name = self.t, self.t.text[i]
        if not t.at(i + 1, "(") or i in self.declared or (name in NOT_CALLED and not t.at(i - 1, ".")):
            return
        end = t.partner.get(i + 1)
        if end is not None and t.at(end + 1, "{") and self.braces and not t.at(i - 1, ".") and not t.at(i - 1, "new"):
            self._defined(i, "function", end + 1)
            return
        if name not in NOT_CALLED:
            self.add(name, "function", "reference", i)
        if t.at(i + 2, "string", ")"):
            way = _SELECT.get(name) or ("classes" if name in _CLASS_LIST and t.at(i - 2, "classList", ".") else None)
            for sign, x in _selected(t.quoted(i + 2), way):
                self.add(sign + x, "css_class" if sign == "." else "css_id", "reference", i, scoped=False)

    def function(self, i: int) -> None:
        i += 2 if self.t.at(i + 1, "*") else 1
        if self.t.at(i, "word", "("):
            self._defined(i, "function", self.t.partner.get(i + 1, i + 1) + 1)

    def klass(self, i: int) -> None:
        if self.t.at(i + 1, "word") and self.t.text[i + 1] not in ("extends", "implements"):
            self._defined(i + 1, "class", i + 2)

    def shape(self, i: int) -> None:
        """An interface or a type, at the beginning of a statement."""
        if (self.t.first[i] or self.t.at(i - 1, "export")) and self.t.at(i + 1, "word"):
            self.add(self.t.text[i + 1], "class", "definition", i)

    def variable(self, i: int) -> None:
        t = self.t
        if t.at(i + 1, "{"):  # parts of a module
            end = t.partner.get(i + 1, i + 1)
            if t.at(end + 1, "=", "require", "(", "string", ")"):
                for j in self._words(i + 2, end):
                    if t.text[j] != "as":
                        self.add(t.text[j], "import", "reference", j)
            return
        if not t.at(i + 1, "word", "="):
            return
        name, value = t.text[i + 1], i + 3
        if t.at(value, "require", "(", "string", ")"):
            if t.quoted(value + 2)[:1] in (".", "/"):
                self.add(name, "import", "reference", i)
            return
        self.add(name, "variable", "definition", i)
        alone = value + 1 >= len(t.kind) or t.first[value + 1] or t.at(value + 1, ";")
        if t.at(value, "word") and alone and t.text[value] != name:
            self.add(t.text[value], "variable", "reference", i)

    def imported(self, i: int) -> None:
        t = self.t
        for j in range(i + 1, len(t.kind)):
            if t.at(j, "from", "string"):
                self.add(t.quoted(j + 1), "module", "reference", i)
                for w in self._words(i + 1, j):
                    if t.text[w] not in _CLAUSE:
                        self.add(t.text[w], "import", "reference", w)
                return
            if t.kind[j] == "string" or t.text[j] in (";", "(", "import"):
                return

    def required(self, i: int) -> None:
        if self.t.at(i + 1, "(", "string", ")"):
            self.add(self.t.quoted(i + 2), "module", "reference", i)

    def created(self, i: int) -> None:
        if self.t.at(i + 1, "word") and self.t.text[i + 1] not in NOT_CALLED:
            self.add(self.t.text[i + 1], "class", "reference", i)

    def exports(self, i: int) -> None:
        t = self.t
        if not t.at(i, "module", ".", "exports", "="):
            return
        at = i + 4
        if t.at(at, "{"):
            for s, e in self._entries(at + 1, t.partner.get(at, at + 1)):
                if t.at(s, "word", ":", "word"):
                    self.add(t.text[s], "variable", "definition", i, scoped=False)
                    self.add(t.text[s + 2], "variable", "reference", i, scoped=False)
                elif e - s == 1 and t.kind[s] == "word":
                    self.add(t.text[s], "variable", "reference", i, scoped=False)
            return
        at += t.at(at, "new")
        if t.at(at, "word"):
            self.add(t.text[at], "class", "definition", i, scoped=False)

    def _words(self, start: int, end: int) -> Iterator[int]:
        return (j for j in range(start, end) if self.t.kind[j] == "word")

    def _entries(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        """The parts between commas, brackets in them passed over."""
        at = j = start
        while j < end:
            if self.t.at(j, ","):
                yield at, j
                at = j + 1
            j = self.t.partner.get(j, j) + 1
        if at < end:
            yield at, end


#: What a word means that does not stand behind a point.
RULES: dict[str, Callable[[_Reader, int], None]] = {
    "function": _Reader.function, "class": _Reader.klass, "interface": _Reader.shape, "type": _Reader.shape,
    **dict.fromkeys(("const", "let", "var"), _Reader.variable),
    "import": _Reader.imported, "require": _Reader.required, "new": _Reader.created, "module": _Reader.exports,
}


def _selected(text: str, way: str | None) -> list[tuple[str, str]]:
    if way == "selector":
        return re.findall(r"([.#])([a-zA-Z_][\w-]*)", text)
    if way == "id":
        return [("#", text)]
    return [(".", x) for x in text.split()] if way else []


def script_symbols(text: str) -> list[Found]:
    """(name, kind, role, line, container) of one text, in the order of its tokens."""
    return _Reader(text).read()
