"""TypeScript and JavaScript sources, by a scanner of our own: functions, calls and imports.

There is no compiler to ask, so this is best effort.  Comments, strings, templates and regular expressions are recognised; names are
resolved through imports, the same file and `this`, not through types.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<template>`)"""
    r"""|(?P<number>\d[\w.]*)|(?P<name>\#?[A-Za-z_$][\w$]*)|(?P<mark>=>|\.\.\.|\?\.|\?\?|&&|\|\||[-+*/%=<>!&|^]=+|\+\+|--|.)""",
    re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: After these a slash starts a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void instanceof new do else throw await yield".split())
_MODIFIERS = frozenset("public private protected static readonly abstract override async declare export default accessor".split())
_NO_CALLS = frozenset("if for while switch catch function return typeof await super with import delete void in of instanceof do else case throw yield".split())
#: Names of types that have no methods of a project.
_NO_TYPES = frozenset("string number boolean any unknown never void object symbol bigint null undefined this typeof keyof readonly new infer unique".split())


@dataclass
class Function:
    name: str
    line: int
    character: int
    end_line: int
    class_name: str | None
    #: Only declarations, methods, accessors and variables are ends of call edges; class properties are not.
    linked: bool = True
    start: int = 0
    end: int = 0


@dataclass
class Script:
    functions: list[Function] = field(default_factory=list)
    #: (token number, receiver, name)
    calls: list[tuple[int, str | None, str]] = field(default_factory=list)
    #: local name -> (module, exported name)
    imports: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: (exported name, local name, module or None); * for all names of a module
    exports: list[tuple[str, str, str | None]] = field(default_factory=list)
    #: (name, name behind extends, first and last token of the body)
    classes: list[tuple[str, str | None, int, int]] = field(default_factory=list)
    #: (variable, parameter or this.field, name of its type, first and last token of its scope)
    bindings: list[tuple[str, str, int, int]] = field(default_factory=list)


def tokens(source: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) without spaces and comments; a template is one string, of which the holes are not looked into."""
    out, i = [], 0
    while i < len(source):
        if source[i] == "/" and not source.startswith(("//", "/*"), i):
            last = out[-1] if out else ("mark", "", 0, 0)
            starts = last[0] == "mark" and last[1] not in (")", "]", "}") or last[0] == "name" and last[1] in _BEFORE_REGEX
            m = _REGEX.match(source, i) if starts else None
            if m:
                out.append(("string", m[0], i, m.end()))
                i = m.end()
                continue
        m = _TOKEN.match(source, i)
        kind, end = m.lastgroup, m.end()
        if kind == "template":
            end = _template_end(source, i)
            kind = "string"
        if kind not in ("space", "comment"):
            out.append((kind, source[i:end], i, end))
        i = end
    return out


def _template_end(source: str, i: int) -> int:
    i += 1
    while i < len(source) and source[i] != "`":
        if source[i] == "\\":
            i += 2
        elif source.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(source) and depth:
                if source[i] == "`":
                    i = _template_end(source, i)
                    continue
                depth += (source[i] == "{") - (source[i] == "}")
                i += 1
        else:
            i += 1
    return min(i + 1, len(source))


class _Scanner:
    def __init__(self, source: str):
        self.source, self.t = source, tokens(source)
        self.text = [x[1] for x in self.t]
        self.pair = self._pairs()
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.out = Script()

    def _pairs(self) -> dict[int, int]:
        closing, open_, out = {")": "(", "]": "[", "}": "{"}, [], {}
        for i, (kind, text, *_) in enumerate(self.t):
            if kind == "mark" and text in "([{":
                open_.append(i)
            elif kind == "mark" and text in closing:
                while open_ and self.text[open_[-1]] != closing[text]:
                    open_.pop()
                if open_:
                    out[open_.pop()] = i
        return out

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def place(self, offset: int) -> tuple[int, int]:
        import bisect

        line = bisect.bisect_right(self.lines, offset) - 1
        return line, offset - self.lines[line]

    def add(self, name: str, start: int, end: int, class_name: str | None, linked: bool = True) -> None:
        line, character = self.place(self.t[start][2])
        last = min(end, len(self.t) - 1)
        self.out.functions.append(Function(name, line, character, self.place(max(self.t[last][3] - 1, 0))[0], class_name, linked, start, last))

    def body_after(self, i: int) -> int | None:
        """The opening brace of a body whose parameter list opens at i, past a return type; None for a signature."""
        i = self.pair.get(i, len(self.t)) + 1
        if self.at(i) == ":":
            i += 1
            while i < len(self.t) and self.at(i) not in (";", "=>"):
                if self.at(i) == "{":
                    close = self.pair.get(i, len(self.t))
                    if self.at(close + 1) not in ("{", "|", "&", "[", "=>"):
                        # an object type ends the signature unless the type needs it: a body follows a complete type
                        if self.at(i - 1) in (":", "|", "&", "<", ","):
                            i = close + 1
                            continue
                        return i
                    if self.at(i - 1) not in (":", "|", "&", "<", ","):
                        return i
                    i = close + 1
                    continue
                i = self.pair.get(i, i) + 1
            return None
        return i if self.at(i) == "{" else None

    def angle(self, i: int) -> int:
        """Past type parameters that open at i."""
        if self.at(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            depth += (self.at(i) == "<") - (self.at(i) == ">")
            i += 1
            if not depth:
                break
        return i

    def arrow_or_function(self, i: int) -> int | None:
        """The last token of an arrow function or function expression that starts at i."""
        j = i + (self.at(i) == "async")
        if self.at(j) == "function":
            j += 1
            j += self.at(j) == "*"
            j += self.t[j][0] == "name" if j < len(self.t) else 0
            body = self.body_after(self.angle(j))
            return self.pair.get(body) if body is not None else None
        j = self.angle(j)
        if self.at(j) == "(":
            j = self.pair.get(j, len(self.t)) + 1
            if self.at(j) == ":":
                while j < len(self.t) and self.at(j) not in ("=>", ";"):
                    j = self.pair.get(j, j) + 1
        elif j < len(self.t) and self.t[j][0] == "name":
            j += 1
        if self.at(j) != "=>":
            return None
        j += 1
        if self.at(j) == "{":
            return self.pair.get(j, len(self.t) - 1)
        end = j
        while end < len(self.t) and self.at(end) not in (",", ";", ")", "]", "}"):
            if end > j and self.place(self.t[end][2])[0] > self.place(self.t[end - 1][3] - 1)[0] and self.t[end][0] == "name" and self.t[end - 1][1] not in ("=>", "(", "&&", "||", "+", "?", ":", ".", "="):
                break
            end = self.pair.get(end, end) + 1
        return end - 1

    def value_after_name(self, i: int) -> int | None:
        """The start of the initializer of a variable or property whose name is at i."""
        j = i + 1
        j += self.at(j) in ("?", "!")
        if self.at(j) == ":":
            j += 1
            while j < len(self.t) and self.at(j) not in ("=", ";", ",", ")"):
                j = self.pair.get(j, self.angle(j) - 1 if self.at(j) == "<" else j) + 1
        return j + 1 if self.at(j) == "=" else None

    def members(self, open_: int, class_name: str | None, is_class: bool) -> None:
        """Methods, accessors and, in classes, properties between the braces that open at open_."""
        close, i = self.pair.get(open_, len(self.t)), open_ + 1
        while i < close:
            start = i
            while self.at(i) == "@" and i + 1 < close:
                i += 2
                i = self.pair.get(i, i - 1) + 1 if self.at(i) == "(" else i
            accessor = False
            while (self.at(i) in _MODIFIERS or self.at(i) in ("get", "set")) and self.at(i + 1) not in ("(", "=", ":", ";", "?", "!", ",", "}", "<"):
                accessor = accessor or self.at(i) in ("get", "set")
                i += 1
            i += self.at(i) == "*"
            if i >= close:
                break
            name, after = self.at(i), self.angle(i + 1)
            if self.at(i) == "[":
                after = self.pair.get(i, i) + 1
                name = "".join(self.text[i:after])
            after += self.at(after) == "?"
            after = self.angle(after)
            if self.at(after) == "(" and (self.t[i][0] in ("name", "string", "number") or self.at(i) == "["):
                body = self.body_after(after)
                if body is not None:
                    end = self.pair.get(body, close)
                    if name != "constructor" or not is_class:
                        self.add(name, start, end, class_name)
                    i = end + 1
                    continue
            elif is_class and self.t[i][0] in ("name", "string") and (v := self.value_after_name(i)) is not None:
                end = self.arrow_or_function(v)
                if end is not None:
                    self.add(name, v, end, class_name, linked=False)
                    i = end + 1
                    continue
            while i < close and self.at(i) not in (";", ",") and not (i > start and is_class and self.at(i - 1) == "}"):
                i = self.pair.get(i, i) + 1
            i += self.at(i) in (";", ",")

    def scan(self) -> Script:
        t, n = self.t, len(self.t)
        for i, (kind, text, *_) in enumerate(t):
            before = self.at(i - 1)
            if kind == "name" and text == "class" and before != ".":
                j = i + 1
                name = self.at(j) if j < n and t[j][0] == "name" and self.at(j) not in ("extends", "implements") else None
                base = None
                while j < n and self.at(j) != "{":
                    if self.at(j) == "extends" and j + 1 < n and t[j + 1][0] == "name" and self.at(j + 2) != ".":
                        base = self.at(j + 1)
                    j = self.pair.get(j, self.angle(j) - 1 if self.at(j) == "<" else j) + 1
                if j < n:
                    self.members(j, name, True)
                    if name:
                        self.out.classes.append((name, base, j, self.pair.get(j, n - 1)))
            elif kind == "name" and text == "function" and before not in (".", "=", "(", ",", ":", "=>", "return", "?", "||", "&&", "??", "[", "new", "!", "async=") and not (before == "async" and self.at(i - 2) in ("=", "(", ",", ":", "=>", "return", "?")):
                j = i + 1
                j += self.at(j) == "*"
                body = self.body_after(self.angle(j + 1)) if j < n and t[j][0] == "name" else None
                if body is not None:
                    start = i
                    while self.at(start - 1) in ("async", "export", "default", "declare"):
                        start -= 1
                    self.add(self.at(j), start, self.pair.get(body, n - 1), None)
            elif kind == "name" and before in ("const", "let", "var", ",") and text not in ("function", "class") and (v := self.value_after_name(i)) is not None:
                if before == "," and not self._declares(i):
                    continue
                end = self.arrow_or_function(v)
                if end is not None:
                    self.add(text, v, end, None)
            elif kind == "mark" and text == "{" and before in ("=", "(", ",", ":", "return", "=>", "[", "?", "||", "&&", "??") and not (before == ":" and self._type_at(i)):
                self.members(i, "", False)
            elif kind == "mark" and text == "(" and i and t[i - 1][0] == "name" and before not in _NO_CALLS:
                receiver = self.at(i - 3) if self.at(i - 2) in (".", "?.") else None
                if self.at(i - 2) in (".", "?.") and (i < 3 or t[i - 3][0] != "name"):
                    receiver = ""
                elif receiver and self.at(i - 4) in (".", "?."):  # a field; of what else than this, is not known
                    receiver = f"this.{receiver}" if self.at(i - 5) == "this" else ""
                self.out.calls.append((i, receiver, before))
            elif kind == "name" and text == "import":
                self._import(i)
            elif kind == "name" and text == "export" and before != ".":
                self._export(i)
        self._bindings()
        self.out.functions.sort(key=lambda f: (f.start, -f.end))
        return self.out

    def _export(self, i: int) -> None:
        """Names that an export statement passes on; declarations are exported under their own names anyway."""
        j = i + 1 + (self.at(i + 1) == "type")
        if self.at(j) == "default":
            k = j + 1 + (self.at(j + 1) == "async")
            k += self.at(k) in ("function", "class", "abstract")
            k += self.at(k) in ("*", "class")
            if k < len(self.t) and self.t[k][0] == "name" and self.at(k) != "new":
                self.out.exports.append(("default", self.at(k), None))
            return
        if self.at(j) == "*":
            named = self.at(j + 2) if self.at(j + 1) == "as" else "*"
            k = j + 1 + 2 * (named != "*")
            if self.at(k) == "from" and k + 1 < len(self.t) and self.t[k + 1][0] == "string":
                self.out.exports.append((named, "*", self.at(k + 1)[1:-1]))
        elif self.at(j) == "{":
            close = self.pair.get(j, len(self.t))
            module = self.at(close + 2)[1:-1] if self.at(close + 1) == "from" else None
            k = j + 1
            while k < close:
                k += self.at(k) == "type" and self.at(k + 1) not in ("as", ",", "}")
                self.out.exports.append((self.at(k + 2) if self.at(k + 1) == "as" else self.at(k), self.at(k), module))
                while k < close and self.at(k) != ",":
                    k += 1
                k += 1

    def _type(self, i: int) -> tuple[str | None, int]:
        """The plain name of a type that begins at i, null and undefined beside it left out, and where it ends."""
        if i >= len(self.t) or self.t[i][0] != "name" or self.at(i) in _NO_TYPES:
            return None, i
        name, end = self.at(i), self.angle(i + 1)
        while self.at(end) == "|" and self.at(end + 1) in ("null", "undefined"):
            end += 2
        return (name, end) if self.at(end) in (",", ")", "=", ";", "}") or end >= len(self.t) or self.t[end][0] == "name" else (None, end)

    def _bindings(self) -> None:
        """Variables, parameters and fields with a named type or made by new."""
        bodies = {open_: close for _, _, open_, close in self.out.classes}
        open_: list[int] = []
        for i, (kind, text, *_) in enumerate(self.t):
            if kind == "mark" and i in self.pair:
                open_.append(i)
            while open_ and self.pair[open_[-1]] <= i:
                open_.pop()
            if kind != "name" or not open_ and self.at(i - 1) not in ("const", "let", "var"):
                continue
            j = i + 1 + (self.at(i + 1) in ("?", "!"))
            type_, end = self._type(j + 1) if self.at(j) == ":" else (None, j)
            if type_ is None and self.at(j) == "=" and self.at(j + 1) == "new" and j + 2 < len(self.t) and self.t[j + 2][0] == "name":
                type_ = self.at(j + 2)
            if type_ is None or self.at(i - 1) in (".", "?."):
                continue
            around = open_[-1] if open_ else None
            if self.at(i - 1) in ("const", "let", "var"):
                blocks = [x for x in open_ if self.at(x) == "{"]
                scope = (blocks[-1], self.pair[blocks[-1]]) if blocks else (0, len(self.t))
                self.out.bindings.append((text, type_, *scope))
            elif around is not None and self.at(around) == "(" and self.at(j) == ":":
                body = self.body_after(around)
                last = self.pair.get(body) if body is not None else self.arrow_or_function(around)
                if last is not None:
                    self.out.bindings.append((text, type_, around, last))
                    owner = [x for x in open_ if x in bodies]
                    if self.at(i - 1) in _MODIFIERS and self.at(around - 1) == "constructor" and owner:
                        self.out.bindings.append((f"this.{text}", type_, owner[-1], bodies[owner[-1]]))
            elif around in bodies:
                self.out.bindings.append((f"this.{text}", type_, around, bodies[around]))

    def _declares(self, i: int) -> bool:
        """Whether the comma before i separates declarations."""
        depth_from = i - 1
        reverse = {v: k for k, v in self.pair.items()}
        while depth_from >= 0 and self.at(depth_from) not in (";", "{", "(", "["):
            if self.at(depth_from) in ("const", "let", "var"):
                return True
            depth_from = reverse.get(depth_from, depth_from) - 1
        return False

    def _type_at(self, i: int) -> bool:
        """Whether braces after a colon look like a type: members separated by semicolons or without values."""
        close = self.pair.get(i, len(self.t))
        return ";" in self.text[i:close] and not any(self.at(j) == "(" and self.at(self.pair.get(j, j) + 1) == "{" for j in range(i, close))

    def _import(self, i: int) -> None:
        end = i
        while end < len(self.t) and end < i + 200 and self.t[end][0] != "string":
            end += 1
        if end >= len(self.t) or self.at(end - 1) != "from":
            return
        module = self.at(end)[1:-1]
        j = i + 1 + (self.at(i + 1) == "type" and self.at(i + 2) != "from")
        if self.t[j][0] == "name":
            self.out.imports[self.at(j)] = (module, "default")
        while j < end:
            if self.at(j) == "*" and self.at(j + 1) == "as":
                self.out.imports[self.at(j + 2)] = (module, "*")
            if self.at(j) == "{":
                k, close = j + 1, self.pair.get(j, end)
                while k < close:
                    if self.t[k][0] == "name":
                        k += self.at(k) == "type" and self.t[k + 1][0] == "name" and self.at(k + 1) != "as"
                        local = self.at(k + 2) if self.at(k + 1) == "as" else self.at(k)
                        self.out.imports[local] = (module, self.at(k))
                    while k < close and self.at(k) != ",":
                        k += 1
                    k += 1
            j += 1


def parse(source: str) -> Script:
    return _Scanner(source).scan()


def functions(source: str) -> list[tuple[str, int, int, int, int]]:
    return [(f.name, f.line, f.character, f.line, f.end_line) for f in parse(source).functions]


def placed_calls(script: Script) -> list[tuple[int, Function, str | None, str | None, str, int]]:
    """(number, innermost linked function around, nearest class, receiver, name, token) of the calls inside functions."""
    out, linked, around, next_ = [], [f for f in script.functions if f.linked], [], 0
    for k, (place, receiver, name) in enumerate(sorted(script.calls, key=lambda c: c[0])):
        while next_ < len(linked) and linked[next_].start <= place:
            around.append(linked[next_])
            next_ += 1
        around = [f for f in around if f.end >= place]
        if around:
            out.append((k, around[-1], next((f.class_name for f in reversed(around) if f.class_name), None), receiver, name, place))
    return out
