"""Java sources, read line by line: classes, methods, fields and calls."""

from __future__ import annotations

import re
from dataclasses import dataclass

# What a line must look like, and words that can't be types or calls.
CLASS = re.compile(r"\bclass\s+(\w+)", re.A)
METHOD = re.compile(r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?(?:synchronized\s+)?(\w+)(?:<[^>]*>)?\s+(\w+)\s*\(", re.A)
FIELD = re.compile(r"^\s*(?:private|protected|public)?\s*(?:final\s+)?(\w+)\s+(\w+)\s*[;=]", re.A)
CALL = re.compile(r"\b(?:(\w+)\.)?(\w+)\s*\(", re.A)
NO_RETURN_TYPES = frozenset("class interface enum public private protected return throw assert else new".split())
NO_FIELD_TYPES = frozenset(
    "int long short byte float double boolean char void String class interface enum return if else for while do switch case break continue throw "
    "try catch finally new this super import package public private protected static final abstract".split()
)
NO_CALLS = frozenset("if else for while do switch catch return new throw class interface enum super assert synchronized instanceof try finally".split())
#: Quoted text, closed or not, and line comments.
_QUIET = re.compile(r""""(?:\\.|[^"\\])*(?:"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)|//.*$""")
_COMMENT = re.compile(r"//.*$")


@dataclass(frozen=True)
class Method:
    name: str
    line: int
    end_line: int
    calls: tuple[tuple[str | None, str], ...]


@dataclass(frozen=True)
class JavaSource:
    class_name: str
    methods: tuple[Method, ...]
    fields: tuple[tuple[str, str], ...]


def braces(line: str) -> list[int]:
    """+1 and -1 for the braces of a line outside quotes and comments."""
    return [1 if c == "{" else -1 for c in _QUIET.sub("", line) if c in "{}"]


def parse(source: str) -> JavaSource:
    """The first class that is named, all methods with the calls on the lines between their first and last, and the fields (name, type)."""
    lines = source.split("\n")
    named = (CLASS.search(_COMMENT.sub("", line)) for line in lines)
    class_name = next((m[1] for m in named if m), "")
    steps = [braces(line) for line in lines]
    methods = []
    for i, line in enumerate(lines):
        m = METHOD.match(line)
        if m and m[1] not in NO_RETURN_TYPES:
            end = _closing(steps, i)
            body = "\n".join(lines[i + 1 : end])
            calls = tuple((c[1], c[2]) for c in CALL.finditer(body) if c[2] not in NO_CALLS)
            methods.append(Method(m[2], i, end, calls))
    fields: dict[str, str] = {}
    for line in lines:
        m = FIELD.match(line)
        if m and m[1] not in NO_FIELD_TYPES:
            fields.setdefault(m[2], m[1])
    return JavaSource(class_name, tuple(methods), tuple(fields.items()))


def _closing(steps: list[list[int]], first: int) -> int:
    """The line on which the braces opened from line first on are closed again; the last line if they aren't."""
    depth = 0
    for i in range(first, len(steps)):
        for s in steps[i]:
            depth += s
            if s < 0 and depth == 0:
                return i
    return len(steps) - 1


def functions(source: str) -> list[tuple[str, int, int, int, int]]:
    return [(m.name, m.line, 0, m.line, m.end_line) for m in parse(source).methods]
