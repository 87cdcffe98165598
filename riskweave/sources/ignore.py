"""Ignore files: patterns compiled to regular expressions, the last match decides."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pattern(line: str) -> tuple[str, bool] | None:
    """The regular expression for paths that a line names, and whether it takes them back; None for blank lines and comments."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[back:]
    if line.startswith(("\\#", "\\!")):
        line = line[1:]
    folder = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = [], 0
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif line[i:] == "**" and i and line[i - 1] == "/":
            out.append(".+")
            i += 2
        elif line[i] == "*":
            while i < len(line) and line[i] == "*":
                i += 1
            out.append("[^/]*")
        elif line[i] == "?":
            out.append("[^/]")
            i += 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            inner = line[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]")
            i = end + 1
        else:
            if line[i] == "\\" and i + 1 < len(line):
                i += 1
            out.append(re.escape(line[i]))
            i += 1
    start = "^" if anchored else "^(?:.*/)?"
    return f"{start}{''.join(out)}{'/.*' if folder else '(?:/.*)?'}$", back


def rules(text: str) -> list[tuple[str, bool]]:
    return [p for line in text.split("\n") if (p := _pattern(line))]


def ignores(text: str) -> Callable[[str], bool]:
    """A predicate for paths relative to the folder of the ignore file.  A file in an ignored folder can't be taken back."""
    compiled = [(re.compile(p), back) for p, back in rules(text)]

    def decided(path: str) -> bool:
        last = [back for p, back in compiled if p.match(path)]
        return bool(last) and not last[-1]

    def ignored(path: str) -> bool:
        parts = path.split("/")
        return any(decided("/".join(parts[:k]) + "/") for k in range(1, len(parts))) or decided(path)

    return ignored


def is_ignored(uri: Column, root_uri: str, text: str) -> Column:
    """As a column of URIs; those outside root_uri are not ignored."""
    root = root_uri if root_uri.endswith("/") else f"{root_uri}/"
    test = ignores(text)

    @F.pandas_udf("boolean")
    def column(uris):
        return uris.map(lambda u: u is not None and u.startswith(root) and test(u[len(root) :]))

    return column(uri) if rules(text) else F.lit(False)
