"""Functions of Python sources, by the standard library's parser."""

from __future__ import annotations

import ast


def functions(source: str) -> list[tuple[str, int, int, int, int]]:
    """(name, line, character, first line, last line) of all functions, nested ones and methods too, outer before inner; [] if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = []
    todo = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            first, last = node.lineno - 1, (node.end_lineno or node.lineno) - 1
            found.append((node.name, first, node.col_offset, first, last))
        todo.extend(reversed(list(ast.iter_child_nodes(node))))
    return found
