"""The tool functions behind standard input and output: one JSON-RPC message a line, as assistants' tool protocol has it.

    python -m riskweave.serve PROJECT
"""

from __future__ import annotations

import inspect
import json
import os
import sys
from typing import TextIO

from riskweave.tools import Tools

#: The protocol's version and its numbers of errors.
PROTOCOL = "2024-11-05"
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS = -32700, -32600, -32601, -32602
_FILE = ("path", "string", "Relative path of a source file")
#: name: (function of Tools, description, (argument, type, description)...); those whose parameter has a default may be left out.
OFFERED = {
    "riskweave_analyze_file": ("analyze_file", "All symbols of a file with their metrics, the riskiest first.", (_FILE,)),
    "riskweave_high_risk_symbols": ("high_risk_symbols", "The symbols of a file whose failure risk is at least a threshold.", (_FILE, ("fMin", "number", "Least failure risk (0)"))),
    "riskweave_caller_tree": ("caller_tree", "Who calls a symbol, level by level, with metrics and a summary of the impact.", (_FILE, ("symbol", "string", "Name of the symbol"), ("depth", "number", "Levels of callers (5)"))),
    "riskweave_workspace_hotspots": ("workspace_hotspots", "The riskiest symbols of the whole project.", (("topN", "number", "How many (10)"),)),
}


class Failure(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _parameters(name: str) -> list[tuple[tuple[str, str, str], inspect.Parameter]]:
    function, _, arguments = OFFERED[name]
    own = list(inspect.signature(getattr(Tools, function)).parameters.values())[1:]
    return list(zip(arguments, own, strict=True))


def described(name: str) -> dict:
    fields = _parameters(name)
    schema = {"type": "object", "properties": {a: {"type": t, "description": d} for (a, t, d), _ in fields}, "required": [a for (a, _, _), p in fields if p.default is p.empty]}
    return {"name": name, "description": OFFERED[name][1], "inputSchema": schema}


def called(tools: Tools, name: str, given: dict) -> dict:
    if name not in OFFERED:
        raise Failure(INVALID_PARAMS, f"unknown tool {name}")
    values = {}
    for (argument, type_, _), parameter in _parameters(name):
        value = given.get(argument)
        if value is None and parameter.default is parameter.empty:
            raise Failure(INVALID_PARAMS, f"{argument} is missing")
        if value is not None:
            if not isinstance(value, str if type_ == "string" else (int, float)) or isinstance(value, bool):
                raise Failure(INVALID_PARAMS, f"{argument} is no {type_}")
            values[parameter.name] = int(value) if isinstance(parameter.default, int) and not isinstance(value, str) else value
    answer = getattr(tools, OFFERED[name][0])(**values)
    return {"content": [{"type": "text", "text": answer["text"]}]} | ({"isError": True} if answer["is_error"] else {})


def answered(tools: Tools, message: object) -> dict | None:
    """The answer to a message; none to a notification."""
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID_REQUEST, "message": "no request"}}
    method, given = message["method"], message.get("params") or {}
    if "id" not in message:
        return None
    try:
        if method == "initialize":
            result = {"protocolVersion": given.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "riskweave", "version": "0.1.0"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [described(name) for name in OFFERED]}
        elif method == "tools/call":
            result = called(tools, given.get("name"), given.get("arguments") or {})
        else:
            raise Failure(NO_METHOD, f"unknown method {method}")
    except Failure as e:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": e.code, "message": str(e)}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(tools: Tools, lines: TextIO, out: TextIO) -> None:
    """Answers line by line until the input ends."""
    for line in lines:
        if not line.strip():
            continue
        try:
            answer = answered(tools, json.loads(line))
        except json.JSONDecodeError as e:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(e)}}
        if answer is not None:
            out.write(json.dumps(answer, ensure_ascii=False) + "\n")
            out.flush()


def main() -> None:
    from riskweave.cli import _session

    real, sys.stdout = sys.stdout, sys.stderr  # nothing else may write between the answers
    serve(Tools(_session(), os.path.abspath(sys.argv[1] if len(sys.argv) > 1 else ".")), sys.stdin, real)


if __name__ == "__main__":
    main()
