import io
import json

import pytest

from riskweave import serve
from riskweave.tools import Tools


class Made(Tools):
    """Answers without an analysis: what a tool was called with."""

    def __init__(self):
        self.analysis = None

    def _answer(self, make):
        raise AssertionError

    def analyze_file(self, file):
        return {"text": f"file {file}", "is_error": False}

    def high_risk_symbols(self, file, f_min=0.0):
        return {"text": f"{file} {f_min}", "is_error": False}

    def caller_tree(self, file, symbol, depth=5):
        return {"text": f"{file} {symbol} {depth}", "is_error": symbol == "none"}

    def workspace_hotspots(self, top=10):
        return {"text": str(top), "is_error": False}


def talk(*messages):
    out = io.StringIO()
    serve.serve(Made(), io.StringIO("".join((m if isinstance(m, str) else json.dumps(m)) + "\n" for m in messages)), out)
    return [json.loads(x) for x in out.getvalue().splitlines()]


def call(name, **arguments):
    (answer,) = talk({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})
    return answer


def test_a_conversation():
    got = talk({"id": 0, "method": "initialize", "params": {"protocolVersion": "2025-01-01"}}, {"method": "notifications/initialized"}, "", "{broken", [1], {"id": "a", "method": "ping"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "nothing"})
    assert [x.get("id") for x in got] == [0, None, None, "a", 2, 3]
    assert got[0]["result"]["protocolVersion"] == "2025-01-01" and got[0]["result"]["capabilities"] == {"tools": {}}
    assert [got[k]["error"]["code"] for k in (1, 2, 5)] == [-32700, -32600, -32601]
    tools = {t["name"]: t["inputSchema"] for t in got[4]["result"]["tools"]}
    assert list(tools) == list(serve.OFFERED) and tools["riskweave_caller_tree"]["required"] == ["path", "symbol"] and tools["riskweave_workspace_hotspots"]["required"] == []


def test_calls():
    text = lambda x: x["result"]["content"][0]["text"]
    assert text(call("riskweave_analyze_file", path="é.ts")) == "file é.ts"
    assert text(call("riskweave_high_risk_symbols", path="a", fMin=2.5)) == "a 2.5" and text(call("riskweave_high_risk_symbols", path="a")) == "a 0.0"
    assert text(call("riskweave_caller_tree", path="a", symbol="f", depth=3.0)) == "a f 3"
    assert call("riskweave_caller_tree", path="a", symbol="none")["result"]["isError"] and text(call("riskweave_workspace_hotspots")) == "10"


@pytest.mark.parametrize("name, arguments", [("no", {}), ("riskweave_analyze_file", {}), ("riskweave_analyze_file", {"path": 3}), ("riskweave_workspace_hotspots", {"topN": "x"}), ("riskweave_workspace_hotspots", {"topN": True})])
def test_wrong_calls(name, arguments):
    assert call(name, **arguments)["error"]["code"] == -32602


def test_over_a_folder(spark, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("folder")
    (tmp_path / "a.ts").write_text("function f() { return 1; }\n")
    out = io.StringIO()
    request = json.dumps({"id": 1, "method": "tools/call", "params": {"name": "riskweave_analyze_file", "arguments": {"path": "a.ts"}}})
    serve.serve(Tools(spark, str(tmp_path)), io.StringIO(request), out)
    assert [s["name"] for s in json.loads(json.loads(out.getvalue())["result"]["content"][0]["text"])] == ["f"]
