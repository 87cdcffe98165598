import io
import json

import pytest
from pyspark.sql import functions as F

from riskweave import cli, tools
from riskweave.model import ChurnSettings, Settings
from riskweave.operators import resolution, symbols
from riskweave.plans import views
from riskweave.plans.engine import RiskEngine
from riskweave.streaming.churn import windowed_commits


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    files = {
        "src/main.ts": "import { add } from './utils';\n\nexport function main(): number {\n  return add(1, 2);\n}\n",
        "src/utils.ts": "export function add(a: number, b: number): number {\n  return a + b;\n}\n",
        "src/utils.test.ts": "import { add } from './utils';\nfunction check() {\n  add(1, 1);\n}\n",
        "src/helper.py": "def multiply(a, b):\n    return a * b\n",
        "src/A.java": "class A {\n  B b = new B();\n  void run() {\n    b.save();\n    if (x) { helper(); }\n  }\n  void helper() {\n    Util.format();\n  }\n}\n",
        "src/B.java": "class B {\n  void save() {\n    Util.format();\n  }\n}\n",
        "src/Util.java": "class Util {\n  static void format() {\n    done = 1;\n  }\n}\n",
        "node_modules/x/y.js": "function no() {}\n",
        "ignored/z.js": "function z() {}\n",
        ".gitignore": "ignored/\n",
        "coverage/lcov.info": "SF:src/utils.ts\nDA:1,4\nDA:2,4\nend_of_record\nSF:src/main.ts\nDA:3,1\nDA:4,0\nend_of_record\n",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def run(spark, *arguments):
    out, err = io.StringIO(), io.StringIO()
    return cli.main(list(arguments), spark, out, err), out.getvalue(), err.getvalue()


def test_analyze_command(spark, project):
    code, out, _ = run(spark, "--root", project, "--respect-gitignore")
    report = json.loads(out)
    found = {s["name"]: s | {"path": f["path"]} for f in report["files"] for s in f["symbols"]}
    assert code == 0 and set(found) == {"main", "add", "multiply", "run", "helper", "save", "format"}
    assert report["summary"] == {"filesAnalyzed": 6, "symbolsAnalyzed": 7, "averageCC": 1.14}
    # the test's call counts, though the test itself is left out
    assert (found["add"]["r"], found["add"]["t"], found["add"]["crap"], found["add"]["f"]) == (3, 1, 1, 3)
    assert (found["main"]["t"], found["main"]["path"]) == (0.5, "src/main.ts")
    assert (found["format"]["r"], found["save"]["r"], found["helper"]["r"]) == (1 + 1.5 + 1.5, 1.5, 1.5)
    assert [f["rollupScore"] for f in report["files"]] == sorted((f["rollupScore"] for f in report["files"]), reverse=True)


def test_other_commands(spark, project, tmp_path):
    target = tmp_path / "out.json"
    assert run(spark, "--root", project, "--no-exclude-tests", "--no-call-graph", "--output", str(target))[:2] == (0, "")
    report = json.loads(target.read_text())
    assert {s["r"] for f in report["files"] for s in f["symbols"]} == {1} and "src/utils.test.ts" in {f["path"] for f in report["files"]}
    code, out, _ = run(spark, "callers", "--root", project, "--file", "src/Util.java", "--symbol", "format", "--format", "text", "--depth", "x")
    assert code == 0 and out.splitlines()[:3] == ["IMPACT TREE: format", "File: src/Util.java", "Risk: LOW (F=8.0)"]
    assert "├─ helper [F=3.0]\n│  └─ run [F=6.0]\n└─ save [F=3.0]\n   └─ run [F=6.0]" in out and out.endswith("  Direct callers: 2\n  Total affected: 3")
    code, out, _ = run(spark, "callers", "--root", project, "--file", "src/Util.java", "--symbol", "format")
    tree = json.loads(out)
    assert [n["name"] for n in tree["callerTree"]] == ["helper", "save"] and tree["impactSummary"] == {"directCallers": 2, "totalAffected": 3}
    assert run(spark, "callers", "--root", project, "--file", "a", "--symbol", "nope")[0] == 1
    assert "No callers (entry point)" in run(spark, "callers", "--root", project, "--file", "main.ts", "--symbol", "main", "--format=text")[1]


def test_arguments(spark):
    assert run(spark, "--format", "xml") == (1, "", "Error: unsupported format 'xml'. Supported formats: json\n")
    assert run(spark, "callers", "--symbol", "x")[2] == "Error: --file is required for the callers command\n"
    assert run(spark, "callers", "--file", "x")[0] == 1 and run(spark, "--version")[1] == f"{cli.VERSION}\n" and run(spark, "--help")[0] == 0
    o = cli.parse(["--call-graph", "--no-call-graph", "--what", "x", "--root", "--verbose", "--no-exclude-tests", "--exclude-tests"])
    assert not o.switches["call-graph"] and o.switches["exclude-tests"] and o.values == {} and o.flags == {"what", "verbose"}
    assert [cli.parse(["callers", "--depth", d]).depth for d in ("3x", "0", "-1", "no", "7")] == [3, 5, 5, 5, 7]


METRICS = "ord long, id string, uri string, name string, cc double, t double, r double, crap double, f double, g double, f_prime double"


def test_tools_answer_with_errors(spark, project):
    from riskweave.plans.engine import Analysis

    m = spark.createDataFrame([(i, f"s{i}", f"file:///w/{'ab'[i % 2]}.ts", f"n{i}", 1.0, 0.0, 1.0, 2.0, float(10 * (i // 2)), 1.0, 1.0) for i in range(6)], METRICS)
    edges = spark.createDataFrame([(0, "s1", "s0")], "ord long, caller string, callee string")
    t = tools.Tools(spark, analysis=lambda: Analysis(m, symbols.file_rollup(m), edges))
    names = lambda a: [x["name"] for x in json.loads(a["text"])]
    assert names(t.workspace_hotspots(3)) == ["n4", "n5", "n2"] and names(t.analyze_file("a.ts")) == ["n4", "n2", "n0"]
    assert names(t.high_risk_symbols("w/b.ts", 10)) == ["n5", "n3"]
    assert json.loads(t.caller_tree("a.ts", "n0")["text"])["impactSummary"]["directCallers"] == 1
    assert t.caller_tree("a.ts", "none")["is_error"] and t.workspace_hotspots(-1)["is_error"]


def test_small_graph_end_to_end(spark):
    inputs = spark.createDataFrame([(0, "a", "u", "a", 8.0, 0.7), (1, "b", "u", "b", 3.0, 1.0), (2, "c", "v", "c", 12.0, 0.2)], "ord long, id string, uri string, name string, cc double, t double")
    edges = spark.createDataFrame([(0, "a", "c"), (1, "b", "c")], "ord long, caller string, callee string")
    churn = spark.createDataFrame([("v", 0), ("u", 10)], "uri string, commits long")
    a = RiskEngine(spark, Settings(churn=ChurnSettings(enabled=True), file_rollup="sum")).measured(inputs, edges, churn)
    c = a.symbols.where("id = 'c'").first()
    assert (c["r"], c["g"]) == (3, 1) and c["crap"] == pytest.approx(85.728) and c["f"] == pytest.approx(257.184) and a.edges_count() == 2
    rollup = dict(a.file_rollup.collect())
    assert rollup["u"] == pytest.approx((64 * 0.027 + 8 + 3) * 3.39789527)
    assert a.symbols.count() == 3


def coverage_of(spark, statements, start=10, end=20, fallback=0.0):
    b = spark.createDataFrame([("x", "u", start, end)], "id string, uri string, body_start int, body_end int")
    s = spark.createDataFrame(statements, "uri string, executed boolean, start_line int, end_line int")
    return symbols.coverage(b, s, fallback).first()["t"]


def test_coverage_edges(spark):
    u = lambda e, a, b: ("u", e, a, b)
    assert coverage_of(spark, [u(True, 10, 10), u(False, 15, 15), u(True, 20, 20)]) == pytest.approx(2 / 3)
    assert coverage_of(spark, [u(True, 0, 9)]) == 0 and coverage_of(spark, [u(True, 21, 30)]) == 0 and coverage_of(spark, [u(True, 5, 15)]) == 1
    assert coverage_of(spark, [("v", True, 12, 12)], fallback=0.25) == 0.25
    # wide statements meet wide bodies in many buckets and count once
    assert coverage_of(spark, [u(True, 0, 5000), u(False, 300, 4000), u(False, 900, 901), u(True, 1, 2)], 100, 3000) == pytest.approx(1 / 3)


def test_cursor_and_sorting(spark):
    fn = spark.createDataFrame([("u", 0, "outer", 1, 0, 1, 9), ("u", 1, "inner", 3, 2, 3, 5)], "uri string, ord int, name string, sel_line int, sel_char int, body_start int, body_end int")
    at = spark.createDataFrame([("u", 4), ("u", 0), ("u", 9)], "uri string, line int")
    both = spark.createDataFrame([("u#1:0",), ("u#3:2",)], "id string")
    assert {(r["line"], r["name"]) for r in symbols.at_cursor(fn, both, at).collect()} == {(4, "outer"), (9, "outer")}
    assert {r["name"] for r in symbols.at_cursor(fn, both.where("id = 'u#3:2'"), at).collect()} == {"inner"}
    m = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0), (2, "c", 2.0)], "ord long, id string, cc double")
    assert [r["id"] for r in resolution.ordered_by(m, "cc").orderBy("place").collect()] == ["b", "c", "a"]
    with pytest.raises(ValueError):
        resolution.ordered_by(m, "r")


def test_views(spark):
    m = spark.createDataFrame([(0, "a", "u", "fa", 1.0, 0.0, 1.0, 2.0, 60.0, 1.0, 200.0), (1, "a", "u", "fb", 1.0, 0.0, 1.0, 2.0, 6.0, 1.0, 2.0)], METRICS)
    assert symbols.last_by_id(m).first()["name"] == "fb"
    docs = spark.createDataFrame([("u",), ("v",)], "uri string")
    assert dict(views.decorations(docs, symbols.file_rollup(m)).collect()) == {"u": "error", "v": "none"}
    fn = spark.createDataFrame([("a", 1, 2)], "uri string, sel_line int, sel_char int")
    assert views.lenses(fn, m.withColumn("id", F.lit("a#1:2")), "X").first()["title"] == "X F=6  R=1.00  CRAP=2.0"
    assert views.files_by(m, "f").first()["largest"] == 60 and views.of_file(m, "v").count() == 0
    with pytest.raises(ValueError):
        views.hotspots(m, -1)


def test_settings():
    given = {"rank.max_iterations": 7, "file_rollup": "sum"}
    s = Settings.load(lambda name, default: given.get(name, default))
    assert (s.rank.max_iterations, s.rank.epsilon, s.file_rollup, s.max_files) == (7, 1e-6, "sum", 400)


def test_streaming_extension(spark):
    commits = spark.sql("SELECT 'a' AS uri, TIMESTAMP '2024-01-02 03:00:00' AS ts UNION ALL SELECT 'a', TIMESTAMP '2024-01-02 05:00:00'")
    got = windowed_commits(commits, "2 days", "1 day").orderBy("window_end").collect()
    assert [r["commits"] for r in got] == [2, 2]
