import datetime

import pytest
from pyspark.sql import functions as F

from riskweave import model
from riskweave.functions.text import html_escaped
from riskweave.operators import graph, symbols
from riskweave.plans import providers
from riskweave.plans.engine import RiskEngine


def test_registry(spark):
    docs = spark.createDataFrame([("a.ts", "typescript"), ("b.py", "python"), ("c.md", "markdown")], "uri string, language_id string")
    lines = lambda n: lambda d: (d.select("uri", F.lit(1).alias("line1"), F.lit(n).alias("cc")), spark.createDataFrame([], model.CC_BY_NAME))
    registry = providers.CcRegistry(spark)
    assert [x.count() for x in registry.tables(docs)] == [0, 0]
    registry.register("typescript", lines(1.0))
    registry.register("typescript", lines(7.0))
    registry.register("python", lines(2.0))
    assert dict((r["uri"], r["cc"]) for r in registry.tables(docs)[0].collect()) == {"a.ts": 7.0, "b.py": 2.0}


def test_fallbacks(spark):
    some = spark.createDataFrame([(0, "a", "b")], model.EDGES)
    none = some.limit(0)
    assert graph.preferred(some, none).count() == 1 and graph.preferred(none, some).count() == 1
    broken = some.select(F.raise_error(F.lit("no server")).cast("string").alias("caller"))
    assert graph.preferred(broken, some).count() == 1

    def fails():
        raise OSError("no history")

    assert providers.churn_or_none(fails) is None and providers.churn_or_none(lambda: some) is some


def test_cutoff(spark):
    now = datetime.datetime(2024, 3, 31, 12)
    assert providers.cutoff(31, now) == datetime.datetime(2024, 2, 29, 12)
    commits = spark.createDataFrame([("a", now), ("a", now - datetime.timedelta(days=1)), ("b", datetime.datetime(2020, 1, 1))], "uri string, ts timestamp")
    assert providers.commits_since(commits, providers.cutoff(2, now)).collect() == [("a", 2)]


def test_editor_symbols(spark):
    rows = [("u", [0], "Class", "C"), ("u", [0, 1], "Constructor", "new"), ("u", [0, 0], "Method", "m"), ("u", [0, 0, 5], "Function", "inner"), ("u", [1], "Variable", "v")]
    got = symbols.flattened_symbols(spark.createDataFrame(rows, "uri string, path array<int>, kind string, name string")).orderBy("ord").collect()
    assert [r["name"] for r in got] == ["m", "inner", "new"]
    m = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0)], "ord long, id string, f double")
    assert symbols.first_selected(m, ["x", "b", "a"]).first()["id"] == "b" and symbols.first_selected(m, []).count() == 0
    assert spark.range(1).select(html_escaped(F.lit('<a b="&">'))).first()[0] == "&lt;a b=&quot;&amp;&quot;&gt;"


def test_hierarchy_scope(spark):
    calls = spark.createDataFrame(
        [(0, "file:///w/a", 1, 2, "file:///x/b", 3, 4), (1, "file:///x/b", 3, 4, "file:///w/a", 1, 2), (2, "file:///w/a", 1, 2, "file:///w/a", 1, 2), (3, "git:///w/a", 1, 2, "file:///w/a", 9, 2)],
        "ord int, caller_uri string, caller_line int, caller_char int, callee_uri string, callee_line int, callee_char int",
    )
    assert [tuple(r)[1:] for r in graph.hierarchy_edges(calls, "file:///w").collect()] == [("file:///w/a#1:2", "file:///x/b#3:4")]


def test_jacoco_follows_lcov(spark, tmp_path):
    files = {
        "src/p/A.java": "class A {\n  void f() {\n    g();\n  }\n}\n",
        "target/jacoco.xml": '<package name="p"><sourcefile name="A.java"><line nr="3" mi="0" ci="2"/></sourcefile></package>',
        "coverage/lcov.info": "SF:src/p/A.java\nDA:2,0\n",
        "coverage/node_modules/coverage/lcov.info": "SF:src/p/A.java\nDA:1,1\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    e = RiskEngine(spark)
    assert {(r["start_line"], r["executed"]) for r in e.reports(str(tmp_path), jacoco=True).collect()} == {(1, False), (2, True)}
    assert e.reports(str(tmp_path)).count() == 1 and e.reports(str(tmp_path / "src")).count() == 0


def test_tools_run_by_language(spark, tmp_path):
    """A stand-in for the tools prints a report for the file it is given."""
    import os

    from riskweave.model import CcSettings, Settings
    from riskweave.plans.engine import RiskEngine

    tool = tmp_path / "tool"
    tool.write_text(
        "#!/usr/bin/env python3\nimport json, sys\na = sys.argv[1:]\n"
        "if a[0] == 'check': print('<pmd><violation beginline=\"2\" rule=\"CyclomaticComplexity\">has a cyclomatic complexity of 9.</violation></pmd>')\n"
        "elif a[0] == '-m': print(json.dumps({a[-1]: [{'name': 'g', 'lineno': 1, 'complexity': 8}]}))\n"
        "else: print(json.dumps([{'messages': [{'ruleId': 'complexity', 'line': 1, 'message': 'has a complexity of 7'}]}]))\nsys.exit(1)\n"
    )
    os.chmod(tool, 0o755)
    root = tmp_path / "project"
    root.mkdir()
    (root / "a.ts").write_text("function f() { return 1; }\n")
    (root / "b.py").write_text("def g(): pass\n")
    (root / "C.java").write_text("class C {\n  int h() {\n    return 1;\n  }\n}\n")
    settings = Settings(cc=CcSettings(str(tool), str(tool), str(tool)), exclude_tests=False)
    found = RiskEngine(spark, settings).analyze_folder(str(root), registry=providers.tool_registry(spark, settings)).symbols
    assert {r["name"]: r["cc"] for r in found.collect()} == {"f": 7, "g": 8, "h": 9}
    off = Settings(cc=CcSettings(str(tool), "no-such-tool", str(tool), use_eslint_for_ts_js=False), exclude_tests=False)
    found = RiskEngine(spark, off).analyze_folder(str(root), registry=providers.tool_registry(spark, off)).symbols
    assert {r["name"]: r["cc"] for r in found.collect()} == {"f": 1, "g": 1, "h": 9}


def test_a_process_has_many_files(spark, tmp_path):
    """Reports are dealt out to files; a batch that can't be is asked again one by one, and a file that fails takes no other's report away."""
    import json
    import os
    import sys

    tool = tmp_path / "tool"
    tool.write_text(
        f"#!{sys.executable}\nimport json, os, sys\nopen({str(tmp_path / 'log')!r}, 'a').write('x')\n"
        "if any('bad' in p for p in sys.argv[2:]): sys.exit(2)\nprint(json.dumps({p: [{'name': 'f', 'lineno': 1, 'complexity': len(p)}] for p in sys.argv[2:]}))\n"
    )
    os.chmod(tool, 0o755)
    docs = lambda names: spark.createDataFrame([(f"file:///w/{n}.py",) for n in names], "uri string").coalesce(1)
    reports = lambda names, n: {r["uri"]: json.loads(r["content"]) for r in providers.tool_reports(docs(names), str(tool), (["cc", "<file>"], 20.0), split=providers.radon_split, batch_files=n).collect()}
    names = [f"é{k}" for k in range(10)]
    got = reports(names, 4)
    assert len(got) == 10 and all(list(x) == [u.removeprefix("file://")] for u, x in got.items())
    assert len((tmp_path / "log").read_text()) == 3
    got = reports([*names, "bad"], 4)
    assert len(got) == 10 and len((tmp_path / "log").read_text()) == 3 + 3 + 3  # the last batch again, file by file


def test_reports_are_dealt_out():
    eslint = '[{"filePath": "/b", "messages": [1]}, {"filePath": "/a", "messages": []}]'
    assert providers.eslint_split(eslint, ["/a", "/b"]) == {"/a": '[{"filePath": "/a", "messages": []}]', "/b": '[{"filePath": "/b", "messages": [1]}]'}
    assert list(providers.eslint_split('[{"messages": []}, {"messages": [2]}]', ["/a", "/b"])) == ["/a", "/b"]
    assert providers.pmd_split('<pmd><file name="/a&amp;b"><violation x="1">y</violation></file><file name="/c"/></pmd>', ["/a&b", "/d"]) == {"/a&b": '<pmd><file name="/a&amp;b"><violation x="1">y</violation></file></pmd>'}
    for split, text in ((providers.eslint_split, '[{"messages": []}]'), (providers.eslint_split, "x"), (providers.radon_split, "[]"), (providers.pmd_split, "")):
        with pytest.raises(ValueError):
            split(text, ["/a", "/b"])


def test_tools_are_dealt_over_cores(spark, tmp_path):
    """The files of a table with one partition go to processes of all cores."""
    echo = tmp_path / "echo.py"
    echo.write_text("import os, sys\nprint(os.path.basename(sys.argv[1]))\n")
    docs = spark.range(0, 24, 1, 1).select(F.concat(F.lit("file:///m"), F.col("id").cast("string"), F.lit(".py")).alias("uri"))
    found = providers.tool_reports(docs, "python3", ([str(echo), "<file>"], 15.0)).select("content", F.spark_partition_id().alias("part")).collect()
    assert sorted(r["content"].strip() for r in found) == sorted(f"m{k}.py" for k in range(24))
    assert len({r["part"] for r in found}) >= spark.sparkContext.defaultParallelism
