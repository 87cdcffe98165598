import pytest
from pyspark.sql import functions as F

from riskweave.sources import coverage, extract, ignore, java_code, python_code, script_code, tools


def reports(spark, *contents):
    return spark.createDataFrame([(f"r{i}", c) for i, c in enumerate(contents)], "report string, content string")


def lcov(spark, text):
    return [(r["file"], r["start_line"], r["executed"]) for r in coverage.lcov_statements(reports(spark, text)).orderBy("ord").collect()]


def test_lcov(spark):
    assert lcov(spark, "SF:a.ts\nDA:1,1\nDA:2,0\nend_of_record\n") == [("a.ts", 0, True), ("a.ts", 1, False)]
    assert lcov(spark, "DA:1,1\nSF: a b \r\nDA:3,2\r\n end_of_record \r\nDA:4,1\nSF:a b\nDA:9,1") == [("a b", 2, True), ("a b", 8, True)]
    assert lcov(spark, "SF:a\nDA:1\nDA:abc,1\nDA:0,1\nDA:-2,1\nDA:5,x\nDA:7,3,sum\n DA:8,1\nDA: 9x, 1y") == [("a", 6, True), ("a", 8, True)]
    assert lcov(spark, "SF:\nDA:1,1") == [] and lcov(spark, "") == []


def jacoco(spark, text):
    return [(r["file"], r["start_line"], r["executed"]) for r in coverage.jacoco_statements(reports(spark, text)).orderBy("file", "ord").collect()]


def test_jacoco(spark):
    line = '<line nr="{}" mi="0" ci="{}" mb="0" cb="0"/>'
    source = lambda n, *ls: f'<sourcefile name="{n}">' + "".join(line.format(*x) for x in ls) + "</sourcefile>"
    text = f'<report><package name="p/q">{source("A.java", (3, 1), (4, 0), (0, 5))}{source("B.java")}</package><package name="">{source("C.java", (1, 2))}</package></report>'
    assert jacoco(spark, text) == [("C.java", 0, True), ("p/q/A.java", 2, True), ("p/q/A.java", 3, False)]
    twice = f'<package name="p">{source("A.java", (1, 1), (2, 1))}{source("A.java", (7, 0))}</package>'
    assert jacoco(spark, twice) == [("p/A.java", 6, False)]
    assert jacoco(spark, '<package name="p"><sourcefile name="A.java"><line ci="1" nr="2" mi="0"/></sourcefile></package>') == []
    assert jacoco(spark, '<package name="p"><sourcefile name="A.java"/></package>') == []
    assert jacoco(spark, f'<package name="p">{source("A.java", (1, 1))}') == [("p/A.java", 0, True)]


def test_report_places(spark):
    s = coverage.lcov_statements(reports(spark, "SF:src/a b.ts\nDA:1,1\nSF:/abs/c.ts\nDA:2,1\nSF:./src/a b.ts\nDA:3,1"))
    got = {(r["uri"], r["start_line"]) for r in coverage.at_uris(s, "/w").collect()}
    assert got == {("file:///w/src/a%20b.ts", 2), ("file:///abs/c.ts", 1)}
    j = spark.createDataFrame([("p/A.java", True, 1, 1)], "file string, executed boolean, start_line int, end_line int")
    files = spark.createDataFrame([("file:///w/src/p/A.java",), ("file:///w/xp/A.java",), ("file:///w/z/p/A.java",)], "uri string")
    assert [r["uri"] for r in coverage.suffix_uris(j, files).collect()] == ["file:///w/src/p/A.java"]
    stored = coverage.merged(coverage.suffix_uris(j, files))
    assert coverage.stored(stored, "file:///W/src/p/A.java").count() == 0
    assert coverage.stored(stored, "file:///W/src/p/A.java", ignore_case=True).count() == 1


def tool(spark, text):
    return spark.createDataFrame([("u", text)], "uri string, content string")


def test_tool_reports(spark):
    eslint = '[{"messages":[{"ruleId":"complexity","line":3,"message":"has a complexity of 4."},{"ruleId":"complexity","line":3,"message":"complexity of 9"},{"ruleId":"no","line":4,"message":"complexity of 4"},{"ruleId":"complexity","message":"complexity of 4"}]},{"filePath":"x"}]'
    assert tools.eslint_complexity(tool(spark, eslint)).collect() == [("u", 3, 9.0)]
    assert tools.eslint_complexity(tool(spark, "{broken")).count() == 0
    radon = '{"/a/x.py":[{"name":"f","lineno":2,"complexity":3},{"name":"f","lineno":2,"complexity":1},{"name":"g","complexity":1}],"/b":[{"name":"h","lineno":1,"complexity":1}]}'
    assert tools.radon_complexity(tool(spark, radon), F.lit("/a/x.py")).collect() == [("u", "2:f", 1.0)]
    pmd = '<violation beginline="4" endline="9" rule="StdCyclomaticComplexity" method="m">\ncyclomatic complexity of 7.\n</violation><VIOLATION rule="cyclomatic" beginline="4">Complexity of 2</VIOLATION><violation beginline="5" rule="Other">complexity of 3</violation>'
    assert tools.pmd_complexity(tool(spark, pmd)).collect() == [("u", 4, 7.0)]
    assert [tuple(r)[2:] for r in tools.pmd_symbols(tool(spark, pmd)).collect()] == [("m", 3, 0, 3, 8)]
    log = spark.createDataFrame([("a.ts ",), ("",), ("b.ts",), ("a.ts",)], "value string")
    assert dict(tools.commit_counts(log, "file:///w").collect()) == {"file:///w/a.ts": 2, "file:///w/b.ts": 1}
    assert tools.run_tool(["no-such-tool-here"]) == "" and tools.run_tool(["sh", "-c", "echo x; exit 3"]) == "x\n"


@pytest.mark.parametrize(
    "text, path, want",
    [
        ("*.log", "a/b.log", True),
        ("/build", "build/x", True),
        ("/build", "a/build/x", False),
        ("build/", "build", False),
        ("build/", "a/build/x", True),
        ("*.log\n!keep.log", "keep.log", False),
        ("dir/\n!dir/a", "dir/a", True),
        ("a/**/b", "a/b", True),
        ("a/**/b", "a/x/y/b", True),
        ("**/t", "x/t", True),
        ("a/*", "a/b/c", True),
        ("a/*.ts", "a/b/c.ts", False),
        ("f?o[0-9]", "fxo7", True),
        ("[!a]x", "ax", False),
        ("# c\n\\#x", "#x", True),
        ("", "a", False),
        ("doc/frotz", "a/doc/frotz", False),
    ],
)
def test_ignore(text, path, want):
    assert ignore.ignores(text)(path) is want


def test_python_functions():
    source = "def f():\n  async def g():\n    pass\nclass C:\n  def m(self): pass\n"
    assert python_code.functions(source) == [("f", 0, 0, 0, 2), ("g", 1, 2, 1, 2), ("m", 4, 2, 4, 4)]
    assert python_code.functions("def (") == []


JAVA = """// class Wrong {
public class Service {
    private final Repo repo = new Repo();
    int n = 1;
    public Service() { }
    public void run(String s) {
        String t = "} // {";
        if (ok(s)) { repo.save(s); }
        Util.format(s); this.run(s); new Thing(); other.go();
        char c = '{';
    }
    private List<String> ok(String s) { return check(s); }
    static boolean check(String s)
    {
        return true;
    }
}
"""


def test_java():
    j = java_code.parse(JAVA)
    assert j.class_name == "Service" and dict(j.fields) == {"repo": "Repo"}
    assert [(m.name, m.line, m.end_line) for m in j.methods] == [("run", 5, 10), ("ok", 11, 11), ("check", 12, 15)]
    assert [c for c in j.methods[0].calls] == [(None, "ok"), ("repo", "save"), ("Util", "format"), ("this", "run"), (None, "Thing"), ("other", "go")]
    assert j.methods[1].calls == ()  # all on one line
    assert java_code.parse("interface I { void a(); }").class_name == ""
    assert java_code.functions("class A {\n void f() {\n") == [("f", 1, 0, 1, 2)]


SCRIPT = """import { add as plus } from "./utils";
import * as u from './u';
export function foo(a: number): number { return plus(a, 2) + bar(); }
const bar = () => 1, baz = async (x: string): Promise<void> => { await u.zip(x); };
export class Svc {
  handler = (e: Event) => { this.go(e); };
  constructor(private readonly a: X) { super(); }
  async go(e?: T): Promise<{ a: number }> { const r = /[/"]{/.exec(`a${foo(1)}}`); return r; }
  get size(): number { return 1; }
  abstract nope(): void;
}
declare function sig(a: string): void;
"""


def test_script():
    s = script_code.parse(SCRIPT)
    assert [(f.name, f.line, f.character, f.end_line, f.linked) for f in s.functions] == [
        ("foo", 2, 0, 2, True), ("bar", 3, 12, 3, True), ("baz", 3, 27, 3, True), ("handler", 5, 12, 5, False), ("go", 7, 2, 7, True), ("size", 8, 2, 8, True),
    ]
    assert s.imports == {"plus": ("./utils", "add"), "u": ("./u", "*")}


def test_extraction_survives_odd_files(spark):
    docs = spark.createDataFrame([(0, "a.py", "python", ["def ("]), (1, "b.ts", "typescript", ["function ("]), (2, "c", "unknown", ["x"]), (3, "d.java", "java", None), (4, "e.py", "python", ["def f(): pass"])], "ord long, uri string, language_id string, lines array<string>")
    assert [(r["uri"], r["name"]) for r in extract.functions(docs).collect()] == [("e.py", "f")]
    assert extract.calls(docs).count() == 0 and extract.fields(docs).count() == 0 and extract.imports(docs).count() == 0


def plain_jacoco(text):
    """The files of a report by regular expressions over the whole text."""
    import re

    out = {}
    for p in re.finditer(r'<package\s+name="([^"]*)"[^>]*>', text):
        body = text[p.start() :].split("</package>")[0]
        for s in re.finditer(r'<sourcefile\s+name="([^"]*)"[^>]*>(.*?)</sourcefile>', body, re.S):
            lines = [(int(n) - 1, int(c) > 0) for n, c in re.findall(r'<line\s+nr="(\d+)"\s+mi="\d+"\s+ci="(\d+)"[^/]*/>', s[2]) if int(n)]
            if lines:
                out[f"{p[1]}/{s[1]}" if p[1] else s[1]] = lines
    return out


@pytest.mark.parametrize("seed", range(4))
def test_reports_scanned_in_parts(spark, tmp_path, seed, monkeypatch):
    """Reports cut at any byte, files and packages going on over the cuts, give what a plain reader of the whole text gives."""
    import random

    rng = random.Random(seed)
    sources = lambda: "".join(rng.choice([f'<sourcefile name="{rng.choice("ABC")}.java">\n', "</sourcefile>", '<sourcefile name="E.java"/>', *[f'<line nr="{rng.randrange(9)}" mi="0" ci="{rng.randrange(2)}" mb="0" cb="0"/>'] * 4, "<counter/>", "\n "]) for _ in range(rng.randrange(60)))
    text = "<report>" + "".join(f'<package name="{rng.choice(["p/q", "r", ""])}">{sources()}</package>{sources()}' for _ in range(6)) + f'<package name="z">{sources()}'
    (tmp_path / "jacoco.xml").write_text(text)
    lcov = "".join(rng.choice([f"SF:{rng.choice('abc')}.ts\n", "end_of_record\n", "TN:\r\n", *[f"DA:{rng.randrange(9)},{rng.randrange(2)}\r\n"] * 5]) for _ in range(300))
    (tmp_path / "lcov.info").write_bytes(lcov.encode())
    file, want = "", []
    for line in lcov.replace("\r", "").split("\n"):
        file = line[3:] if line.startswith("SF:") else "" if line == "end_of_record" else file
        n, hits = map(int, line[3:].split(",")) if line.startswith("DA:") else (0, 0)
        want += [(file, n - 1, hits > 0)] * (n > 0 and file != "")
    monkeypatch.setattr(coverage, "PART_ROWS", 7)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        lines = coverage.report_lines(spark, [str(tmp_path / "lcov.info")])
        assert lines.select("part").distinct().count() > 8
        for reports_ in (lines, reports(spark, lcov)):
            got = coverage.lcov_statements(reports_).orderBy("ord").collect()
            assert [(r["file"], r["start_line"], r["executed"]) for r in got] == want
        for reports_ in (coverage.report_tags(spark, [str(tmp_path / "jacoco.xml")]), reports(spark, text)):
            got = {}
            for r in coverage.jacoco_statements(reports_).orderBy("file", "ord").collect():
                got.setdefault(r["file"], []).append((r["start_line"], r["executed"]))
            assert got == plain_jacoco(text)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_files_of_one_name(spark):
    """A key meets the one file that ends in it, though a hundred thousand others have its name."""
    from riskweave.sources import coverage as C

    files = spark.range(100_000).select(F.format_string("file:///w/m%d/src/p%d/index.java", "id", "id").alias("uri"))
    keys = spark.range(0, 100_000, 50).select(F.format_string("p%d/index.java", "id").alias("file"), F.lit(True).alias("executed"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    out = C.suffix_uris(keys.unionByName(keys.limit(1).withColumn("file", F.lit("other/index.java"))), files)
    assert out.count() == 2000 and out.select("uri").distinct().count() == 2000
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line and "_h" in line]
    assert joins and all("_h" in j and "_n" in j for j in joins)


def test_scanning_is_dealt_over_cores(spark):
    """A small table of many files is one task's to read, but not to scan."""
    text = F.split(F.concat(F.lit("function f"), F.col("id").cast("string"), F.lit("() { return 1; }")), "\n")
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("ord"), F.concat(F.lit("file:///m"), F.col("id").cast("string"), F.lit(".ts")).alias("uri"), F.lit("typescript").alias("language_id"), text.alias("lines"))
    found = extract.functions(docs).select("name", F.spark_partition_id().alias("part")).collect()
    assert sorted(r["name"] for r in found) == sorted(f"f{k}" for k in range(400))
    assert len({r["part"] for r in found}) >= spark.sparkContext.defaultParallelism
