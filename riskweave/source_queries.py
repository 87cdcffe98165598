"""Registered queries of the operators that read source files and reports, with their DuckDB oracles.

Sources are made of the driver's tables: a supplier is a Java class, a part a Python module, a customer a TypeScript module.  Folders are made of the
nations, so that discovery and the readers of reports work on files.
"""

from __future__ import annotations

import io
import json
import os
import subprocess
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import cli, lineage
from riskweave.functions import metrics as M
from riskweave.functions import text as X
from riskweave.model import CcSettings, Settings
from riskweave.operators import callers, graph, symbols
from riskweave.plans import providers, views
from riskweave.plans.engine import Analysis, RiskEngine
from riskweave.queries import EVENT_METRICS, LAYOUT, SYMBOLS, TRANSITIONS, bodies, event_metrics, part_metrics, purchase_tree, q4, r4, registered, t, transitions
from riskweave.sources import coverage, extract, files, listing, tools
from riskweave.tools import Tools


def filled(template: str, **columns) -> F.col:
    """The template's lines, with columns in the place of <names>."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit(f"<{name}>"), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    return F.split(out, "\n")


JAVA = """package made.up;
public class S<k> { // class Other
  private S<n> peer;
  protected final S<n> peer = null;
  public static String run(int a) {
    if (a > 1) { return peer.step(a); }
    String s = "} other("; char c = '}'; // done() }
    S<m>.run(a);
    return step(a);
  }
  List<Integer> step(int b) {
    super(b); while (b > 2) { new Thing(b); }
    this.run(b);
  }
  return run(1);
"""


def java_sources(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier")
    lines = filled(JAVA, k="s_suppkey", n="s_nationkey", m=F.col("s_suppkey") + 1)
    return s.select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("file:///j/S"), F.col("s_suppkey").cast("string"), F.lit(".java")).alias("uri"), F.lit("java").alias("language_id"), lines.alias("lines"))


PYTHON = """class A:
    @cached
    def f<k>(self):
        async def inner():
            return 1
        return inner

def g(x): return lambda: x
"""


def python_sources(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth module doesn't parse."""
    p = t(spark, d, "part")
    text = F.when(F.col("p_partkey") % 10 == 0, F.array(F.lit("def broken(x: return"))).otherwise(filled(PYTHON, k="p_partkey"))
    return p.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("file:///p/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("uri"), F.lit("python").alias("language_id"), text.alias("lines"))


SCRIPT = """import { f as back } from './m<next>';
function f(a: number) {
  if (a > 1) { return back(a); }
  return g(a);
}
const g = (b: number) => {
  return b;
};
class C {
  get size() { return 1; }
  constructor() {}
  run() { return this.go(); }
  go(): number { return f(2) + g(1); }
}
function (x) { return x; }
export { f };
"""


def script_sources(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    lines = filled(SCRIPT, next=F.col("c_custkey") + 1)
    return c.select(F.col("c_custkey").alias("ord"), F.concat(F.lit("file:///t/m"), F.col("c_custkey").cast("string"), F.lit(".ts")).alias("uri"), F.lit("typescript").alias("language_id"), lines.alias("lines"))


def functions_sql(table: str, uri: str, rows: list[tuple], where: str = "true") -> str:
    """A row for each of rows(ord, name, line, character, first, last), names being SQL."""
    one = "SELECT {u} AS uri, {0} AS ord, {1} AS name, {2} AS sel_line, {3} AS sel_char, {4} AS body_start, {5} AS body_end FROM {t} WHERE {w}"
    return " UNION ALL ".join(one.format(*r, u=uri, t=table, w=where) for r in rows)


JAVA_URI, PY_URI, TS_URI = "'file:///j/S' || s_suppkey || '.java'", "'file:///p/m' || p_partkey || '.py'", "'file:///t/m' || c_custkey || '.ts'"


@registered(functions_sql("supplier", JAVA_URI, [(0, "'run'", 4, 0, 4, 9), (1, "'step'", 10, 0, 10, 13)]))
def java_symbols(spark, d):
    return extract.functions(java_sources(spark, d))


@registered(functions_sql("part", PY_URI, [(0, "'f' || p_partkey", 2, 4, 2, 5), (1, "'inner'", 3, 8, 3, 4), (2, "'g'", 7, 0, 7, 7)], "p_partkey % 10 <> 0"))
def python_symbols(spark, d):
    return extract.functions(python_sources(spark, d))


@registered(functions_sql("customer", TS_URI, [(0, "'f'", 1, 0, 1, 4), (1, "'g'", 5, 10, 5, 7), (2, "'size'", 9, 2, 9, 9), (3, "'run'", 11, 2, 11, 11), (4, "'go'", 12, 2, 12, 12)]))
def script_symbols(spark, d):
    return extract.functions(script_sources(spark, d))


@registered("""SELECT 'java' AS kind, 2 * count(*) AS n FROM supplier UNION ALL SELECT 'python', 3 * count(*) FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT 'script', 5 * count(*) FROM customer""")
def symbols_by_language(spark, d):
    """All languages in one table of documents, and a plain text that has no functions."""
    docs = java_sources(spark, d).unionByName(python_sources(spark, d)).unionByName(script_sources(spark, d))
    docs = docs.unionByName(docs.where("ord = 1").withColumn("language_id", F.lit("plaintext")).withColumn("uri", F.concat("uri", F.lit(".txt"))))
    kind = F.expr("CASE WHEN uri LIKE '%.java' THEN 'java' WHEN uri LIKE '%.py' THEN 'python' WHEN uri LIKE '%.ts' THEN 'script' ELSE 'other' END")
    return extract.functions(docs).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@registered(f"SELECT {JAVA_URI} AS uri, 'peer' AS name, 'S' || s_nationkey AS type FROM supplier")
def java_fields(spark, d):
    return extract.fields(java_sources(spark, d)).select("uri", "name", "type")


_J = lambda k: f"'file:///j/S' || {k} || '.java#"
JAVA_EDGES = f"""SELECT {_J('s_suppkey')}4:0' AS caller, {_J('s_nationkey')}10:0' AS callee FROM supplier WHERE s_nationkey IN (SELECT s_suppkey FROM supplier)
UNION SELECT {_J('s_suppkey')}4:0', {_J('(s_suppkey + 1)')}4:0' FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)
UNION SELECT {_J('s_suppkey')}4:0', {_J('s_suppkey')}10:0' FROM supplier
UNION SELECT {_J('s_suppkey')}10:0', {_J('s_suppkey')}4:0' FROM supplier"""
_T = lambda k: f"'file:///t/m' || {k} || '.ts#"
SCRIPT_EDGES = f"""SELECT {_T('c_custkey')}1:0' AS caller, {_T('(c_custkey + 1)')}1:0' AS callee FROM customer WHERE c_custkey + 1 IN (SELECT c_custkey FROM customer)
UNION ALL SELECT {_T('c_custkey')}1:0', {_T('c_custkey')}5:10' FROM customer
UNION ALL SELECT {_T('c_custkey')}11:2', {_T('c_custkey')}12:2' FROM customer
UNION ALL SELECT {_T('c_custkey')}12:2', {_T('c_custkey')}1:0' FROM customer
UNION ALL SELECT {_T('c_custkey')}12:2', {_T('c_custkey')}5:10' FROM customer"""


@registered(JAVA_EDGES)
def java_edges_from_source(spark, d):
    docs = java_sources(spark, d).unionByName(script_sources(spark, d))
    return RiskEngine(spark).call_graph(extract.by_family(docs, "java")).select("caller", "callee")


@registered(SCRIPT_EDGES)
def script_edges_from_source(spark, d):
    docs = java_sources(spark, d).unionByName(script_sources(spark, d))
    return RiskEngine(spark).call_graph(extract.by_family(docs, "script")).select("caller", "callee")


@registered(f"SELECT (SELECT count(*) FROM ({SCRIPT_EDGES})) + (SELECT count(*) FROM ({JAVA_EDGES})) AS edges")
def edges_count(spark, d):
    edges = RiskEngine(spark).call_graph(java_sources(spark, d).unionByName(script_sources(spark, d)))
    return spark.createDataFrame([(Analysis(edges, edges, edges).edges_count(),)], "edges long")


#: Modules of a supplier, each passing on the one before it, and one that calls through all of them into the next supplier's.
CHAIN = {
    "l0": "export function f(a) { return a; }",
    "l1": "export { f as f1 } from './l0';",
    "l2": "export * from './l1';",
    "l3": "import { f1 as g } from './l2';\nexport { g as f3 };",
    "l4/index": "export * from '../l3';",
    "main": "import { f3 } from '../c<next>/l4';\nfunction run() { return f3(1); }",
}
#: A class that extends another supplier's, and one that calls it through a parameter, fields and a variable.
TYPED = {
    "r": "import { R as Up } from './r<up>';\nexport class R extends Up {\n  own() { return this.base0(); }\n<more>}",
    "u": "import { R } from './r<k>';\nclass U {\n  private field: R;\n  made = new R();\n  run(p: R) { p.own(); this.field.base0(); }\n  more() { const x = new R(); x.base0(); this.made.own(); }\n}",
}


def supplier_modules(spark: SparkSession, d: str, modules: dict[str, str], path: str, table: str = "supplier", key: str = "s_suppkey") -> DataFrame:
    """Documents of all suppliers, or rows of another table, one for each of the modules, at paths with <k> and <name>."""
    k = F.col(key)
    given = {"next": k + 1, "up": F.floor(k / 2), "k": k, "more": F.when(k <= 1, "  base0() { return 1; }\n").otherwise("")}
    made = [F.struct(F.lit(i).alias("i"), F.replace(F.replace(F.lit(path), F.lit("<k>"), k.cast("string")), F.lit("<name>"), F.lit(name)).alias("uri"), filled(text, **given).alias("lines")) for i, (name, text) in enumerate(modules.items())]
    docs = t(spark, d, table).select(key, F.inline(F.array(*made)))
    return docs.select((k * len(modules) + F.col("i")).alias("ord"), "uri", F.lit("typescript").alias("language_id"), "lines")


@registered("""SELECT 'file:///c/c' || s_suppkey || '/main.ts#1:0' AS caller, 'file:///c/c' || (s_suppkey + 1) || '/l0.ts#0:0' AS callee FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)""")
def reexported_calls(spark, d):
    """Calls through chains of five modules: named exports, renamed ones, stars, an import passed on, the index of a folder."""
    return RiskEngine(spark).call_graph(supplier_modules(spark, d, CHAIN, "file:///c/c<k>/<name>.ts")).select("caller", "callee")


_ROOT = "'file:///r/r' || least(s_suppkey, 1) || '.ts#3:2'"


@registered(f"""SELECT 'file:///r/u' || s_suppkey || '.ts#' || spot AS caller, 'file:///r/r' || s_suppkey || '.ts#2:2' AS callee FROM supplier CROSS JOIN (VALUES ('4:2'), ('5:2')) v(spot)
UNION ALL SELECT 'file:///r/u' || s_suppkey || '.ts#' || spot, {_ROOT} FROM supplier CROSS JOIN (VALUES ('4:2'), ('5:2')) v(spot)
UNION ALL SELECT 'file:///r/r' || s_suppkey || '.ts#2:2', {_ROOT} FROM supplier""")
def typed_calls(spark, d):
    """Calls through parameters, fields, variables and this, into classes and into those they extend over files."""
    return RiskEngine(spark).call_graph(supplier_modules(spark, d, TYPED, "file:///r/<name><k>.ts")).select("caller", "callee")


# run: if, another through the text of a string and no more; step: while
@registered(f"""WITH one AS ({JAVA_EDGES}) SELECT 'file:///j/S' || s_suppkey || '.java#' || line || ':0' AS id, name, CAST(cc AS DOUBLE) AS cc, CAST(t AS DOUBLE) AS t
FROM supplier CROSS JOIN (VALUES (4, 'run', 2, 0.5), (10, 'step', 2, 0.25)) v(line, name, cc, t)""")
def analyzed_sources(spark, d):
    """The whole engine over Java sources: complexity from the text, coverage of two statements in run and none in step."""
    docs = java_sources(spark, d)
    hits = docs.select("uri", F.explode(F.array(*[F.struct(F.lit(e).alias("executed"), F.lit(k).alias("start_line"), F.lit(k).alias("end_line")) for e, k in ((True, 5), (False, 9), (True, 14))])).alias("s"))
    settings = Settings.load(lambda name, default: 0.25 if name == "coverage.fallback_t" else default)
    found = RiskEngine(spark, settings).analyze(docs, hits.select("uri", "s.*"), spark.createDataFrame([], "ord long, caller string, callee string"))
    return found.symbols.select("id", "name", "cc", "t")


@registered("SELECT s_suppkey, 'public class S' || s_suppkey || ' { // class Other' || chr(10) || '  private S' || s_nationkey || ' peer;' AS body FROM supplier")
def document_slice(spark, d):
    return java_sources(spark, d).select(F.col("ord").alias("s_suppkey"), symbols.slice_text(F.col("lines"), F.lit(1), F.lit(2)).alias("body"))


@registered("SELECT s_suppkey, '  return run(1);' || chr(10) AS tail, 'package made.up;' AS head FROM supplier")
def document_clamped(spark, d):
    text = lambda a, b: symbols.clamped_text(F.col("lines"), F.lit(a), F.lit(b))
    return java_sources(spark, d).select(F.col("ord").alias("s_suppkey"), text(14, 99).alias("tail"), text(-5, 0).alias("head"))


# ---------------------------------------------------------------- coverage reports


def _lcov(spark: SparkSession, d: str, column: str, prefix: str) -> DataFrame:
    record = F.concat(F.lit("DA:"), F.col("event_id").cast("string"), F.when(F.col("event_type") == "click", ",3").otherwise(",0"))
    body = t(spark, d, "events").where("event_id > 0").groupBy(F.col(column).alias("k")).agg(F.array_join(F.array_sort(F.collect_list(record)), "\n").alias("b"))
    return body.select(F.concat(F.lit(prefix), F.col("k").cast("string")).alias("report"), F.concat(F.lit(f"SF:{prefix}"), F.col("k").cast("string"), F.lit(".ts\n"), "b", F.lit("\nend_of_record")).alias("content"))


@registered("""SELECT 'src/' || user_id || '.ts' AS file, 2 * count(*) AS total, 2 * count(*) FILTER (WHERE event_type = 'click') AS covered FROM events WHERE event_id > 0 GROUP BY 1""")
def lcov_merged(spark, d):
    one = coverage.lcov_statements(_lcov(spark, d, "user_id", "src/"))
    return coverage.merged(one, one).groupBy("file").agg(F.count("*").alias("total"), F.count_if("executed").alias("covered"))


@registered("""SELECT 'file:///w/' || CASE WHEN user_id % 3 = 1 THEN 'a/' ELSE '' END || 'src/' || user_id || '.ts' AS uri, count(*) AS total FROM events WHERE event_id > 0 GROUP BY 1""")
def lcov_uris(spark, d):
    """Relative paths, dot segments, absolute paths and backslashes come to file URLs below the root."""
    k = F.regexp_extract("file", "([0-9]+)", 1).cast("long")
    odd = F.when(k % 3 == 0, F.concat(F.lit("./x/../"), "file")).when(k % 3 == 1, F.concat(F.lit("/w/a/"), "file")).otherwise(F.replace("file", F.lit("/"), F.lit("\\")))
    found = coverage.lcov_statements(_lcov(spark, d, "user_id", "src/")).withColumn("file", odd)
    return coverage.at_uris(found, "/w").groupBy("uri").agg(F.count("*").alias("total"))


@registered("""SELECT 'file:///w/a/com/acme/F' || user_id || '.java' AS uri, count(*) AS total FROM events WHERE event_id > 0 AND user_id % 4 <> 0 GROUP BY 1""")
def jacoco_uris(spark, d):
    """Keys come to the first file whose path ends in them; a fourth of the keys has no file, each other key two."""
    e = t(spark, d, "events")
    users = e.select("user_id").distinct().where("user_id % 4 <> 0")
    name = F.concat(F.lit("/com/acme/F"), F.col("user_id").cast("string"), F.lit(".java"))
    known = users.select(F.explode(F.array(F.concat(F.lit("file:///w/b"), name), F.concat(F.lit("file:///w/a"), name), F.concat(F.lit("file:///w/a/other/F"), F.col("user_id").cast("string"), F.lit(".java")))).alias("uri"))
    line = F.concat(F.lit('<line nr="'), F.col("event_id").cast("string"), F.lit('" mi="1" ci="0" mb="0" cb="0"/>'))
    reports = e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("b")).select(
        F.col("user_id").cast("string").alias("report"),
        F.concat(F.lit('<report><package name="com/acme"><sourcefile name="F'), F.col("user_id").cast("string"), F.lit('.java">'), "b", F.lit("</sourcefile></package></report>")).alias("content"),
    )
    return coverage.suffix_uris(coverage.jacoco_statements(reports), known).groupBy("uri").agg(F.count("*").alias("total"))


@registered("SELECT count(*) AS exact, 0 AS other_case, count(*) AS folded FROM (SELECT 1 FROM events WHERE event_id > 0 AND user_id = (SELECT min(user_id) FROM events WHERE event_id > 0))")
def coverage_lookup(spark, d):
    found = coverage.lcov_statements(_lcov(spark, d, "user_id", "src/")).withColumnRenamed("file", "uri")
    k = t(spark, d, "events").where("event_id > 0").agg(F.min("user_id")).first()[0]
    rows = coverage.stored(found, f"src/{k}.ts").count(), coverage.stored(found, f"SRC/{k}.TS").count(), coverage.stored(found, f"SRC/{k}.TS", True).count()
    return spark.createDataFrame([rows], "exact long, other_case int, folded long")


# ---------------------------------------------------------------- reports of tools


@registered("""SELECT CAST(user_id AS VARCHAR) AS uri, 'm' || (event_id % 7) AS name, CAST(event_id % 50 - 1 AS INT) AS sel_line,
  CAST(arg_min(event_id % 50 + CASE WHEN event_type = 'click' THEN 4 ELSE 0 END, event_id) - 1 AS INT) AS body_end FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3""")
def pmd_symbols(spark, d):
    rule = F.when(F.col("event_type") == "error", "UnusedImport").otherwise("CyclomaticComplexity")
    line = (F.col("event_id") % 50).cast("string")
    end = F.when(F.col("event_type") == "click", F.concat(F.lit(' endline="'), (F.col("event_id") % 50 + 4).cast("string"), F.lit('"'))).otherwise("")
    tag = F.concat(F.lit('<violation beginline="'), line, F.lit('"'), end, F.lit(' method="m'), (F.col("event_id") % 7).cast("string"), F.lit('" rule="'), rule, F.lit('">x</violation>'))
    reports = t(spark, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", tag.alias("t")))), lambda x: x["t"]), "\n").alias("b"))
    return tools.pmd_symbols(reports.select(F.col("user_id").cast("string").alias("uri"), F.concat(F.lit("<pmd>"), "b", F.lit("</pmd>")).alias("content"))).select("uri", "name", "sel_line", "body_end")


@registered("SELECT CAST(event_id AS VARCHAR) AS uri, event_type AS name, CAST(user_id % 100 AS INT) AS sel_line, CAST(3 AS INT) AS sel_char, CAST(1 AS INT) AS body_start, CAST(9 AS INT) AS body_end FROM events WHERE event_type NOT IN ('click', 'view')")
def python_symbol_json(spark, d):
    """A row lacks a field (click), or holds a number as text (view)."""
    whole = F.struct(F.col("event_type").alias("name"), (F.col("user_id") % 100).alias("selectionStartLine"), F.lit(3).alias("selectionStartCharacter"), F.lit(1).alias("bodyStartLine"), F.lit(9).alias("bodyEndLine"))
    text = F.to_json(F.array(whole))
    broken = F.when(F.col("event_type") == "click", F.replace(text, F.lit("bodyEndLine"), F.lit("end"))).when(F.col("event_type") == "view", F.replace(text, F.lit(":9"), F.lit(':"9"'))).otherwise(text)
    reports = t(spark, d, "events").select(F.col("event_id").cast("string").alias("uri"), broken.alias("content"))
    return tools.python_symbols(reports).drop("ord")


@registered("SELECT 'file:///w/src/' || event_type || '.ts' AS uri, count(*) AS commits FROM events GROUP BY 1")
def churn_below_root(spark, d):
    lines = t(spark, d, "events").select(F.concat(F.lit("  src/"), "event_type", F.lit(".ts ")).alias("value"))
    return tools.commit_counts(lines.unionByName(lines.limit(3).select(F.lit(" ").alias("value"))), "file:///w")


@registered("SELECT 'ran' AS printed, '' AS missing")
def tool_output(spark, d):
    """Output counts whatever the exit code; a command that can't be run prints nothing."""
    return spark.createDataFrame([(tools.run_tool([sys.executable, "-c", "print('ran', end=''); raise SystemExit(3)"]), tools.run_tool(["no-such-tool-here"]))], "printed string, missing string")


@registered("""SELECT event_type AS language, 'line' AS kind, count(DISTINCT user_id) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1
UNION ALL SELECT event_type, 'name', count(DISTINCT user_id) FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def cc_registry(spark, d):
    """Providers by language: the later of two counts, a language without one has no tool."""
    docs = t(spark, d, "events").select(F.col("event_type").alias("language_id"), F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("uri")).distinct()
    lines = lambda n: lambda x: (x.select("uri", F.lit(n).alias("line1"), F.lit(1.0).alias("cc")), spark.createDataFrame([], "uri string, key string, cc double"))
    names = lambda x: (spark.createDataFrame([], "uri string, line1 int, cc double"), x.select("uri", F.lit("1:f").alias("key"), F.lit(1.0).alias("cc")))
    registry = providers.CcRegistry(spark)
    for language, provider in (("click", names), ("click", lines(1)), ("view", lines(2)), ("purchase", names)):
        registry.register(language, provider)
    by_line, by_name = registry.tables(docs)
    both = by_line.select("uri", F.lit("line").alias("kind")).unionByName(by_name.select("uri", F.lit("name").alias("kind")))
    return both.groupBy(F.substring_index("uri", "/", 1).alias("language"), "kind").agg(F.count("*").alias("n"))


@registered(f"SELECT 'primary' AS source, caller, callee FROM ({TRANSITIONS}) UNION ALL SELECT 'fallback', caller, callee FROM ({TRANSITIONS})")
def hybrid_edges(spark, d):
    edges = transitions(spark, d)
    first, second = graph.preferred(edges, edges.limit(0)), graph.preferred(edges.limit(0), edges)
    return first.select(F.lit("primary").alias("source"), "caller", "callee").unionByName(second.select(F.lit("fallback").alias("source"), "caller", "callee"))


@registered("SELECT event_type AS uri, count(*) AS commits FROM events GROUP BY 1")
def churn_or_none(spark, d):
    """A provider that fails gives no churn and a warning, one that works its table: what is left of the two."""
    counts = t(spark, d, "events").groupBy(F.col("event_type").alias("uri")).agg(F.count("*").alias("commits"))
    found = [providers.churn_or_none(lambda: spark.read.parquet(f"{d}/no-such-table.parquet")), providers.churn_or_none(lambda: counts)]
    (left,) = [x for x in found if x is not None]
    return left


@registered("""SELECT * FROM (VALUES ('coverage.fallback_t', '0.5'), ('rank.max_iterations', '7'), ('cc.eslint_path', 'eslint'), ('churn.enabled', 'False'), ('file_rollup', 'max'), ('max_files', '400')) v(name, setting)""")
def settings_loaded(spark, d):
    given = {"coverage.fallback_t": 0.5, "rank.max_iterations": 7}
    s = Settings.load(lambda name, default: given.get(name, default))
    rows = [("coverage.fallback_t", s.coverage.fallback_t), ("rank.max_iterations", s.rank.max_iterations), ("cc.eslint_path", s.cc.eslint_path), ("churn.enabled", s.churn.enabled), ("file_rollup", s.file_rollup), ("max_files", s.max_files)]
    return spark.createDataFrame([(n, str(v)) for n, v in rows], "name string, setting string")


#: Stands in for a complexity tool: it counts conditions in all files that it is given, and prints what radon would.
TOOL = """import json, sys
out = {}
for path in sys.argv[3:]:
    with open(path) as f:
        out[path] = [{"name": "f", "lineno": 1, "complexity": 1 + f.read().count("if ")}]
print(json.dumps(out))
"""


@registered("SELECT s_suppkey, CAST(1 + s_suppkey % 5 AS DOUBLE) AS cc FROM supplier")
def tool_complexity(spark, d):
    """Files of all suppliers, measured by a program that the executors run on batches of them, through the registry of tools."""
    root = "/" + f"{lineage.shared_folder(spark)}/tools-{uuid.uuid4().hex}".removeprefix("file:").lstrip("/")
    s = t(spark, d, "supplier")
    text = F.concat(F.lit("def f(x):\n"), F.repeat(F.lit("    if x: pass\n"), (F.col("s_suppkey") % 5).cast("int")), F.lit("    return x\n"))
    path = F.concat(F.lit("m/s"), F.col("s_suppkey").cast("string"), F.lit(".py"))
    listing.written_files(s.select(path.alias("path"), text.alias("text")), root)
    listing.written_files(spark.createDataFrame([("radon.py", TOOL)], "path string, text string"), root)
    documents = s.select(F.concat(F.lit(f"file://{root}/"), path).alias("uri"), F.lit("python").alias("language_id"))
    settings = Settings(cc=CcSettings(python_path=sys.executable))
    _, by_name = providers.tool_registry(spark, settings, cwd=root).tables(documents)
    return by_name.where("key = '1:f'").select(F.regexp_extract("uri", "s([0-9]+)[.]py$", 1).cast("bigint").alias("s_suppkey"), "cc")


@registered("SELECT 'file:///w/src/n' || n_nationkey || '.ts' AS uri, 1 + n_nationkey % 3 AS commits FROM nation")
def commits_of_repository(spark, d):
    """The commit log of a repository in which each nation's file was changed one to three times, read by the version control program."""
    from riskweave.functions.text import path_uri

    root = tempfile.mkdtemp(prefix="riskweave-repository-")  # the driver's own: git runs there
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", *a], cwd=root, check=True, capture_output=True)
    git("init", "-q")
    keys = [r[0] for r in t(spark, d, "nation").select("n_nationkey").collect()]
    os.makedirs(f"{root}/src")
    for turn in range(3):
        for k in keys:
            if turn <= k % 3:
                with open(f"{root}/src/n{k}.ts", "a") as f:
                    f.write(f"{turn}\n")
        git("add", "-A")
        git("commit", "-q", "-m", f"turn {turn}")
    counts = tools.commit_counts(tools.commit_log(spark, root, "2000-01-01"), path_uri("/w"))
    return counts


# ---------------------------------------------------------------- views


@registered("SELECT doc_id, 'Risk F=' || round(n_chars) || '  R=' || printf('%.2f', doc_id / 4) || '  CRAP=' || (n_chars // 2) || CASE WHEN n_chars % 2 = 1 THEN '.5' ELSE '.0' END AS title FROM documents".replace("round(n_chars)", "CAST(n_chars AS BIGINT)"))
def lens_titles(spark, d):
    m = t(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("f"), (F.col("doc_id") / 4).alias("r"), (F.col("n_chars") / 2).alias("crap"))
    return m.select("doc_id", M.lens_title().alias("title"))


_NAMES = {name: text.replace("'", "''") for name, text in M.INSIGHTS.items()}


@registered(f"""WITH m AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS f, doc_id / 4 AS r, n_chars / 2 AS crap, doc_id % 13 AS cc, doc_id % 2 AS t, 1 + doc_id % 3 AS g, n_chars FROM documents)
SELECT doc_id, '**Risk**  F=' || n_chars || '.0  (R×CRAP)' || chr(10) || chr(10) || '- R (rank): ' || printf('%.3f', r) || chr(10) || '- CRAP: ' || (n_chars // 2) || CASE WHEN n_chars % 2 = 1 THEN '.50' ELSE '.00' END
  || chr(10) || '- CC: ' || cc || chr(10) || '- T (coverage): ' || (t * 100) || '%' || chr(10) || chr(10) || concat_ws('  ' || chr(10),
  CASE WHEN cc >= 10 AND t < 0.5 THEN '{_NAMES["untested"]}' WHEN cc >= 10 AND t >= 0.8 THEN '{_NAMES["tested"]}' END,
  CASE WHEN r >= 3 AND crap >= 30 THEN '{_NAMES["cascade"]}' WHEN r >= 5 THEN '{_NAMES["popular"]}' END,
  CASE WHEN f >= 100 AND g > 2 THEN '{_NAMES["urgent"]}' END) AS hover FROM m""")
def hover_texts(spark, d):
    """The whole text, insights included."""
    m = t(spark, d, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("f"), (F.col("doc_id") / 4).alias("r"), (F.col("n_chars") / 2).alias("crap"), (F.col("doc_id") % 13).cast("double").alias("cc"), (F.col("doc_id") % 2).cast("double").alias("t"), (1 + F.col("doc_id") % 3).cast("double").alias("g"),
    )
    return m.select("doc_id", M.hover_text().alias("hover"))


@registered("""SELECT 'p' || p_partkey || '#' || p_size || ':0' AS id, p_size AS line, 'Risk F=' || (p_partkey % 1000) || '  R=' || printf('%.2f', p_size / 4) || '  CRAP=' || p_size || '.0' AS title FROM part""")
def lenses(spark, d):
    """Functions that have metrics, with their lines and titles; functions of another file have none."""
    b = bodies(spark, d)
    fn = b.select("uri", F.col("body_start").alias("sel_line"), F.lit(0).alias("sel_char"))
    other = fn.withColumn("uri", F.concat("uri", F.lit("x")))
    m = b.select(X.symbol_id(F.col("uri"), F.col("body_start"), F.lit(0)).alias("id"), "ord", (F.col("ord") % 1000).cast("double").alias("f"), (F.col("cc") / 4).alias("r"), F.col("cc").alias("crap"))
    return views.lenses(fn.unionByName(other), m).select("id", "line", "title")


@registered(f"{SYMBOLS} SELECT id, {q4('f')} AS f FROM sym WHERE uri = 'Brand#3'")
def symbols_of_file(spark, d):
    return views.of_file(part_metrics(spark, d), "Brand#3").select("id", r4(F.col("f")).alias("f"))


@registered(f"{SYMBOLS} SELECT id, {q4('f')} AS f FROM sym WHERE id = 'p7'")
def first_selected(spark, d):
    return symbols.first_selected(part_metrics(spark, d), ["none", "p7", "p2"]).select("id", r4(F.col("f")).alias("f"))


@registered(f"""{LAYOUT}, first AS (SELECT id, arg_min(x, (depth, path)) AS x, arg_min(y, (depth, path)) AS y FROM nodes GROUP BY 1)
SELECT tree.id AS "from", tree.parent_id AS "to", count(*) AS n, min(a.x) AS x1, min(a.y) AS y1, min(b.x) AS x2, min(b.y) AS y2
FROM tree JOIN first a ON a.id = tree.id JOIN first b ON b.id = tree.parent_id GROUP BY 1, 2""")
def edges_placed(spark, d):
    tree = purchase_tree(spark, d)
    x = callers.edges_between(callers.layout_nodes(tree, event_metrics(spark, d)), callers.layout_edges(tree))
    return x.groupBy("from", "to").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


_MOVED = "SELECT p_partkey % 7 AS g, max(abs(p_retailprice * 1e-9 * (p_partkey % 7))) AS most FROM part GROUP BY 1"


@registered(f"SELECT CAST(g AS INT) AS g, most < 1e-6 AS settled, true AS same FROM ({_MOVED})")
def converged(spark, d):
    """Ranks moved by a share of themselves, group by group: those whose largest move is small have settled."""
    r = t(spark, d, "part").select((F.col("p_partkey") % 7).cast("int").alias("g"), F.col("p_partkey").cast("string").alias("id"), F.col("p_retailprice").alias("r"))
    rows = []
    for g in range(7):
        before = r.where(F.col("g") == g).select("id", "r")
        rows.append((g, graph.has_converged(before, before.withColumn("r", F.col("r") + F.col("r") * 1e-9 * g)), graph.has_converged(before, before)))
    return spark.createDataFrame(rows, "g int, settled boolean, same boolean")


def supplier_analysis(spark: SparkSession, d: str) -> Analysis:
    """Suppliers call their nations; names and risks are plain numbers."""
    s, n = t(spark, d, "supplier"), t(spark, d, "nation")
    rows = s.select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("file:///w/s.ts#"), F.col("s_suppkey").cast("string"), F.lit(":0")).alias("id"), F.lit("file:///w/s.ts").alias("uri"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_suppkey").cast("double").alias("f"))
    rows = rows.unionByName(n.select((F.col("n_nationkey") + (1 << 40)).alias("ord"), F.concat(F.lit("file:///w/n.ts#"), F.col("n_nationkey").cast("string"), F.lit(":0")).alias("id"), F.lit("file:///w/n.ts").alias("uri"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 30).cast("double").alias("f")))
    m = rows.select("*", *[F.lit(1.0).alias(c) for c in ("cc", "t", "r", "crap", "g")], F.col("f").alias("f_prime"))
    edges = s.select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("file:///w/s.ts#"), F.col("s_suppkey").cast("string"), F.lit(":0")).alias("caller"), F.concat(F.lit("file:///w/n.ts#"), F.col("s_nationkey").cast("string"), F.lit(":0")).alias("callee"))
    return Analysis(m, symbols.file_rollup(m), edges)


_FIRST = "(SELECT min(s_nationkey) FROM supplier)"


@registered(f"""WITH c AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) AS i, count(*) OVER () AS n FROM supplier WHERE s_nationkey = {_FIRST}),
h AS (SELECT n_name, n_nationkey * 30 AS f FROM nation WHERE n_nationkey = {_FIRST})
SELECT CAST(i + 4 AS BIGINT) AS line, CASE WHEN i = n THEN '└─ ' ELSE '├─ ' END || 's' || k || ' [F=' || k || '.0]' AS text FROM c
UNION ALL SELECT 1, 'IMPACT TREE: ' || n_name FROM h UNION ALL SELECT 2, 'File: n.ts' FROM h
UNION ALL SELECT 3, 'Risk: ' || CASE WHEN f > 500 THEN 'CRITICAL' WHEN f > 200 THEN 'HIGH' WHEN f > 50 THEN 'MEDIUM' ELSE 'LOW' END || ' (F=' || f || '.0)' FROM h
UNION ALL SELECT 4, '' FROM h UNION ALL SELECT DISTINCT n + 5, '' FROM c UNION ALL SELECT DISTINCT n + 6, 'IMPACT SUMMARY:' FROM c
UNION ALL SELECT DISTINCT n + 7, '  Direct callers: ' || n FROM c UNION ALL SELECT DISTINCT n + 8, '  Total affected: ' || n FROM c""")
def callers_text(spark, d):
    key = t(spark, d, "supplier").agg(F.min("s_nationkey")).first()[0]
    name = t(spark, d, "nation").where(F.col("n_nationkey") == key).first()["n_name"]
    text = views.callers_text(views.callers_result(supplier_analysis(spark, d), "n.ts", name))
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line long, text string")


@registered(f"SELECT 's' || s_suppkey AS name, CAST(s_suppkey AS DOUBLE) AS f, (SELECT count(*) FROM supplier WHERE s_nationkey = {_FIRST}) AS direct FROM supplier WHERE s_nationkey = {_FIRST}")
def callers_json(spark, d):
    key = t(spark, d, "supplier").agg(F.min("s_nationkey")).first()[0]
    name = t(spark, d, "nation").where(F.col("n_nationkey") == key).first()["n_name"]
    x = json.loads(views.callers_json(views.callers_result(supplier_analysis(spark, d), "n.ts", name)))
    return spark.createDataFrame([(n["name"], float(n["metrics"]["f"]), x["impactSummary"]["directCallers"]) for n in x["callerTree"]], "name string, f double, direct long")


@registered("SELECT * FROM (SELECT n_name AS name, CAST(n_nationkey * 30 AS DOUBLE) AS f, n_nationkey + 1099511627776 AS o FROM nation UNION ALL SELECT 's' || s_suppkey, CAST(s_suppkey AS DOUBLE), s_suppkey FROM supplier) ORDER BY f DESC, o LIMIT 5".replace("SELECT * FROM (SELECT", "SELECT name, f FROM (SELECT"))
def assistant_tools(spark, d):
    """The answer of a tool function, and an error as an answer."""
    tool = Tools(spark, analysis=lambda: supplier_analysis(spark, d))
    assert tool.caller_tree("n.ts", "no such symbol")["is_error"]
    return spark.createDataFrame([(r["name"], float(r["f"])) for r in json.loads(tool.workspace_hotspots(5)["text"])], "name string, f double")


# ---------------------------------------------------------------- folders


#: Files of a made project for each nation <n>: most source files, some that discovery passes over, reports.
PROJECT = ["src/n<n>.ts", "src/n<n>.test.ts", "src/_n<n>.tsx", "src/_lib/l<n>.ts", "src/__tests__/t<n>.ts", "pkg<n>/__init__.py", "gen/g<n>.py", ".hid/h<n>.ts", "node_modules/x/i<n>.js", "dist/o<n>.js", "docs/d<n>.md"]


def project_folder(spark: SparkSession, d: str) -> str:
    """A folder with files for each of the nations, written by the executors below the session's shared folder."""
    root = "/" + f"{lineage.shared_folder(spark)}/project-{uuid.uuid4().hex}".removeprefix("file:").lstrip("/")
    n = t(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("n"), F.when(F.col("n_nationkey") % 2 == 1, "_p").otherwise("p").alias("folder"))
    script = F.concat(F.lit("export function f"), "n", F.lit("(a) {\n  return a;\n}\n"))
    sources = [F.struct(F.replace(F.lit(p), F.lit("<n>"), F.col("n")).alias("path"), (script if p.endswith(("ts", "tsx")) else F.lit("x = 1\n")).alias("text")) for p in PROJECT]
    lcov = F.concat(F.lit("SF:src/n"), "n", F.lit(".ts\nDA:1,1\nDA:2,"), (F.col("n_nationkey") % 2).cast("string"), F.lit("\nend_of_record\n"))
    line = lambda k, hits: F.concat(F.lit(f'<line nr="{k}" mi="1" ci="'), hits.cast("string"), F.lit('" mb="0" cb="0"/>'))
    jacoco = F.concat(F.lit('<report><package name="com/acme"><sourcefile name="F'), "n", F.lit('.java">'), line(1, F.lit(2)), line(2, F.col("n_nationkey") % 2), F.lit("</sourcefile></package></report>"))
    java = F.concat(F.lit("class F"), "n", F.lit(" {\n  void run() {\n  }\n}\n"))
    reports = [
        F.struct(F.concat("folder", "n", F.lit("/coverage/lcov.info")).alias("path"), lcov.alias("text")),
        F.struct(F.concat("folder", "n", F.lit("/target/jacoco.xml")).alias("path"), jacoco.alias("text")),
        F.struct(F.concat("folder", "n", F.lit("/target/com/acme/F"), "n", F.lit(".java")).alias("path"), java.alias("text")),
    ]
    listing.written_files(n.select(F.inline(F.array(*sources, *reports))), root)
    listing.written_files(spark.createDataFrame([(".gitignore", "gen/\n")], "path string, text string"), root)
    return root


def _files_sql(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{x.replace('<n>', chr(39) + ' || n_nationkey || ' + chr(39))}' AS p FROM nation" for x in names)


_FOLDER = "CASE WHEN n_nationkey % 2 = 1 THEN '_p' ELSE 'p' END || n_nationkey"
TREE_FILES = _files_sql(*PROJECT[:7]) + f" UNION ALL SELECT {_FOLDER} || '/target/com/acme/F' || n_nationkey || '.java' FROM nation"
EDITOR_FILES = f"{TREE_FILES} UNION ALL {_files_sql('.hid/h<n>.ts', 'dist/o<n>.js')}"
_NO_TEST = "p NOT LIKE '%.test.ts' AND p NOT LIKE '%/\\_\\_tests\\_\\_/%' ESCAPE '\\'"


@registered(f"""SELECT p AS path, CASE WHEN p LIKE '%.py' THEN 'python' WHEN p LIKE '%.java' THEN 'java' WHEN p LIKE '%.tsx' THEN 'typescriptreact' ELSE 'typescript' END AS language
FROM (SELECT p, row_number() OVER (ORDER BY p) AS i FROM ({TREE_FILES})) WHERE i <= 150 AND {_NO_TEST}""")
def discovered_files(spark, d):
    """The first 150 by path, of which tests are then left out; names with a leading underscore count, those with a dot don't."""
    root = project_folder(spark, d)
    return files.discover(spark, root, 150).select(X.relative_path(F.col("uri"), root).alias("path"), F.col("language_id").alias("language"))


@registered(f"SELECT p AS path FROM (SELECT p, row_number() OVER (ORDER BY p) AS i FROM ({EDITOR_FILES})) WHERE i <= 200 AND {_NO_TEST} AND p NOT LIKE 'gen/%' ORDER BY p LIMIT 100")
def discovered_in_editor(spark, d):
    """Twice as many by path, filtered by tests and the ignore file, then the first 100; names with a leading dot count too."""
    root = project_folder(spark, d)
    return files.discover(spark, root, 100, respect_gitignore=True, editor=True).select(X.relative_path(F.col("uri"), root).alias("path"))


_LCOV = f"""SELECT 'src/n' || n_nationkey || '.ts' AS path, start_line, CAST(n_nationkey % 2 = 1 OR start_line = 0 AS BOOLEAN) AS executed FROM
  (SELECT n_nationkey, row_number() OVER (ORDER BY {_FOLDER} || '/') AS i FROM nation) CROSS JOIN (VALUES (0), (1)) v(start_line) WHERE i <= 15"""


@registered(_LCOV)
def discovered_reports(spark, d):
    """The statements of the first 15 of the folder's LCOV reports, some of them in folders with a leading underscore."""
    root = project_folder(spark, d)
    return RiskEngine(spark).reports(root, limit=15).select(X.relative_path(F.col("uri"), root).alias("path"), "start_line", "executed")


@registered(f"SELECT root, path, start_line, executed FROM ({_LCOV}) CROSS JOIN (VALUES (0), (1)) v(root)")
def reports_of_roots(spark, d):
    """Several workspace folders: 15 reports of each, whose relative paths are below their own folder."""
    roots = [project_folder(spark, d), project_folder(spark, d)]
    found = RiskEngine(spark).reports(roots, limit=15)
    first = F.col("uri").startswith(f"file://{roots[0]}/")
    path = F.when(first, X.relative_path(F.col("uri"), roots[0])).otherwise(X.relative_path(F.col("uri"), roots[1]))
    return found.select(F.when(first, 0).otherwise(1).alias("root"), path.alias("path"), "start_line", "executed")


@registered(f"""SELECT 'src/n' || n_nationkey || '.ts' AS path, start_line, CAST(n_nationkey % 2 = 1 OR start_line = 0 AS BOOLEAN) AS executed FROM nation CROSS JOIN (VALUES (0), (1)) v(start_line)
UNION ALL SELECT {_FOLDER} || '/target/com/acme/F' || n_nationkey || '.java', start_line, CAST(n_nationkey % 2 = 1 OR start_line = 0 AS BOOLEAN) FROM nation CROSS JOIN (VALUES (0), (1)) v(start_line)""")
def jacoco_discovered(spark, d):
    """LCOV and JaCoCo reports of a folder, the latter at the Java files whose paths end in their keys."""
    root = project_folder(spark, d)
    return RiskEngine(spark).reports(root, jacoco=True).select(X.relative_path(F.col("uri"), root).alias("path"), "start_line", "executed")


_REPORTED = _files_sql("src/n<n>.ts", "src/_n<n>.tsx", "src/_lib/l<n>.ts")


@registered(f"""WITH f AS (SELECT p AS path, 'f' || regexp_extract(p, '([0-9]+)[.][a-z]+$', 1) AS name FROM ({_REPORTED})
  UNION ALL SELECT {_FOLDER} || '/target/com/acme/F' || n_nationkey || '.java', 'run' FROM nation)
SELECT path, name, CAST(1 AS DOUBLE) AS cc, (SELECT count(*) FROM f) AS files FROM f""")
def cli_report(spark, d):
    """The command line's JSON report, written to a file of its own: files by descending rollup, the time as ISO text."""
    root = project_folder(spark, d)
    target, errors = f"{root}/report.json", io.StringIO()
    assert cli.main(["--root", root, "--output", target, "--respect-gitignore"], spark, io.StringIO(), errors) == 0, errors.getvalue()
    with open(target, encoding="utf-8") as f:
        report = json.load(f)
    scores = [x["rollupScore"] for x in report["files"]]
    assert scores == sorted(scores, reverse=True) and report["timestamp"].endswith("Z")
    return spark.createDataFrame([(x["path"], s["name"], float(s["cc"]), report["summary"]["filesAnalyzed"]) for x in report["files"] for s in x["symbols"]], "path string, name string, cc double, files long")


_NEXT = "(SELECT min(n_nationkey) + 1 FROM nation)"


@registered(f"""SELECT * FROM (VALUES (1, 'IMPACT TREE: f'), (2, 'File: c/c' || {_NEXT} || '/l0.ts'), (3, 'Risk: LOW (F=4.0)'), (4, ''), (5, '└─ run [F=2.0]'), (6, ''), (7, 'IMPACT SUMMARY:'), (8, '  Direct callers: 1'), (9, '  Total affected: 1')) v(line, text)""")
def cli_callers(spark, d):
    """The command line's caller tree as text: a function that another folder's module reaches through five modules."""
    root = "/" + f"{lineage.shared_folder(spark)}/chains-{uuid.uuid4().hex}".removeprefix("file:").lstrip("/")
    files_ = supplier_modules(spark, d, CHAIN, "c/c<k>/<name>.ts", "nation", "n_nationkey")
    listing.written_files(files_.select(F.col("uri").alias("path"), F.array_join("lines", "\n").alias("text")), root)
    k = t(spark, d, "nation").agg(F.min("n_nationkey")).first()[0] + 1
    out, errors = io.StringIO(), io.StringIO()
    assert cli.main(["callers", "--root", root, "--file", f"c/c{k}/l0.ts", "--symbol", "f", "--format", "text"], spark, out, errors) == 0, errors.getvalue()
    return spark.createDataFrame(list(enumerate(out.getvalue().rstrip("\n").split("\n"), 1)), "line int, text string")
