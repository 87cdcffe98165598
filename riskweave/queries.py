"""Registered queries of the code-risk operators over the driver's tables, each with its DuckDB oracle.

The tables stand for code: orders, lines and suppliers make a supply graph whose nodes are symbols, parts are symbols with brands as
files, line items are statements, events are commits, transitions between event types are a call graph with cycles.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions import metrics as M
from riskweave.functions import text as X
from riskweave.operators import callers, graph, resolution, symbols
from riskweave.plans import providers, views
from riskweave.sources import coverage, files, tools

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(oracle: str):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r4(column) -> F.col:
    return M.round_half_up(column, 4)


def q4(expression: str) -> str:
    return f"(floor(({expression}) * CAST(10000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10000 AS DOUBLE))"


# ---------------------------------------------------------------- the supply graph and its rank


def supply_parts(spark: SparkSession, d: str) -> list[DataFrame]:
    o, i, s, n = (t(spark, d, x) for x in ("orders", "lineitem", "supplier", "nation"))
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    bought = o.select("o_orderkey", "o_custkey").join(i.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return [
        bought.select(node("c", "o_custkey").alias("caller"), node("p", "l_partkey").alias("callee")),
        i.select(node("p", "l_partkey").alias("caller"), node("s", "l_suppkey").alias("callee")),
        s.select(node("s", "s_suppkey").alias("caller"), node("n", "s_nationkey").alias("callee")),
        n.select(node("n", "n_nationkey").alias("caller"), node("r", "n_regionkey").alias("callee")),
    ]


def supply_purchases(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the supply graph with repetitions, which a rank leaves out itself."""
    first, *rest = supply_parts(spark, d)
    for more in rest:
        first = first.unionByName(more)
    return first


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    return supply_purchases(spark, d).distinct()


SUPPLY = """
  SELECT DISTINCT caller, callee FROM (
    SELECT 'c' || o_custkey AS caller, 'p' || l_partkey AS callee FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def rank_ctes(edges: str, steps: int) -> str:
    """CTEs e, w and r0 .. r<steps> for so many rank steps."""
    out = [
        f"e AS ({edges})",
        "w AS (SELECT e.caller, e.callee, CAST(1 AS DOUBLE) / d.n AS share FROM e JOIN (SELECT caller, count(*) AS n FROM e GROUP BY 1) d USING (caller))",
        "r0 AS (SELECT id, CAST(1 AS DOUBLE) AS r FROM (SELECT caller AS id FROM e UNION SELECT callee FROM e))",
    ]
    for k in range(1, steps + 1):
        out.append(
            f"r{k} AS (SELECT r0.id, 1 + coalesce(g.s, 0) AS r FROM r0 LEFT JOIN (SELECT w.callee AS id, sum(p.r * w.share) AS s FROM w JOIN r{k - 1} p ON p.id = w.caller GROUP BY 1) g ON g.id = r0.id)"
        )
    return ",\n".join(out)


@registered(f"WITH {rank_ctes(SUPPLY, 6)} SELECT id, {q4('r')} AS r FROM r6")
def rank_dag(spark, d):
    return graph.rank(supply_purchases(spark, d)).select("id", r4(F.col("r")).alias("r"))


@registered(f"WITH e AS ({SUPPLY}) SELECT caller, count(DISTINCT callee) AS degree FROM e GROUP BY 1")
def out_degrees(spark, d):
    return graph.out_degrees(supply_edges(spark, d))


@registered(f"WITH e AS ({SUPPLY}) SELECT caller AS id FROM e UNION SELECT callee FROM e")
def node_ids(spark, d):
    return graph.node_ids(supply_edges(spark, d))


@registered("""SELECT 'c' || o_custkey AS caller, 'p' || l_partkey AS callee FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation""")
def edge_union(spark, d):
    parts = [p.withColumn("ord", F.lit(0)) for p in supply_parts(spark, d)]
    return resolution.united(*parts).select("caller", "callee")


TRANSITIONS = """
  SELECT prev AS caller, event_type AS callee, min(event_id) AS ord FROM (
    SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
  WHERE prev IS NOT NULL AND prev <> event_type GROUP BY 1, 2"""


def steps_of_users(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t(spark, d, "events").select(F.col("event_id").alias("ord"), before.alias("caller"), F.col("event_type").alias("callee")).where("caller is not null")


def transitions(spark: SparkSession, d: str) -> DataFrame:
    return graph.distinct_edges(graph.without_self_edges(steps_of_users(spark, d)))


@registered(TRANSITIONS)
def self_edge_filter(spark, d):
    return transitions(spark, d).select("caller", "callee", "ord")


@registered(f"WITH {rank_ctes(f'SELECT caller, callee FROM ({TRANSITIONS})', 10)} SELECT id, {q4('r')} AS r FROM r10")
def rank_cyclic_10(spark, d):
    return graph.rank(transitions(spark, d), 10).select("id", r4(F.col("r")).alias("r"))


@registered("SELECT p_brand AS caller, 'p' || p_partkey AS callee FROM part")
def edges_from_callees(spark, d):
    """Callees of each brand in hundreds; the brand itself among them is no edge."""
    p = t(spark, d, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 100).alias("ord"))
    ids = F.collect_list(F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    rows = p.agg(ids.alias("ids")).select("ord", F.col("p_brand").alias("caller"), F.array_append("ids", F.col("p_brand")).alias("callees"))
    return graph.edges_from_callees(rows).select("caller", "callee")


# ---------------------------------------------------------------- symbols: parts, with brands as files

FALLBACK = 0.25
COVER = f"""
  SELECT 'p' || p_partkey AS id, p_partkey AS ord, p_brand AS uri, p_name AS name, CAST(p_size AS DOUBLE) AS cc,
    coalesce(s.covered, 0) AS covered, coalesce(s.total, 0) AS total,
    CASE WHEN coalesce(s.total, 0) > 0 THEN CAST(s.covered AS DOUBLE) / s.total ELSE CAST({FALLBACK} AS DOUBLE) END AS t
  FROM part LEFT JOIN (
    SELECT l_partkey, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'O') AS covered FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE CAST(l_quantity AS INT) BETWEEN p_size AND p_size + 20 GROUP BY 1) s ON s.l_partkey = p_partkey"""
SYMBOLS = f"""WITH {rank_ctes(SUPPLY, 6)}, cover AS ({COVER}),
sym0 AS (SELECT cover.*, coalesce(r6.r, 1) AS r, cc * cc * pow(1 - t, 3) + cc AS crap FROM cover LEFT JOIN r6 USING (id)),
sym AS (SELECT sym0.*, r * crap AS f, CAST(1 AS DOUBLE) AS g, r * crap AS f_prime FROM sym0)"""
LAST = "(SELECT max(ts) - INTERVAL 7 DAY FROM events)"
CHURN = f"SELECT CASE WHEN user_id % 25 < 20 THEN 'Brand#' ELSE 'Elsewhere#' END || (user_id % 25 + 1) AS uri, count(*) AS commits FROM events WHERE ts >= {LAST} GROUP BY 1"
CHURNED = f"""{SYMBOLS}, churn AS ({CHURN}),
churned AS (SELECT sym.* EXCLUDE (g, f_prime), coalesce(1 + ln(1 + CAST(commits AS DOUBLE)), g) AS g, f * coalesce(1 + ln(1 + CAST(commits AS DOUBLE)), g) AS f_prime FROM sym LEFT JOIN churn USING (uri))"""


def bodies(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"),
        F.col("p_size").cast("double").alias("cc"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("uri"), F.col("p_size").alias("body_start"), (F.col("p_size") + 20).alias("body_end"),
    )


def statements(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("l_quantity").cast("int")
    return t(spark, d, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("uri"), (F.col("l_linestatus") == "O").alias("executed"), line.alias("start_line"), line.alias("end_line")
    )


def part_symbols(spark: SparkSession, d: str) -> DataFrame:
    b = bodies(spark, d)
    return b.select("ord", "id", F.col("brand").alias("uri"), "name", "cc").join(symbols.coverage(b, statements(spark, d), FALLBACK).select("id", "t"), "id")


def part_metrics(spark: SparkSession, d: str) -> DataFrame:
    return symbols.symbol_metrics(part_symbols(spark, d), graph.rank(supply_purchases(spark, d)))


def churn_counts(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    last = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since"))
    recent = e.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("since"))  # one row: the cutoff
    # five of the files are no part's, and as many brands have no commits
    folder = F.when(F.col("user_id") % 25 < 20, "Brand#").otherwise("Elsewhere#")
    return tools.commit_counts(recent.select(F.concat(folder, (F.col("user_id") % 25 + 1).cast("string")).alias("value")))


def churned_metrics(spark: SparkSession, d: str) -> DataFrame:
    return symbols.apply_churn(part_metrics(spark, d), churn_counts(spark, d))


SHOWN = ("t", "r", "crap", "f", "g", "f_prime")


def shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", "uri", "name", "cc", *[r4(F.col(c)).alias(c) for c in SHOWN], *more)


def shown_sql(source: str, more: str = "") -> str:
    return "SELECT id, uri, name, cc, " + ", ".join(f"{q4(c)} AS {c}" for c in SHOWN) + f"{more} FROM {source}"


@registered(f"SELECT id, covered, total, {q4('t')} AS t FROM ({COVER})")
def coverage_fraction(spark, d):
    return symbols.coverage(bodies(spark, d), statements(spark, d), FALLBACK).withColumn("t", r4(F.col("t")))


@registered(f"{SYMBOLS} {shown_sql('sym')}")
def symbol_metrics(spark, d):
    return shown(part_metrics(spark, d))


@registered(CHURN)
def churn_by_file(spark, d):
    return churn_counts(spark, d)


@registered(f"SELECT uri, {q4('1 + ln(1 + CAST(commits AS DOUBLE))')} AS g FROM ({CHURN})")
def churn_multiplier(spark, d):
    return churn_counts(spark, d).select("uri", r4(M.churn_multiplier(F.col("commits"))).alias("g"))


@registered(f"{CHURNED} {shown_sql('churned')}")
def apply_churn(spark, d):
    return shown(churned_metrics(spark, d))


for _mode in ("max", "sum", "avg"):
    def _rollup(spark, d, mode=_mode):
        return symbols.file_rollup(churned_metrics(spark, d), mode).select("uri", r4(F.col("rollup")).alias("rollup"))

    _rollup.__name__ = f"file_rollup_{_mode}"
    registered(f"{CHURNED} SELECT uri, {q4(f'{_mode}(f_prime)')} AS rollup FROM churned GROUP BY 1")(_rollup)


@registered("SELECT 'p' || p_partkey AS id, CASE WHEN CAST(p_size * 5 AS DOUBLE) >= 150 THEN 'error' WHEN CAST(p_size * 5 AS DOUBLE) >= 50 THEN 'warn' ELSE 'none' END AS tier FROM part")
def decoration_tier(spark, d):
    return bodies(spark, d).select("id", M.decoration_tier(F.col("cc") * 5).alias("tier"))


@registered(f"{SYMBOLS} SELECT id, CASE WHEN f > 500 THEN 'CRITICAL' WHEN f > 200 THEN 'HIGH' WHEN f > 50 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM sym")
def risk_level(spark, d):
    return part_metrics(spark, d).select("id", M.risk_level(F.col("f")).alias("level"))


@registered(f"""{CHURNED} SELECT id, concat_ws(',',
  CASE WHEN cc >= 10 AND t < 0.5 THEN 'untested' WHEN cc >= 10 AND t >= 0.8 THEN 'tested' END,
  CASE WHEN r >= 3 AND crap >= 30 THEN 'cascade' WHEN r >= 5 THEN 'popular' END,
  CASE WHEN f >= 100 AND g > 2 THEN 'urgent' END) AS insights FROM churned""")
def insight_rules(spark, d):
    names = M.insights(*[F.col(c) for c in ("cc", "t", "r", "crap", "f", "g")])
    return churned_metrics(spark, d).select("id", F.array_join(names, ",").alias("insights"))


for _field in ("f", "f_prime", "g", "cc", "crap"):
    def _sorted(spark, d, field=_field):
        found = churned_metrics(spark, d).withColumn(field, r4(F.col(field)))
        return resolution.ordered_by(found, field).select("id", F.col("place").cast("bigint").alias("place"))

    _sorted.__name__ = f"sort_by_{_field}"
    registered(f"{CHURNED}, x AS (SELECT id, ord, {q4(_field)} AS v FROM churned) SELECT id, row_number() OVER (ORDER BY v DESC, ord) AS place FROM x")(_sorted)


@registered(f"{SYMBOLS} {shown_sql('(SELECT * FROM sym ORDER BY f DESC, ord LIMIT 10)')}")
def hotspots(spark, d):
    return shown(views.hotspots(part_metrics(spark, d), 10))


@registered(f"{SYMBOLS} {shown_sql('sym')} WHERE uri = 'Brand#12' AND f >= 100")
def high_risk(spark, d):
    return shown(views.high_risk(part_metrics(spark, d), "Brand#12", 100.0))


@registered(f"{SYMBOLS} {shown_sql('sym')} WHERE uri = 'Brand#7'")
def analyze_file(spark, d):
    return shown(views.analyzed_file(part_metrics(spark, d), "Brand#7"))


@registered(f"{CHURNED} SELECT uri, greatest(max(cc), 0) AS largest FROM churned GROUP BY 1")
def files_by_field(spark, d):
    return views.files_by(churned_metrics(spark, d), "cc")


@registered("SELECT 'p' || min(p_partkey) AS id, min(p_partkey) AS ord FROM part WHERE p_name = 'red widget' AND p_brand = 'Brand#17'")
def find_symbol(spark, d):
    rows = bodies(spark, d).select("ord", "id", F.concat(F.lit("file:///src/"), F.col("brand")).alias("uri"), "name")
    return resolution.first_matching(rows, "src\\Brand#17", "red widget").select("id", "ord")


@registered(f"""{CHURNED}, x AS (SELECT uri, name, ord, {q4('f')} AS f FROM churned), ru AS (SELECT uri, max(f_prime) AS m FROM churned GROUP BY 1)
SELECT uri, {q4('max(ru.m)')} AS rollup_score, count(*) AS n, string_agg(name || '=' || CAST(CAST(round(f * 10000) AS BIGINT) AS VARCHAR), ';' ORDER BY ord) AS symbols FROM x JOIN ru USING (uri) GROUP BY 1""")
def json_report(spark, d):
    m = churned_metrics(spark, d)
    rows = views.report_rows(m, symbols.file_rollup(m), "/workspace")
    item = lambda s: F.concat(s["name"], F.lit("="), F.round(s["f"] * 10000).cast("bigint").cast("string"))
    return rows.select("uri", r4(F.col("rollup_score")).alias("rollup_score"), F.size("symbols").cast("bigint").alias("n"), F.array_join(F.transform("symbols", item), ";").alias("symbols"))


@registered("SELECT count(DISTINCT p_brand) AS files_analyzed, count(*) AS symbols_analyzed, floor(avg(CAST(p_size AS DOUBLE)) * 100 + 0.5) / CAST(100 AS DOUBLE) AS average_cc FROM part")
def report_summary(spark, d):
    return views.report_summary(bodies(spark, d).withColumn("uri", F.col("brand")))


@registered("""SELECT p_brand AS uri, min(p_partkey) AS first_ord, max(p_partkey) AS last_ord FROM part GROUP BY 1""")
def last_by_id(spark, d):
    b = bodies(spark, d)
    first = b.groupBy(F.col("brand").alias("uri")).agg(F.min("ord").alias("first_ord"))
    last = symbols.last_by_id(b.select(F.col("brand").alias("id"), "ord", "name")).select(F.col("id").alias("uri"), F.col("ord").alias("last_ord"))
    return first.join(last, "uri")


@registered("""WITH l AS (SELECT CAST(s_suppkey AS BIGINT) % 500 AS k, max(CAST(s_nationkey AS DOUBLE)) AS c1 FROM supplier GROUP BY 1),
n AS (SELECT 3 * o_orderkey AS k, CAST(length(o_orderpriority) AS DOUBLE) AS c2 FROM orders)
SELECT 'p' || p_partkey AS id, coalesce(l.c1, n.c2, CAST(1 AS DOUBLE)) AS cc FROM part LEFT JOIN l ON l.k = p_partkey LEFT JOIN n ON n.k = p_partkey""")
def cc_resolve(spark, d):
    fn = bodies(spark, d).select("id", F.lit("u").alias("uri"), "name", F.col("ord").cast("int").alias("sel_line"))
    by_line = t(spark, d, "supplier").select(F.lit("u").alias("uri"), (F.col("s_suppkey") % 500 + 1).cast("int").alias("line1"), F.col("s_nationkey").cast("double").alias("cc"))
    named = t(spark, d, "orders").join(t(spark, d, "part"), 3 * F.col("o_orderkey") == F.col("p_partkey"))
    by_name = named.select(F.lit("u").alias("uri"), F.concat_ws(":", (F.col("p_partkey") + 1).cast("string"), F.col("p_name")).alias("key"), F.length("o_orderpriority").cast("double").alias("cc"))
    return symbols.resolved_cc(fn, by_line, by_name, F.lit("")).select("id", "cc")


@registered("SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, max(CAST(json_extract(props, '$.k') AS DOUBLE)) AS cc FROM events GROUP BY 1, 2")
def cc_json_max(spark, d):
    """Reports of days, with all messages of a user on the line of their number."""
    message = F.struct(F.lit("complexity").alias("ruleId"), F.col("user_id").alias("line"), F.concat(F.lit("complexity of "), F.get_json_object("props", "$.k")).alias("message"))
    days = t(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("uri")).agg(F.collect_list(message).alias("messages"))
    found = tools.eslint_complexity(days.select("uri", F.to_json(F.array(F.struct("messages"))).alias("content")))
    return found.select(F.col("line1").cast("bigint").alias("user_id"), F.col("uri").alias("day"), "cc")


@registered("SELECT CAST(user_id AS VARCHAR) AS uri, CAST(trunc(value) AS INT) AS line1, max(CAST(json_extract(props, '$.k') AS DOUBLE)) AS cc FROM events WHERE event_type <> 'view' GROUP BY 1, 2")
def eslint_complexity(spark, d):
    rule = F.when(F.col("event_type") == "view", "no-undef").when(F.col("event_type") == "click", "complexity").otherwise("@typescript-eslint/complexity")
    message = F.struct(rule.alias("ruleId"), F.col("value").cast("int").alias("line"), F.concat(F.lit("has a Complexity of "), F.get_json_object("props", "$.k")).alias("message"))
    reports = t(spark, d, "events").select(F.col("user_id").cast("string").alias("uri"), F.to_json(F.array(F.struct(F.array(message).alias("messages")))).alias("content"))
    return tools.eslint_complexity(reports)


@registered("SELECT CAST(user_id AS VARCHAR) AS uri, CAST(event_id % 50 AS INT) AS line1, max(CAST(json_extract(props, '$.k') AS DOUBLE)) AS cc FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def pmd_complexity(spark, d):
    rule = F.when(F.col("event_type") == "error", "UnusedImport").otherwise("StdCyclomaticComplexity")
    body = F.concat(F.lit('<violation beginline="'), (F.col("event_id") % 50).cast("string"), F.lit('" rule="'), rule, F.lit('">\nThe method has a cyclomatic complexity of '), F.get_json_object("props", "$.k"), F.lit(".\n</violation>"))
    return tools.pmd_complexity(t(spark, d, "events").select(F.col("user_id").cast("string").alias("uri"), F.concat(F.lit("<pmd>"), body, F.lit("</pmd>")).alias("content")))


@registered("SELECT 'f' || user_id AS uri, (event_id % 9) || ':' || event_type AS key, arg_max(CAST(json_extract(props, '$.k') AS DOUBLE), event_id) AS cc FROM events GROUP BY 1, 2")
def radon_complexity(spark, d):
    block = F.struct(F.col("event_type").alias("name"), (F.col("event_id") % 9).alias("lineno"), F.get_json_object("props", "$.k").cast("double").alias("complexity"))
    per_user = t(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    uri = F.concat(F.lit("f"), F.col("user_id").cast("string"))
    return tools.radon_complexity(per_user.select(uri.alias("uri"), F.to_json(F.create_map(uri, F.col("blocks"))).alias("content")), F.col("uri"))


# ---------------------------------------------------------------- text

_TERNARY = r"\?[^;?:]+:"


@registered(rf"""SELECT doc_id, CAST(greatest(1, 1 + len(regexp_extract_all(text, '\b(?:while|for|foreach|case|catch|if)\b')) + len(regexp_extract_all(text, '&&|\|\|'))
  + len(regexp_extract_all(text, '{_TERNARY}'))) AS DOUBLE) AS cc FROM documents""")
def cc_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", X.estimated_cc(F.col("text")).alias("cc"))


@registered("""WITH x AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM conversations)
SELECT conv_id, turn, first_value(CASE WHEN role = 'user' THEN text ELSE '' END) OVER (PARTITION BY conv_id, grp ORDER BY turn) AS head FROM x""")
def forward_fill(spark, d):
    head = coverage.last_seen(F.when(F.col("role") == "user", F.col("text")), ["conv_id"], "turn")
    return t(spark, d, "conversations").select("conv_id", "turn", F.coalesce(head, F.lit("")).alias("head"))


@registered("SELECT 'src/' || user_id || '.ts' AS file, count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS covered FROM events WHERE event_id % 10 <> 0 GROUP BY 1")
def lcov_parse(spark, d):
    record = F.when(F.col("event_id") % 10 == 0, F.lit("DA:0,1")).otherwise(F.concat(F.lit("DA:"), F.col("event_id").cast("string"), F.when(F.col("event_type") == "click", ",3").otherwise(",0")))
    body = F.array_join(F.array_sort(F.collect_list(record)), "\r\n")
    reports = t(spark, d, "events").groupBy("user_id").agg(body.alias("b")).select(
        F.col("user_id").cast("string").alias("report"), F.concat(F.lit("TN:\nDA:5,1\nSF: src/"), F.col("user_id").cast("string"), F.lit(".ts \n"), "b", F.lit("\nend_of_record\nDA:7,1\n")).alias("content")
    )
    return coverage.lcov_statements(reports).groupBy("file").agg(F.count("*").alias("total"), F.count_if("executed").alias("covered"))


@registered("SELECT 'com/acme/F' || user_id || '.java' AS file, count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS covered FROM events WHERE event_id > 0 GROUP BY 1")
def jacoco_parse(spark, d):
    line = F.concat(F.lit('<line nr="'), F.col("event_id").cast("string"), F.lit('" mi="1" ci="'), F.when(F.col("event_type") == "click", "2").otherwise("0"), F.lit('" mb="0" cb="0"/>'))
    body = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    reports = t(spark, d, "events").groupBy("user_id").agg(body.alias("b")).select(
        F.col("user_id").cast("string").alias("report"),
        F.concat(F.lit('<report><package name="com/acme"><sourcefile name="F'), F.col("user_id").cast("string"), F.lit('.java">'), "b", F.lit("</sourcefile></package></report>")).alias("content"),
    )
    return coverage.jacoco_statements(reports).groupBy("file").agg(F.count("*").alias("total"), F.count_if("executed").alias("covered"))


PATHS = """SELECT page_id, CASE page_id % 10 WHEN 0 THEN '/src/test/' WHEN 1 THEN '/src/contest/' WHEN 2 THEN '/a/__tests__/' WHEN 3 THEN '/test_utils/' ELSE '/src/main/' END || 'F' || page_id ||
  CASE page_id % 7 WHEN 0 THEN '.test.ts' WHEN 1 THEN 'Test.java' WHEN 2 THEN 'IT.java' WHEN 3 THEN '.SPEC.js' WHEN 4 THEN '.py' WHEN 5 THEN '.TSX' ELSE '.md' END AS path FROM pages"""


def paths(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select(
        "page_id",
        F.concat(
            F.expr("CASE page_id % 10 WHEN 0 THEN '/src/test/' WHEN 1 THEN '/src/contest/' WHEN 2 THEN '/a/__tests__/' WHEN 3 THEN '/test_utils/' ELSE '/src/main/' END"), F.lit("F"), F.col("page_id").cast("string"),
            F.expr("CASE page_id % 7 WHEN 0 THEN '.test.ts' WHEN 1 THEN 'Test.java' WHEN 2 THEN 'IT.java' WHEN 3 THEN '.SPEC.js' WHEN 4 THEN '.py' WHEN 5 THEN '.TSX' ELSE '.md' END"),
        ).alias("path"),
    )


@registered(rf"""SELECT page_id, regexp_matches(path, '\.(test|spec)\.[^/\\]+$', 'i') OR regexp_matches(path, '(Test|Tests|IT)\.[^/\\]+$')
  OR regexp_matches(path, '(^|[/\\])(__tests__|tests?|test_[^/\\]+)([/\\]|$)', 'i') AS is_test FROM ({PATHS})""")
def test_file_filter(spark, d):
    return paths(spark, d).select("page_id", X.is_test_file(F.col("path")).alias("is_test"))


@registered(f"""SELECT page_id, CASE lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescriptreact' WHEN 'js' THEN 'javascript'
  WHEN 'py' THEN 'python' WHEN 'java' THEN 'java' ELSE 'unknown' END AS language FROM ({PATHS})""")
def language_detect(spark, d):
    return paths(spark, d).select("page_id", X.language_of(F.col("path")).alias("language"))


@registered(f"SELECT page_id, path = 'main/F' || page_id || '.py' OR ends_with(path, '/main/F' || page_id || '.py') AS matches FROM ({PATHS})")
def path_match(spark, d):
    return paths(spark, d).select("page_id", X.path_matches(F.col("path"), F.concat(F.lit("main\\F"), F.col("page_id").cast("string"), F.lit(".py"))).alias("matches"))


@registered(f"SELECT page_id, CASE WHEN starts_with(path, '/src/') THEN substr(path, 6) ELSE 'file://' || path END AS relative FROM ({PATHS})")
def relative_path(spark, d):
    return paths(spark, d).select("page_id", X.relative_path(F.concat(F.lit("file://"), F.col("path")), "/src").alias("relative"))


@registered(f"SELECT page_id, regexp_extract(path, '[^/]*$') AS file, 'L' || page_id AS label, CAST(page_id AS INT) AS line FROM ({PATHS})")
def names_and_ids(spark, d):
    p = paths(spark, d)
    sid = X.symbol_id(F.col("path"), F.col("page_id"), F.lit(3))
    return p.select("page_id", X.file_name(F.col("path")).alias("file"), X.label_of(F.concat(F.lit("a#b#L"), F.col("page_id").cast("string"))).alias("label"), X.parsed_symbol_id(sid)["line"].alias("line"))


@registered(f"SELECT page_id, starts_with(path, '/src/main/') AS inside FROM ({PATHS})")
def scope_filter(spark, d):
    return paths(spark, d).select("page_id", files.in_scope(F.concat(F.lit("file://"), F.col("path")), "file:///src/main").alias("inside"))


@registered(f"SELECT page_id, starts_with(path, '/src/test/') OR (ends_with(path, '.md') AND NOT ends_with(path, '/F6.md')) AS ignored FROM ({PATHS})")
def gitignore_filter(spark, d):
    uri = F.concat(F.lit("file:///w"), F.col("path"))
    return paths(spark, d).select("page_id", files.is_ignored(uri, "file:///w", "# made\n*.md\n!F6.md\n/src/test/\n").alias("ignored"))


@registered("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.2f', l_extendedprice) AS price FROM lineitem")
def fixed_point(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.to_fixed(F.col("l_extendedprice"), 2).alias("price"))


# ---------------------------------------------------------------- callers of event types

DEPTH = 3
TREE = f"""WITH RECURSIVE e AS ({TRANSITIONS}), tree AS (
  SELECT 'purchase' AS root, caller AS id, 'purchase' AS parent_id, 1 AS depth, caller = 'purchase' AS recursive, ['purchase', caller] AS way, [ord] AS path FROM e WHERE callee = 'purchase'
  UNION ALL SELECT tree.root, e.caller, tree.id, tree.depth + 1, list_contains(tree.way, e.caller), list_append(tree.way, e.caller), list_append(tree.path, e.ord)
  FROM tree JOIN e ON e.callee = tree.id WHERE NOT tree.recursive AND tree.depth < {DEPTH})"""


def purchase_tree(spark: SparkSession, d: str, depth: int = DEPTH) -> DataFrame:
    return callers.caller_tree(spark.createDataFrame([("purchase",)], "root string"), transitions(spark, d), depth)


def event_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Event types as symbols, in two files."""
    e = t(spark, d, "events").groupBy(F.col("event_type").alias("id")).agg(F.count("*").cast("double").alias("f"))
    return e.select("id", F.concat(F.lit("on_"), "id").alias("name"), "f", F.when(F.col("id") < "p", "file:///a/x.ts").otherwise("file:///b/y.ts").alias("uri"))


EVENT_METRICS = "SELECT event_type AS id, 'on_' || event_type AS name, CAST(count(*) AS DOUBLE) AS f, CASE WHEN event_type < 'p' THEN 'x.ts' ELSE 'y.ts' END AS file FROM events GROUP BY 1"


@registered(f"SELECT caller, ord FROM ({TRANSITIONS}) WHERE callee = 'purchase'")
def direct_callers(spark, d):
    return graph.direct_callers(transitions(spark, d), "purchase").select("caller", "ord")


@registered(f"WITH e AS ({TRANSITIONS}) SELECT callee, string_agg(caller, ',' ORDER BY ord) AS callers FROM e GROUP BY 1")
def caller_index(spark, d):
    return graph.callers_of(transitions(spark, d)).select("callee", F.array_join("callers", ",").alias("callers"))


@registered(f"WITH e AS ({TRANSITIONS}) SELECT callee, string_agg(caller, ',' ORDER BY ord) AS callers FROM e GROUP BY 1")
def incoming_lists(spark, d):
    return graph.incoming(graph.without_self_edges(steps_of_users(spark, d))).select("callee", F.array_join("callers", ",").alias("callers"))


@registered("SELECT 'file:///' || l_partkey || '#' || l_linenumber || ':0' AS caller, 'file:///' || l_suppkey || '#0:1' AS callee FROM lineitem WHERE l_quantity > 10")
def hierarchy_edges(spark, d):
    uri = lambda c: F.concat(F.when(F.col("l_quantity") > 10, "file:///").otherwise("git:///"), F.col(c).cast("string"))
    calls = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("ord"), uri("l_partkey").alias("caller_uri"), F.col("l_linenumber").alias("caller_line"), F.lit(0).alias("caller_char"), uri("l_suppkey").alias("callee_uri"), F.lit(0).alias("callee_line"), F.lit(1).alias("callee_char"))
    return graph.hierarchy_edges(calls).select("caller", "callee")


@registered("SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') AS escaped FROM documents")
def html_escape(spark, d):
    return t(spark, d, "documents").select("doc_id", X.html_escaped(F.col("text")).alias("escaped"))


@registered(f"SELECT CAST(user_id AS VARCHAR) AS uri, count(*) AS commits FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def commits_since(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").cast("string").alias("uri"), "ts")
    return providers.commits_since(e, providers.cutoff(10, datetime.datetime(2024, 1, 30)))


@registered("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS ord FROM conversations WHERE role = 'assistant'")
def editor_symbols(spark, d):
    c = t(spark, d, "conversations")
    nested = c.select(F.col("conv_id").cast("string").alias("uri"), "conv_id", "turn", F.array(F.col("turn").cast("int")).alias("path"), F.when(F.col("role") == "assistant", "Method").otherwise("Class").alias("kind"))
    return symbols.flattened_symbols(nested).select("conv_id", "turn", "ord")


@registered(f"{CHURNED}, ru AS (SELECT uri, max(f_prime) AS m FROM churned GROUP BY 1) SELECT n_name AS uri, CASE WHEN m >= 150 THEN 'error' WHEN m >= 50 THEN 'warn' ELSE 'none' END AS tier FROM nation LEFT JOIN ru ON 'Brand#' || n_nationkey = ru.uri".replace("SELECT n_name AS uri", "SELECT 'Brand#' || n_nationkey AS uri"))
def editor_decorations(spark, d):
    docs = t(spark, d, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("uri"))
    return views.decorations(docs, symbols.file_rollup(churned_metrics(spark, d)))


@registered(f"{TREE} SELECT root, array_to_string(path, '.') AS path, id, parent_id, CAST(depth AS INT) AS depth, recursive FROM tree")
def caller_tree(spark, d):
    return purchase_tree(spark, d).select("root", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), "id", "parent_id", "depth", "recursive")


@registered(f"{TREE} SELECT 'purchase' AS id, CAST(0 AS INT) AS depth, count(*) FILTER (WHERE depth = 1) AS below FROM tree")
def rooted_tree(spark, d):
    x = callers.rooted_tree(spark.createDataFrame([("purchase",)], "root string"), transitions(spark, d), DEPTH)
    return x.groupBy("root").agg(F.count_if(F.col("depth") == 1).alias("below"), F.min_by("id", "depth").alias("id"), F.min("depth").alias("depth")).select("id", "depth", "below")


#: The ordered walk as a recursion over the rows in depth-first order, with the ids met and the path being skipped as its state.
WALK = f"""{TREE}, dfs AS (SELECT id, path, row_number() OVER (ORDER BY path) AS rn FROM tree),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS BIGINT[]) AS skip
  UNION ALL SELECT d.rn,
    CASE WHEN coalesce(d.path[1:len(w.skip)] = w.skip, false) OR list_contains(w.seen, d.id) THEN w.seen ELSE list_append(w.seen, d.id) END,
    CASE WHEN coalesce(d.path[1:len(w.skip)] = w.skip, false) THEN w.skip WHEN list_contains(w.seen, d.id) THEN d.path ELSE NULL END
  FROM walk w JOIN dfs d ON d.rn = w.rn + 1),
met AS (SELECT unnest(seen) AS id FROM walk WHERE rn = (SELECT max(rn) FROM walk))"""


@registered(f"""{WALK} SELECT 'purchase' AS root, (SELECT count(*) FROM tree WHERE depth = 1) AS direct_callers, count(*) AS total_affected, {q4('sum(coalesce(f, 0))')} AS combined_f
FROM met LEFT JOIN ({EVENT_METRICS}) USING (id)""")
def impact_summary(spark, d):
    return callers.impact_summary(purchase_tree(spark, d), event_metrics(spark, d)).select("root", "direct_callers", "total_affected", r4(F.col("combined_f")).alias("combined_f"))


@registered(f"{TREE} SELECT array_to_string(path, '.') AS path, id, repeat('$(indent)', depth - 1) || name || '|F=' || CAST(CAST(f AS BIGINT) AS VARCHAR) || '.0 (depth ' || depth || ')' || CASE WHEN recursive THEN ' 🔄 RECURSIVE' ELSE '' END AS item FROM tree JOIN ({EVENT_METRICS}) USING (id)")
def flatten_tree(spark, d):
    x = callers.flattened(purchase_tree(spark, d), event_metrics(spark, d))
    return x.select(F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path"), "id", F.concat_ws("|", "label", "description").alias("item"))


LAYOUT = f"""{TREE}, n0 AS (SELECT CAST([] AS BIGINT[]) AS path, 'purchase' AS id, 0 AS depth UNION ALL SELECT path, id, depth FROM tree),
n1 AS (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY path) - 1 AS i, count(*) OVER (PARTITION BY depth) AS n FROM n0),
n2 AS (SELECT *, max(n) OVER () AS w FROM n1),
nodes AS (SELECT n2.*, m.file, CAST(100 + (w - 1) * 110 - (n - 1) * 110 + 220 * i AS DOUBLE) AS x, CAST(100 + 140 * depth AS DOUBLE) AS y FROM n2 JOIN ({EVENT_METRICS}) m USING (id))"""


@registered(f"{LAYOUT} SELECT array_to_string(path, '.') AS path, id, x, y FROM nodes")
def graph_layout(spark, d):
    return callers.layout_nodes(purchase_tree(spark, d), event_metrics(spark, d)).select(F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path"), "id", "x", "y")


@registered(f"{LAYOUT} SELECT CAST(200 + (max(n) - 1) * 220 AS DOUBLE) AS width, CAST(200 + 140 * max(depth) AS DOUBLE) AS height FROM nodes")
def layout_size(spark, d):
    roots = spark.createDataFrame([("purchase",)], "root string")
    return callers.layout_size(callers.level_sizes(callers.compact_tree(roots, transitions(spark, d), DEPTH))).select("width", "height")


_LEVELS = ", ".join(f"l{k} AS (SELECT l.root, e.caller AS id, sum(l.n) AS n FROM l{k - 1} l JOIN e ON e.callee = l.id GROUP BY 1, 2)" for k in range(1, 5))


@registered(f"""WITH e AS ({SUPPLY}), l0 AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id, CAST(1 AS DECIMAL(38,0)) AS n FROM region), {_LEVELS}
{' UNION ALL '.join(f"SELECT root, CAST({k} AS INT) AS depth, CAST(sum(n) AS BIGINT) AS n, count(*) AS ids FROM l{k} GROUP BY 1" for k in range(1, 5))}""")
def caller_counts(spark, d):
    """The caller trees of all regions over nations, suppliers, parts and customers, counted level by level without a path being made."""
    roots = t(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    found = callers.compact_tree(roots, supply_edges(spark, d), 4)
    return found.groupBy("root", "depth").agg(F.sum("n").cast("bigint").alias("n"), F.count("*").alias("ids"))


@registered(f"{TREE} SELECT id AS \"from\", parent_id AS \"to\", count(*) AS n FROM tree GROUP BY 1, 2")
def layout_edges(spark, d):
    return callers.layout_edges(purchase_tree(spark, d)).groupBy("from", "to").agg(F.count("*").alias("n"))


@registered(f"{LAYOUT} SELECT file, count(*) AS n, min(x) - 30 AS x, min(y) - 30 AS y, max(x) - min(x) + 60 AS width, max(y) - min(y) + 60 AS height FROM nodes GROUP BY 1 HAVING count(*) >= 2")
def file_groups(spark, d):
    found = callers.file_groups(callers.layout_nodes(purchase_tree(spark, d), event_metrics(spark, d)))
    return found.select("file", F.size("node_ids").cast("bigint").alias("n"), "x", "y", "width", "height")


@registered(f"SELECT caller AS id, CAST(2 AS INT) AS depth, caller IN ('purchase', 'click') AS recursive FROM ({TRANSITIONS}) WHERE callee = 'click'")
def lazy_expand(spark, d):
    return callers.expanded(transitions(spark, d), "click", ["purchase"], 1).select("id", "depth", "recursive")


@registered("""WITH f AS (SELECT p_brand AS uri, p_partkey AS ord, p_size AS a, p_size + 20 AS b FROM part),
c AS (SELECT DISTINCT l.p_brand AS uri, l.p_size AS line FROM part l WHERE l.p_partkey % 20 = 0)
SELECT c.uri, c.line, min(f.ord) AS first_ord FROM c JOIN f ON f.uri = c.uri AND c.line BETWEEN f.a AND f.b GROUP BY 1, 2""")
def hover_lookup(spark, d):
    b = bodies(spark, d)
    fn = b.select(F.col("brand").alias("uri"), "ord", F.col("ord").cast("string").alias("name"), F.col("body_start").alias("sel_line"), F.col("ord").cast("int").alias("sel_char"), "body_start", "body_end")
    known = fn.select(X.symbol_id(F.col("uri"), F.col("sel_line"), F.col("sel_char")).alias("id"))
    cursors = t(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_brand").alias("uri"), F.col("p_size").alias("line")).distinct()
    return symbols.at_cursor(fn, known, cursors).select("uri", "line", F.col("name").cast("bigint").alias("first_ord"))


@registered("""WITH decl AS (SELECT p_brand AS class_name, p_name AS name, max(p_partkey) AS k FROM part GROUP BY 1, 2),
calls AS (SELECT s_suppkey, 'Brand#' || (s_suppkey % 25 + 1) AS own, 'Brand#' || (s_nationkey + 1) AS recv, s_suppkey % 3 AS kind FROM supplier),
want AS (SELECT c.*, p.p_name AS name, CASE WHEN kind = 0 THEN own ELSE recv END AS target FROM calls c JOIN part p ON p.p_partkey = c.s_suppkey)
SELECT DISTINCT 's' || s_suppkey || '#0:0' AS caller, target || '#' || k || ':0' AS callee FROM want JOIN decl ON decl.class_name = target AND decl.name = want.name""")
def java_call_resolution(spark, d):
    p, s = t(spark, d, "part"), t(spark, d, "supplier")
    decl = p.select(F.lit(0).cast("bigint").alias("file_ord"), F.col("p_brand").alias("uri"), F.lit("java").alias("language"), F.col("p_brand").alias("class_name"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line"), F.lit(0).alias("character"))
    own, recv, kind = F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")), F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 1).cast("string")), F.col("s_suppkey") % 3
    calls = s.join(p, F.col("s_suppkey") == F.col("p_partkey")).select(
        F.col("s_suppkey").alias("file_ord"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("uri"), F.lit("java").alias("language"), own.alias("class_name"), F.lit(0).alias("line"), F.lit(0).alias("character"),
        F.lit(0).alias("call"), F.when(kind == 1, recv).when(kind == 2, F.lit("field")).alias("receiver"), F.col("p_name").alias("name"),
    )
    fields = s.where("s_suppkey % 3 = 2").select(F.col("s_suppkey").alias("file_ord"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("uri"), F.lit("field").alias("name"), recv.alias("type"))
    return resolution.java_edges(decl, calls, fields).select("caller", "callee")
