"""What is asked of an analysis: lists, lookups, reports and caller trees."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import metrics as M
from riskweave.functions.text import path_matches, relative_path
from riskweave.operators import callers, resolution, symbols
from riskweave.plans.engine import Analysis


def hotspots(metrics: DataFrame, top: int = 10) -> DataFrame:
    """The symbols of highest failure risk; equal ones in input order."""
    if top < 0:
        raise ValueError("top must not be negative")
    return metrics.orderBy(F.col("f").desc(), "ord").limit(top)


def analyzed_file(metrics: DataFrame, path: str) -> DataFrame:
    return metrics.where(path_matches(F.col("uri"), F.lit(path))).orderBy(F.col("f").desc(), "ord")


def high_risk(metrics: DataFrame, path: str | None = None, least: float = 0.0) -> DataFrame:
    found = metrics if path is None else metrics.where(path_matches(F.col("uri"), F.lit(path)))
    return found.where(F.col("f") >= least).orderBy(F.col("f").desc(), "ord")


def of_file(metrics: DataFrame, uri: str) -> DataFrame:
    return metrics.where(F.col("uri") == uri)


def files_by(metrics: DataFrame, field: str) -> DataFrame:
    """uri, largest (never below 0, for labels): files by their largest value of a field."""
    return metrics.groupBy("uri").agg(F.max(field).alias("_m"), F.min("ord").alias("_o")).orderBy(F.col("_m").desc(), "_o").select("uri", F.greatest("_m", F.lit(0.0)).alias("largest"))


def lenses(functions: DataFrame, metrics: DataFrame, prefix: str = "Risk") -> DataFrame:
    """id, line, title for the functions that have metrics."""
    from riskweave.functions.text import symbol_id

    known = functions.select(symbol_id(F.col("uri"), F.col("sel_line"), F.col("sel_char")).alias("id"), F.col("sel_line").alias("line")).join(symbols.last_by_id(metrics), "id")
    return known.select("id", "line", M.lens_title(prefix).alias("title"))


def decorations(documents: DataFrame, rollup: DataFrame, warn: float = 50.0, error: float = 150.0) -> DataFrame:
    """uri, tier of each document by its file's rollup; none where there is no rollup."""
    return documents.select("uri").join(rollup, "uri", "left").select("uri", F.coalesce(M.decoration_tier(F.col("rollup"), warn, error), F.lit("none")).alias("tier"))


def report_rows(analysis_symbols: DataFrame, rollup: DataFrame, root: str) -> DataFrame:
    """A row a file: uri, path, rollup_score, symbols in input order with rounded metrics; place orders the files."""
    r = lambda c: M.round_half_up(F.col(c), 4).alias(c)
    one = F.struct("ord", "name", "cc", r("t"), r("crap"), r("r"), r("f"), r("g"), M.round_half_up(F.col("f_prime"), 4).alias("fPrime"))
    grouped = analysis_symbols.groupBy("uri").agg(F.array_sort(F.collect_list(one)).alias("s"), F.min("ord").alias("first"))
    found = grouped.join(rollup, "uri", "left").withColumn("rollup_score", F.coalesce("rollup", F.lit(0.0)))
    return found.select("uri", relative_path(F.col("uri"), root).alias("path"), "rollup_score", F.transform("s", lambda x: x.dropFields("ord")).alias("symbols"), "first")


def report_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.countDistinct("uri").alias("files_analyzed"), F.count("*").alias("symbols_analyzed"), M.round_half_up(F.coalesce(F.avg("cc"), F.lit(0.0)), 2).alias("average_cc"))


def _plain(x):
    """Whole numbers without a fraction, as JSON writers of one number type print them."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return int(x) if isinstance(x, float) and x.is_integer() else x


def json_report(analysis: Analysis, root: str, now: datetime.datetime | None = None) -> str:
    """The report of a project as JSON text.  It is made on the driver: a report is one document."""
    now = now or datetime.datetime.now(datetime.timezone.utc)
    summary = report_summary(analysis.symbols).first()
    rows = report_rows(analysis.symbols, analysis.file_rollup, root).orderBy(F.col("rollup_score").desc(), "first")
    files = [{"uri": r["uri"], "path": r["path"], "rollupScore": r["rollup_score"], "symbols": [s.asDict() for s in r["symbols"]]} for r in rows.toLocalIterator()]
    out = {
        "timestamp": now.astimezone(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z",
        "summary": {"filesAnalyzed": summary["files_analyzed"], "symbolsAnalyzed": summary["symbols_analyzed"], "averageCC": summary["average_cc"]},
        "files": files,
    }
    return json.dumps(_plain(out), indent=2, ensure_ascii=False)


class SymbolNotFound(LookupError):
    pass


def callers_result(analysis: Analysis, path: str, name: str, depth: int = 5) -> dict:
    """The caller tree of a symbol with its metrics, risk and impact; raises SymbolNotFound."""
    found = resolution.first_matching(analysis.symbols, path, name).withColumn("risk", M.risk_level(F.col("f"))).collect()
    if not found:
        raise SymbolNotFound(f"symbol '{name}' not found in '{path}'")
    symbol = found[0]
    spark = analysis.symbols.sparkSession
    tree = callers.caller_tree(spark.createDataFrame([(symbol["id"],)], "root string"), analysis.edges, depth).persist()
    impact = callers.impact_summary(tree).first()
    named = tree.join(symbols.last_by_id(analysis.symbols).select("id", "name", "f", "cc", "t", "r", "crap"), "id", "left").orderBy("path").collect()
    tree.unpersist()
    nodes: dict[tuple, dict] = {(): {"children": []}}
    for r in named:
        metrics = None if r["f"] is None else {k: r[k] for k in ("f", "cc", "t", "r", "crap")}
        node = {"id": r["id"], "name": r["name"] or r["id"], "depth": r["depth"], "recursive": r["recursive"], "metrics": metrics, "children": []}
        nodes[tuple(r["path"])] = node
        nodes[tuple(r["path"][:-1])]["children"].append(node)
    return {
        "symbol": symbol["name"],
        "file": path,
        "riskLevel": symbol["risk"],
        "metrics": {k: symbol[k] for k in ("f", "cc", "t", "r", "crap")},
        "impactSummary": {"directCallers": impact["direct_callers"] if impact else 0, "totalAffected": impact["total_affected"] if impact else 0},
        "callerTree": nodes[()]["children"],
    }


def callers_json(result: dict) -> str:
    return json.dumps(_plain(result), indent=2, ensure_ascii=False)


def callers_text(result: dict) -> str:
    """The tree drawn with lines, as text."""
    out = [f"IMPACT TREE: {result['symbol']}", f"File: {result['file']}", f"Risk: {result['riskLevel']} (F={M.fixed(result['metrics']['f'], 1)})", ""]

    def draw(nodes: list[dict], lead: str) -> None:
        for i, node in enumerate(nodes, 1):
            last = i == len(nodes)
            f = "F=?" if node["metrics"] is None else f"F={M.fixed(node['metrics']['f'], 1)}"
            out.append(f"{lead}{'└─ ' if last else '├─ '}{node['name']} [{f}]{' 🔄 RECURSIVE' if node['recursive'] else ''}")
            draw(node["children"], lead + ("   " if last else "│  "))

    if not result["callerTree"]:
        out.append("No callers (entry point)")
    else:
        draw(result["callerTree"], "")
        out += ["", "IMPACT SUMMARY:", f"  Direct callers: {result['impactSummary']['directCallers']}", f"  Total affected: {result['impactSummary']['totalAffected']}"]
    return "\n".join(out)
