"""Reports of complexity tools and of version control, as tables."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.text import message_complexity

#: Rules whose messages state a complexity.
SCRIPT_RULES = ("complexity", "@typescript-eslint/complexity")
CYCLOMATIC_RULE = r'(?i)\brule="[a-z]*cyclomatic[a-z]*"'


def eslint_complexity(reports: DataFrame) -> DataFrame:
    """reports(uri, content as JSON): uri, line1, cc, the largest of a line.  All files of a report count for its uri; broken JSON gives nothing."""
    parsed = reports.select("uri", F.from_json("content", "array<struct<messages:array<struct<ruleId:string,line:double,message:string>>>>").alias("files"))
    messages = parsed.select("uri", F.explode(F.flatten(F.transform("files", lambda f: F.coalesce(f["messages"], F.array())))).alias("m"))
    found = messages.where(F.col("m.ruleId").isin(*SCRIPT_RULES) & F.col("m.line").isNotNull()).select("uri", F.col("m.line").cast("int").alias("line1"), message_complexity(F.col("m.message")).alias("cc"))
    return found.where("cc is not null").groupBy("uri", "line1").agg(F.max("cc").alias("cc"))


def radon_complexity(reports: DataFrame, path: Column) -> DataFrame:
    """reports(uri, content as JSON keyed by path): uri, key (line1:name), cc for the entries of path; the last of equal keys counts."""
    entries = F.from_json("content", "map<string,array<struct<name:string,lineno:double,complexity:double>>>")
    blocks = reports.select("uri", path.alias("_path"), F.posexplode(F.map_entries(entries)).alias("f", "e")).where(F.col("e.key") == F.col("_path"))
    rows = blocks.select("uri", "f", F.posexplode("e.value").alias("b", "x")).where("x.name is not null and x.lineno is not null and x.complexity is not null")
    key = F.concat_ws(":", F.col("x.lineno").cast("bigint").cast("string"), F.col("x.name"))
    return rows.groupBy("uri", key.alias("key")).agg(F.max_by("x.complexity", F.struct("f", "b")).alias("cc"))


def pmd_complexity(reports: DataFrame) -> DataFrame:
    """reports(uri, content as XML): uri, line1, cc, the largest of a line, from violations of cyclomatic rules."""
    v = reports.select("uri", F.explode(F.regexp_extract_all("content", F.lit(r"(?is)<violation\s[^>]*>.*?</violation>"), 0)).alias("v"))
    v = v.select("uri", F.regexp_extract("v", r"(?i)^<violation\s([^>]*)>", 1).alias("attributes"), F.regexp_extract("v", r"(?is)^<violation\s[^>]*>(.*)</violation>$", 1).alias("body"))
    line = F.regexp_extract("attributes", r'(?i)\bbeginline="(\d+)"', 1).try_cast("int")
    found = v.where(F.col("attributes").rlike(CYCLOMATIC_RULE)).select("uri", line.alias("line1"), message_complexity(F.col("body")).alias("cc"))
    return found.where("line1 is not null and cc is not null").groupBy("uri", "line1").agg(F.max("cc").alias("cc"))


def pmd_symbols(reports: DataFrame) -> DataFrame:
    """reports(uri, content as XML): the functions that cyclomatic violations name, the first of equal (name, line)."""
    v = reports.select("uri", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?i)<violation\s([^>]*)>"), 1)).alias("ord", "a")).where(F.col("a").rlike(CYCLOMATIC_RULE))
    number = lambda n: F.regexp_extract("a", rf'(?i)\b{n}="(\d+)"', 1).try_cast("int") - 1
    found = v.select("uri", "ord", F.regexp_extract("a", r'(?i)\bmethod="([^"]+)"', 1).alias("name"), number("beginline").alias("body_start"), number("endline").alias("_end"))
    found = found.where("name <> '' and body_start is not null")
    first = found.groupBy("uri", "name", "body_start").agg(F.min("ord").alias("ord"), F.min_by(F.struct("_end"), "ord").alias("_e"))
    return first.select("uri", "ord", "name", F.col("body_start").alias("sel_line"), F.lit(0).alias("sel_char"), "body_start", F.coalesce("_e._end", "body_start").alias("body_end"))


def python_symbols(reports: DataFrame) -> DataFrame:
    """reports(uri, content as a JSON array): the functions among its entries, in their order; those that lack one of the five fields, or hold it in
    another type, are left out, and broken JSON gives nothing."""
    numbers = ("selectionStartLine", "selectionStartCharacter", "bodyStartLine", "bodyEndLine")
    entries = reports.select("uri", F.posexplode(F.from_json("content", "array<string>")).alias("ord", "e"))
    typed = entries.select("uri", "ord", F.try_parse_json("e").alias("v")).where(F.schema_of_variant(F.try_variant_get("v", "$.name", "variant")) == "STRING")
    number = lambda n: F.schema_of_variant(F.try_variant_get("v", f"$.{n}", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|INT)$")
    for n in numbers:
        typed = typed.where(number(n))
    get = lambda n: F.try_variant_get("v", f"$.{n}", "int")
    return typed.select("uri", "ord", F.try_variant_get("v", "$.name", "string").alias("name"), *[get(n).alias(c) for n, c in zip(numbers, ("sel_line", "sel_char", "body_start", "body_end"))])


def commit_counts(log_lines: DataFrame, root: str | None = None) -> DataFrame:
    """log_lines(value): one path a line, as the version control's log lists the files of its commits: uri, commits.

    Paths are trimmed and blank lines dropped; with a root they are put below it, without escapes.
    """
    path = F.trim("value")
    uri = F.concat_ws("/", F.lit(root), path) if root is not None else path
    return log_lines.where(path != "").groupBy(uri.alias("uri")).agg(F.count("*").alias("commits"))


def run_tool(command: list[str], cwd: str | None = None, timeout: float = 15.0) -> str:
    """What a command prints, whatever its exit code; nothing if it can't be run or takes too long.  Runs on the driver."""
    try:
        return subprocess.run(command, cwd=cwd, capture_output=True, text=True, errors="replace", timeout=timeout).stdout
    except (OSError, subprocess.TimeoutExpired):
        return ""


def commit_log(spark: SparkSession, repository: str, since: str, timeout: float = 15.0) -> DataFrame:
    """The files of all commits since an ISO time, as lines for commit_counts."""
    text = run_tool(["git", "log", "--name-only", "--pretty=format:", f"--since={since}", "--diff-filter=ACDMR"], repository, timeout)
    return spark.createDataFrame([(line,) for line in text.split("\n")], "value string")
