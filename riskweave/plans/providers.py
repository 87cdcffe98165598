"""Where an analysis gets its tables from: functions that can be exchanged, by language or as a whole."""

from __future__ import annotations

import datetime
import html
import json
import logging
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import model
from riskweave.functions.text import SCRIPT_LANGUAGES, decoded_path
from riskweave.sources import tools
from riskweave.sources.extract import dealt
from riskweave.sources.tools import run_tool

#: documents -> (cc by line, cc by name)
CcProvider = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
log = logging.getLogger("riskweave")


@dataclass
class CcRegistry:
    """Complexity providers by language; the last one registered for a language counts, other languages have no tool."""

    spark: SparkSession
    providers: dict[str, CcProvider] = field(default_factory=dict)

    def register(self, language: str, provider: CcProvider) -> None:
        self.providers[language] = provider

    def tables(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All providers' results for the documents of their languages."""
        by_line, by_name = self.spark.createDataFrame([], model.CC_BY_LINE), self.spark.createDataFrame([], model.CC_BY_NAME)
        for language, provider in self.providers.items():
            lines, names = provider(documents.where(F.col("language_id") == language))
            by_line, by_name = by_line.unionByName(lines), by_name.unionByName(names)
        return by_line, by_name


#: How the tools are called, <file> being a path, and how many seconds they have.
ESLINT = (["<file>", "-f", "json", "--no-error-on-unmatched-pattern", "--no-warn-ignored"], 20.0)
RADON = (["-m", "radon", "cc", "-j", "<file>"], 15.0)
PMD = (["check", "-d", "<file>", "-R", "category/java/design.xml", "-f", "xml", "--no-cache"], 30.0)


#: Files that one process of a tool is given.
BATCH_FILES = 50


def tool_reports(documents: DataFrame, program: str, call: tuple[list[str], float], cwd: str | None = None, split: Callable[[str, list[str]], dict[str, str]] | None = None, batch_files: int = BATCH_FILES) -> DataFrame:
    """documents(uri): uri, path, content, what a tool prints for each file.  The tool runs on the executors, over all their cores, which must see the files;
    documents that are no files, and files for which it prints nothing, have no row.

    With split, which deals what is printed for many files out to them, a process gets batch_files files and as much time for each as for one
    alone; a batch that runs out of time or can't be dealt out is asked again file by file, so that one file can't take the others' reports away.
    """
    arguments, timeout = call

    def asked(paths: list[str]) -> str:
        return run_tool([program, *(x for a in arguments for x in (paths if a == "<file>" else [a]))], cwd, timeout * len(paths))

    def reports(paths: list[str]) -> list[str]:
        if split and len(paths) > 1:
            try:
                found = split(asked(paths), paths)
                return [found.get(p, "") for p in paths]
            except ValueError:
                log.warning("%s: a batch of %d files is asked again one by one", program, len(paths))
        return [asked([p]) for p in paths]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), batch_files):
                part = batch.iloc[k : k + batch_files]
                yield part.assign(content=reports(list(part["path"])))

    paths = documents.where(F.col("uri").startswith("file:")).select("uri", decoded_path(F.col("uri")).alias("path"))
    return dealt(paths).mapInPandas(run, "uri string, path string, content string").where("content <> ''")


def _json(text: str):
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError("no JSON") from e


def eslint_split(text: str, paths: list[str]) -> dict[str, str]:
    """A list of results that name their files, as lists of one; in the order of the files where they don't."""
    found = _json(text)
    if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
        raise ValueError("no list of results")
    by = {x["filePath"]: x for x in found if "filePath" in x}
    if len(by) < len(found):
        if len(found) != len(paths):
            raise ValueError("results without files")
        by = dict(zip(paths, found, strict=True))
    return {p: json.dumps([by[p]]) for p in paths if p in by}


def radon_split(text: str, paths: list[str]) -> dict[str, str]:
    """An object keyed by files, as objects of one."""
    found = _json(text)
    if not isinstance(found, dict):
        raise ValueError("no object")
    return {p: json.dumps({p: found[p]}) for p in paths if p in found}


def pmd_split(text: str, paths: list[str]) -> dict[str, str]:
    """The <file name="..."> elements of a report."""
    if "<pmd" not in text and "<file" not in text:
        raise ValueError("no report")
    found = {html.unescape(m[1]): m[0] for m in re.finditer(r'(?is)<file\s[^>]*?name="([^"]*)"[^>]*>.*?</file>', text)}
    return {p: f"<pmd>{found[p]}</pmd>" for p in paths if p in found}


def tool_registry(spark: SparkSession, settings: model.Settings, cwd: str | None = None) -> CcRegistry:
    """The tools that the settings name, by language: ESLint unless it is switched off, radon and PMD."""
    registry, cc = CcRegistry(spark), settings.cc
    no_lines, no_names = spark.createDataFrame([], model.CC_BY_LINE), spark.createDataFrame([], model.CC_BY_NAME)
    if cc.use_eslint_for_ts_js:
        for language in SCRIPT_LANGUAGES:
            registry.register(language, lambda d: (tools.eslint_complexity(tool_reports(d, cc.eslint_path, ESLINT, cwd, eslint_split)), no_names))
    registry.register("python", lambda d: (no_lines, tools.radon_complexity(tool_reports(d, cc.python_path, RADON, cwd, radon_split), F.col("path"))))
    registry.register("java", lambda d: (tools.pmd_complexity(tool_reports(d, cc.pmd_path, PMD, cwd, pmd_split)), no_names))
    return registry


def churn_or_none(provider: Callable[[], DataFrame]) -> DataFrame | None:
    """A provider's counts, or none with a warning if it fails: churn is optional."""
    try:
        return provider()
    except Exception as e:  # noqa: BLE001  whatever a provider raises
        log.warning("no churn: %s", e)
        return None


def cutoff(lookback_days: int, now: datetime.datetime) -> datetime.datetime:
    """The time of day of now, so many calendar days before."""
    return now - datetime.timedelta(days=lookback_days)


def commits_since(commits: DataFrame, since: datetime.datetime) -> DataFrame:
    """commits(uri, ts), as from a table of commit files: uri, commits."""
    return commits.where(F.col("ts") >= F.lit(since)).groupBy("uri").agg(F.count("*").alias("commits"))
