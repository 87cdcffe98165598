"""A whole analysis as one lazy plan: sources, symbols, rank, churn and rollup."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import model
from riskweave.functions.text import path_uri
from riskweave.lineage import cut
from riskweave.model import Settings
from riskweave.operators import graph, resolution, symbols
from riskweave.plans import providers
from riskweave.sources import coverage, extract, files, listing, tools


@dataclass(frozen=True)
class Analysis:
    """symbols as METRICS, file_rollup(uri, rollup), edges(ord, caller, callee)."""

    symbols: DataFrame
    file_rollup: DataFrame
    edges: DataFrame

    def edges_count(self) -> int:
        return self.edges.count()


class RiskEngine:
    """Analyses tables of documents, or the source files of a folder."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings()

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def analyze(
        self,
        documents: DataFrame,
        statements: DataFrame | None = None,
        edges: DataFrame | None = None,
        cc_by_line: DataFrame | None = None,
        cc_by_name: DataFrame | None = None,
        churn: DataFrame | None = None,
        functions: DataFrame | None = None,
    ) -> Analysis:
        """documents(ord, uri, language_id, lines) with any of the other tables; what is missing is extracted or taken as empty.

        edges may be empty to skip the call graph: then every symbol has rank 1.  churn only counts if the settings enable it.
        """
        s = self.settings
        if functions is None or edges is None:
            documents = documents if "functions" in documents.columns else cut(extract.scanned(documents))
        functions = extract.estimated_functions(documents) if functions is None else functions
        edges = self.call_graph(documents) if edges is None else edges
        inputs = symbols.symbol_inputs(documents, functions, statements, cc_by_line, cc_by_name, s.coverage.fallback_t)
        inputs = inputs.select((F.shiftleft("file_ord", 20) + F.col("ord")).alias("ord"), "id", "uri", "name", "cc", "t")
        return self.measured(inputs, edges, churn)

    def measured(self, inputs: DataFrame, edges: DataFrame, churn: DataFrame | None = None) -> Analysis:
        """From symbols(ord, id, uri, name, cc, t) and edges on."""
        s = self.settings
        ranks = graph.rank(edges, s.rank.max_iterations, s.rank.epsilon)
        metrics = symbols.symbol_metrics(inputs, ranks)
        if s.churn.enabled and churn is not None:
            metrics = symbols.apply_churn(metrics, churn)
        metrics = cut(metrics.select(*[c.split()[0] for c in model.METRICS.split(", ")]))  # everything is asked of it
        return Analysis(metrics, symbols.file_rollup(metrics, s.file_rollup), edges)

    def call_graph(self, documents: DataFrame) -> DataFrame:
        """Script edges, then Java edges; documents that are not scanned yet are scanned once."""
        documents = documents if "functions" in documents.columns else cut(extract.scanned(documents))
        declared, called = extract.declarations(documents), extract.calls(documents)
        script = resolution.script_edges(declared, called, extract.imports(documents), extract.exports(documents), extract.classes(documents), extract.bindings(documents))
        return resolution.united(script, resolution.java_edges(declared, called, extract.fields(documents)))

    def analyze_folder(self, root: str, call_graph: bool = True, with_tests_in_graph: bool = True, now: datetime.datetime | None = None, scope: str | None = None, registry: providers.CcRegistry | None = None) -> Analysis:
        """The files of a folder on a path that Spark reads, with its LCOV reports, and its commits if churn is enabled.

        The call graph is of all files found, tests and ignored files included.  A registry's tools measure complexity; without one, or where they
        say nothing, it is estimated.
        """
        s = self.settings
        # one discovery and one scan for both: each file is marked as analyzed, as part of the call graph, or both
        found = files.found_paths(self.spark, root, s.max_files, False, False, scope)
        analyzed, linked = files.kept(self.spark, root, s.exclude_tests, s.file_filter.respect_gitignore), files.kept(self.spark, root, not with_tests_in_graph, False)
        found = found.withColumns({"analyzed": analyzed, "linked": linked}).where("analyzed or linked")
        sources = cut(extract.scanned(files.numbered(files.documents(found, scope or root))))
        documents = sources.where("analyzed")
        statements = self.reports(root)
        churn = None
        if s.churn.enabled:
            since = providers.cutoff(s.churn.lookback_days, now or datetime.datetime.now())
            churn = providers.churn_or_none(lambda: tools.commit_counts(tools.commit_log(self.spark, root, since.isoformat()), path_uri(root.rstrip("/"))))
        edges = self.call_graph(sources.where("linked")) if call_graph else self._empty(model.EDGES)
        by_line, by_name = registry.tables(documents) if registry else (None, None)
        return self.analyze(documents, statements, edges, by_line, by_name, churn=churn)

    def reports(self, roots: str | list[str], jacoco: bool = False, limit: int = 50) -> DataFrame:
        """The statements of the LCOV reports below each root and, where asked for, of JaCoCo reports after them, at most `limit` of each kind a
        root; a report's relative paths are those of its own root."""
        statements = []
        for root in [roots] if isinstance(roots, str) else roots:
            if paths := self._report_paths(root, self.settings.coverage.lcov_glob, limit):
                statements.append(coverage.at_uris(coverage.lcov_statements(coverage.report_lines(self.spark, paths)), root))
            if jacoco and (paths := self._report_paths(root, self.settings.coverage.jacoco_glob, limit)):
                known = files.found_paths(self.spark, root, self.settings.max_files, False).select("uri")
                statements.append(coverage.suffix_uris(coverage.jacoco_statements(coverage.report_tags(self.spark, paths)), known))
        return coverage.merged(*statements) if statements else self._empty(model.STATEMENTS)

    def _report_paths(self, root: str, pattern: str, limit: int) -> list[str]:
        """The first files by path, `limit` at most, of a pattern such as **/folder/name."""
        *above, name = pattern.split("/")
        folder = rf"(^|/){re.escape(above[-1])}/" if above and above[-1] != "**" else "(^|/)"
        found = listing.listed(self.spark, root, rf"{folder}{re.escape(name)}$", ("node_modules",), True, limit)
        return [r["path"] for r in found.collect()]
