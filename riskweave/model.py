"""Schemas of the tables that operators exchange, and the settings of an analysis.

Rows keep the order of their source in `ord`; operators that depend on order take it as the last sort key.
Lines are 0-based and ranges inclusive unless a name says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass

SYMBOLS = "ord long, id string, uri string, name string, cc double, t double"
METRICS = f"{SYMBOLS}, r double, crap double, f double, g double, f_prime double"
EDGES = "ord long, caller string, callee string"
FUNCTIONS = "uri string, ord int, name string, sel_line int, sel_char int, body_start int, body_end int"
DOCUMENTS = "uri string, language_id string, lines array<string>"
STATEMENTS = "uri string, executed boolean, start_line int, end_line int"
CC_BY_LINE = "uri string, line1 int, cc double"
CC_BY_NAME = "uri string, key string, cc double"
CHURN = "uri string, commits long"


@dataclass(frozen=True)
class CoverageSettings:
    fallback_t: float = 0.0
    lcov_glob: str = "**/coverage/lcov.info"
    jacoco_glob: str = "**/jacoco.xml"


@dataclass(frozen=True)
class RankSettings:
    max_iterations: int = 100
    epsilon: float = 1e-6


@dataclass(frozen=True)
class CcSettings:
    eslint_path: str = "eslint"
    python_path: str = "python"
    pmd_path: str = "pmd"
    use_eslint_for_ts_js: bool = True


@dataclass(frozen=True)
class DecorationSettings:
    warn_threshold: float = 50.0
    error_threshold: float = 150.0


@dataclass(frozen=True)
class ChurnSettings:
    enabled: bool = False
    lookback_days: int = 90


@dataclass(frozen=True)
class ImpactTreeSettings:
    max_depth: int = 5


@dataclass(frozen=True)
class GraphViewSettings:
    enabled: bool = False


@dataclass(frozen=True)
class AnalysisSettings:
    default_folder: str = ""


@dataclass(frozen=True)
class FileFilterSettings:
    respect_gitignore: bool = False


@dataclass(frozen=True)
class Settings:
    """Everything that can be set for an analysis, with the usual values."""

    coverage: CoverageSettings = field(default_factory=CoverageSettings)
    rank: RankSettings = field(default_factory=RankSettings)
    cc: CcSettings = field(default_factory=CcSettings)
    decoration: DecorationSettings = field(default_factory=DecorationSettings)
    churn: ChurnSettings = field(default_factory=ChurnSettings)
    impact_tree: ImpactTreeSettings = field(default_factory=ImpactTreeSettings)
    graph_view: GraphViewSettings = field(default_factory=GraphViewSettings)
    analysis: AnalysisSettings = field(default_factory=AnalysisSettings)
    file_filter: FileFilterSettings = field(default_factory=FileFilterSettings)
    file_rollup: str = "max"
    codelens_enabled: bool = True
    exclude_tests: bool = True
    max_files: int = 400
    debug: bool = False

    @classmethod
    def load(cls, get: Callable[[str, object], object]) -> Settings:
        """From a getter of dotted names, such as coverage.fallback_t, with their defaults."""

        def read(kind, prefix: str):
            made = kind()
            return kind(**{f.name: read(type(v), f"{prefix}{f.name}.") if is_dataclass(v := getattr(made, f.name)) else get(f"{prefix}{f.name}", v) for f in fields(kind)})

        return read(cls, "")
