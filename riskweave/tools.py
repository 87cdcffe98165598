"""Tool functions for assistants: each analyses a folder anew and answers with JSON text, errors included."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskweave.plans import views
from riskweave.plans.engine import Analysis, RiskEngine

COLUMNS = ("id", "uri", "name", "cc", "t", "r", "crap", "f", "g", "f_prime")


def _rows(df: DataFrame) -> list[dict]:
    return [{c: r[c] for c in COLUMNS} for r in df.collect()]


class Tools:
    """analysis: makes the analysis that a call works on; by default that of a folder."""

    def __init__(self, spark: SparkSession, root: str = ".", analysis: Callable[[], Analysis] | None = None):
        self.analysis = analysis or (lambda: RiskEngine(spark).analyze_folder(root))

    def _answer(self, make: Callable[[Analysis], object]) -> dict:
        try:
            return {"text": json.dumps(views._plain(make(self.analysis())), indent=2, ensure_ascii=False), "is_error": False}
        except Exception as e:  # noqa: BLE001  a failed call is an answer
            return {"text": f"Error: {e}", "is_error": True}

    def analyze_file(self, file: str) -> dict:
        return self._answer(lambda a: _rows(views.analyzed_file(a.symbols, file)))

    def high_risk_symbols(self, file: str, f_min: float = 0.0) -> dict:
        return self._answer(lambda a: _rows(views.high_risk(a.symbols, file, f_min)))

    def caller_tree(self, file: str, symbol: str, depth: int = 5) -> dict:
        return self._answer(lambda a: views.callers_result(a, file, symbol, depth))

    def workspace_hotspots(self, top: int = 10) -> dict:
        return self._answer(lambda a: _rows(views.hotspots(a.symbols, top)))
