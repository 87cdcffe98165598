"""Risk arithmetic as columns: change risk, failure risk, churn, levels, insights and fixed-point text."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clamp01(t: Column) -> Column:
    """t within 0 and 1; NaN is 0 (Spark orders it above all numbers, so it needs a case of its own)."""
    return F.when(F.isnan(t), F.lit(0.0)).otherwise(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)))


def crap(cc: Column, t: Column) -> Column:
    """Change risk of a symbol with complexity cc and test coverage t: cc^2 (1 - t)^3 + cc."""
    c = F.greatest(cc.cast("double"), F.lit(0.0))
    missed = 1 - clamp01(t.cast("double"))
    return c * c * missed * missed * missed + c


def failure_risk(r: Column, crap_score: Column) -> Column:
    return r * crap_score


def churn_multiplier(commits: Column) -> Column:
    return 1 + F.log1p(commits.cast("double"))


#: Lower bounds, exclusive, of the risk levels.
RISK_LEVELS = (("CRITICAL", 500.0), ("HIGH", 200.0), ("MEDIUM", 50.0))


def risk_level(f: Column) -> Column:
    out = F.lit("LOW")
    for name, bound in reversed(RISK_LEVELS):
        out = F.when(f > bound, name).otherwise(out)
    return out


def decoration_tier(f: Column, warn: float = 50.0, error: float = 150.0) -> Column:
    return F.when(f >= error, "error").when(f >= warn, "warn").otherwise("none")


#: Thresholds and texts of the insights.
HIGH_CC, LOW_COVERAGE, WELL_TESTED, HIGH_RANK_WITH_RISK, HIGH_CRAP, HIGH_RANK, HIGH_F, HIGH_CHURN = 10, 0.5, 0.8, 3, 30, 5, 100, 2
INSIGHTS = {
    "untested": "High complexity with low coverage — write tests to reduce CRAP.",
    "tested": "Complex but well-tested — coverage keeps CRAP in check.",
    "cascade": "Failures here cascade through dependents — consider decoupling or adding tests.",
    "popular": "Widely depended upon — changes here affect many callers.",
    "urgent": "Risky and frequently changed — most urgent priority to address.",
}


def insights(cc: Column, t: Column, r: Column, crap_score: Column, f: Column, g: Column) -> Column:
    """The names of the insights (keys of INSIGHTS) that apply, in order."""
    complex_ = cc >= HIGH_CC
    return F.array_compact(
        F.array(
            F.when(complex_ & (t < LOW_COVERAGE), "untested").when(complex_ & (t >= WELL_TESTED), "tested"),
            F.when((r >= HIGH_RANK_WITH_RISK) & (crap_score >= HIGH_CRAP), "cascade").when(r >= HIGH_RANK, "popular"),
            F.when((f >= HIGH_F) & (g > HIGH_CHURN), "urgent"),
        )
    )


def insight_texts(names: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in INSIGHTS.items() for x in pair])
    return F.transform(names, lambda n: F.element_at(texts, n))


def fixed(value: float | None, digits: int) -> str | None:
    """value with so many decimals, its exact binary value rounded half away from zero."""
    if value is None:
        return None
    if value != value:
        return "NaN"
    if value in (float("inf"), float("-inf")):
        return "Infinity" if value > 0 else "-Infinity"
    text = f"{Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP):f}"
    return text[1:] if value == 0 and text.startswith("-") else text


def to_fixed(x: Column, digits: int) -> Column:
    """As text with so many decimals.  Spark's own formatting rounds the shortest decimal instead of the exact value, hence a UDF."""

    @F.pandas_udf(T.StringType())
    def format_(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else fixed(v, digits))

    return format_(x.cast("double"))


def round_half_up(x: Column, digits: int) -> Column:
    """Rounds the scaled binary value half up, as floor(x 10^d + 1/2) / 10^d."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def number_text(x: Column) -> Column:
    """A double as its shortest text, without a fraction where it has none."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def hover_text(prefix: str = "Risk") -> Column:
    """A Markdown breakdown from the columns cc, t, r, crap, f and g."""
    c = F.col
    return F.concat(
        F.lit(f"**{prefix}**  F="), to_fixed(c("f"), 1), F.lit("  (R×CRAP)\n\n- R (rank): "), to_fixed(c("r"), 3), F.lit("\n- CRAP: "), to_fixed(c("crap"), 2),
        F.lit("\n- CC: "), number_text(c("cc")), F.lit("\n- T (coverage): "), to_fixed(c("t") * 100, 0), F.lit("%\n\n"),
        F.array_join(insight_texts(insights(c("cc"), c("t"), c("r"), c("crap"), c("f"), c("g"))), "  \n"),
    )


def lens_title(prefix: str = "Risk") -> Column:
    return F.concat(F.lit(f"{prefix} F="), to_fixed(F.col("f"), 0), F.lit("  R="), to_fixed(F.col("r"), 2), F.lit("  CRAP="), to_fixed(F.col("crap"), 1))
