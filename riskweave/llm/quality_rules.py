"""Rule statistics of whole texts, and risk-controlled cutoffs for them: DataFrame functions only.

Each rule rejects a text whose statistic is at or above a cutoff.  The cutoffs are chosen for each stratum from a fixed ladder on
labelled holdout documents.  Walking from the loosest rung to the strictest, a rung is taken while the exact binomial test
P(Bin(n, risk / rules) <= rejected good documents) <= delta / (rules * strata) holds, and the walk ends at the first rung that fails.
Of the certified rungs the one that rejects most bad documents net of good ones is used (the loosest on a tie; none
if it gains nothing).  A ladder walked in a fixed order needs no further correction; rules and strata are corrected by Bonferroni.  So, with
probability 1 - delta over the holdout, in every stratum each rule falsely rejects at most risk / rules of the good documents, and so
all rules together at most `risk`.  A stratum with too few labels gets no cutoff and rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
BROADCAST_STRATA = 10_000
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")

#: Ladders, loosest rung first, of statistics that grow with junk.
LADDERS: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (2.0, 1.5, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "dup_line_ratio": (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "upper_ratio": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_ratio": (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
}


@dataclass(frozen=True)
class RiskControl:
    """risk: the largest false-rejection rate of all rules together in a stratum; delta: the probability with which any bound may fail."""

    risk: float = 0.04
    delta: float = 0.1
    ladders: dict[str, tuple[float, ...]] = field(default_factory=lambda: LADDERS)

    @property
    def rule_risk(self) -> float:
        """A rule's share of the risk: what several rules reject is at most the sum."""
        return self.risk / len(self.ladders)


def _hash_windows() -> Column:
    """A hash of each 8-word window; empty with fewer words."""
    w = F.col("_w")
    starts = F.when(F.size("_w") >= WINDOW, F.sequence(F.lit(0), F.size("_w") - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))


def _repeat_words() -> Column:
    """Words inside windows that occur twice or more: sort (hash, place), keep places with an equal neighbour, add up coverage."""
    n = F.size("_s")
    places = F.transform(
        F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda k: (F.get("_s", k - 1)["h"] == F.get("_s", k)["h"]) | (F.get("_s", k + 1)["h"] == F.get("_s", k)["h"]),
        ),
        lambda k: F.get("_s", k)["i"],
    )
    step = F.aggregate(
        F.array_sort(places),
        F.struct(F.lit(0).cast("long").alias("words"), F.lit(-WINDOW).cast("long").alias("last")),
        lambda acc, i: F.struct((acc["words"] + F.least(F.lit(WINDOW).cast("long"), i - acc["last"])).alias("words"), i.cast("long").alias("last")),
        lambda acc: acc["words"],
    )
    return step


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of the whole text; a null text has none of each.

    Words are runs of other characters than ASCII white space; characters are code points.  Other columns pass through, but columns of these
    names are replaced.  Rows are counted each, whatever repeats; an empty table gives an empty result.
    """
    others = [c for c in docs.columns if c.lower() not in STATISTICS]
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    split = kept.select(
        "row",
        F.regexp_extract_all("_t", F.lit(f"[^{SPACE}]+"), 0).alias("_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", UPPER, ""))).cast("long").alias("n_upper"),
        F.filter(F.split("_t", "\n", -1), lambda line: line.rlike(f"[^{SPACE}]")).alias("_lines"),
    )
    counted = split.select(
        "row",
        "word_chars",
        "n_symbols",
        "n_upper",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda x: F.xxhash64(x)).alias("_w"),
    )
    windows = counted.withColumn("_h", _hash_windows())
    # only a text in which a window repeats is sorted
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    paired = windows.withColumn("_s", F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    return paired.select(
        "row.*",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_upper",
        "n_lines",
        "n_dup_lines",
        F.coalesce(F.when(F.col("_s").isNotNull(), _repeat_words()), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def rule_statistics() -> dict[str, Column]:
    return {"symbol_ratio": _ratio("n_symbols", "n_words"), "dup_line_ratio": _ratio("n_dup_lines", "n_lines"), "upper_ratio": _ratio("n_upper", "word_chars"), "repeat_ratio": _ratio("n_repeat_words", "n_words")}


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms so that large n don't underflow; 1 where n is 0."""
    import math

    odds = math.log(p) - math.log1p(-p)
    nd = n.cast("double")
    first = nd * math.log1p(-p)
    start = F.struct(first.alias("term"), first.alias("peak"), F.lit(1.0).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((nd - j + 1) / j) + odds
        peak = F.greatest(acc["peak"], term)
        return F.struct(term.alias("term"), peak.alias("peak"), (acc["sum"] * F.exp(acc["peak"] - peak) + F.exp(term - peak)).alias("sum"))

    ks = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(ks, start, step, lambda acc: F.exp(acc["peak"]) * acc["sum"])
    # above the mean the tail is far above any level used here, and need not be summed
    return F.when(n == 0, F.lit(1.0)).when(k.cast("double") >= nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


def cutoffs(labelled: DataFrame, stratum: str, good: str, control: RiskControl = RiskControl()) -> DataFrame:
    """labelled: holdout rows with text_stats' columns, a stratum and whether the row is good (null: left out).

    Returns a row a stratum: stratum, n_good, and a cutoff for each rule (null where none is certified).
    """
    stats = rule_statistics()
    rungs = [(rule, i, c) for rule, ladder in control.ladders.items() for i, c in enumerate(ladder)]
    is_good, is_bad = F.col(good), ~F.col(good)
    counts = labelled.where(F.col(good).isNotNull()).withColumns({f"_{r}": c for r, c in stats.items()}).groupBy(F.col(stratum).alias("stratum")).agg(
        F.count_if(is_good).alias("n_good"),
        *[F.count_if(is_good & (F.col(f"_{r}") >= c)).alias(f"k_{r}_{i}") for r, i, c in rungs],
        *[F.count_if(is_bad & (F.col(f"_{r}") >= c)).alias(f"b_{r}_{i}") for r, i, c in rungs],
    )
    strata = counts.agg(F.count("*").alias("n_strata"))
    tested = counts.crossJoin(F.broadcast(strata))  # one row: the number of strata
    level = F.lit(control.delta) / (len(control.ladders) * F.col("n_strata"))
    out = []
    for rule, ladder in control.ladders.items():
        tried = F.array(
            *[
                F.struct(
                    (binomial_cdf(F.col(f"k_{rule}_{i}"), F.col("n_good"), control.rule_risk) <= level).alias("passed"),
                    (F.col(f"b_{rule}_{i}") - F.col(f"k_{rule}_{i}")).alias("gain"),
                    F.lit(c).alias("cut"),
                )
                for i, c in enumerate(ladder)
            ]
        )
        # the rungs before the first failure, then the best of them
        walk = F.aggregate(
            tried,
            F.struct(F.lit(True).alias("on"), F.lit(0).cast("long").alias("gain"), F.lit(None).cast("double").alias("cut")),
            lambda acc, x: F.when(acc["on"] & x["passed"] & (x["gain"] > acc["gain"]), F.struct(F.lit(True).alias("on"), x["gain"].alias("gain"), x["cut"].alias("cut"))).otherwise(
                F.struct((acc["on"] & x["passed"]).alias("on"), acc["gain"].alias("gain"), acc["cut"].alias("cut"))
            ),
            lambda acc: acc["cut"],
        )
        out.append(walk.alias(f"cut_{rule}"))
    return tested.select("stratum", "n_good", *out)


def judged(stats: DataFrame, cuts: DataFrame, stratum: str, rules: dict[str, tuple[float, ...]] = LADDERS) -> DataFrame:
    """Adds base_failed and kept.  cuts (a row a stratum) is broadcast only when it has at most BROADCAST_STRATA rows."""
    small = cuts.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    cuts = cuts.withColumnRenamed("stratum", "_stratum").drop("n_good")
    joined = stats.join(F.broadcast(cuts) if small else cuts, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    measures = rule_statistics()
    rejected = F.lit(False)
    for rule in rules:
        rejected = rejected | F.coalesce(measures[rule] >= F.col(f"cut_{rule}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum")
