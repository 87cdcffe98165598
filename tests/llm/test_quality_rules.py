import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from riskweave.llm import quality_rules as Q


def brute(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
    many, covered = collections.Counter(windows), set()
    for k, w in enumerate(windows):
        if many[w] > 1:
            covered.update(range(k, k + 8))
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


TEXTS = ["a b c d e f g h " * 3, "x " * 40, "l1\nl1\n \n\nl2\nl1", "a#*$%&|<>\x0b\x0cé𝄞 \x85z", "a b c d e f g h i a b c d e f g h j a b c d e f g h", "\n", "w" * 5000]


def test_statistics(spark, odd_texts):
    rows = list(enumerate(TEXTS + odd_texts))
    df = spark.createDataFrame(rows, "row long, text string").withColumn("_words", F.lit(0))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["row"]: tuple(r[n] for n in names) for r in Q.text_stats(df).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert Q.text_stats(df.limit(0)).count() == 0


@pytest.mark.parametrize("k, n, p", [(0, 75, 0.03), (3, 400, 0.03), (10, 1000, 0.02), (0, 0, 0.1), (50, 20_000, 0.01), (9, 10, 0.5)])
def test_binomial(spark, k, n, p):
    want = 1.0 if k >= n * p else math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
    got = spark.createDataFrame([(k, n)], "k long, n long").select(Q.binomial_cdf(F.col("k"), F.col("n"), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-6)


STATS = "lang string, good boolean, n_words long, word_chars long, n_symbols long, n_upper long, n_lines long, n_dup_lines long, n_repeat_words long"


def stats(lang, good, symbols, n):
    return [(lang, good, 100, 500, symbols, 5, 10, 0, 0)] * n


def cuts(spark, rows, **control):
    return {r["stratum"]: r for r in Q.cutoffs(spark.createDataFrame(rows, STATS), "lang", "good", Q.RiskControl(**control)).collect()}


def test_cutoffs_keep_the_risk(spark):
    rows = stats("en", True, 5, 990) + stats("en", True, 35, 10) + stats("en", False, 60, 30) + stats("en", False, 45, 200) + stats("de", True, 5, 20) + stats("de", False, 90, 20) + stats(None, True, 1, 300) + stats(None, None, 99, 3)
    got = cuts(spark, rows, risk=0.03, delta=0.1)
    assert got["en"]["cut_symbol_ratio"] == 0.4 and got["en"]["n_good"] == 1000  # 0.3 would only reject good ones more
    assert got["de"]["cut_symbol_ratio"] is None and got[None]["cut_symbol_ratio"] is None
    # 5 percent of the good stand at 0.6: no rung that rejects them passes
    rows = stats("en", True, 5, 950) + stats("en", True, 60, 50) + stats("en", False, 60, 500) + stats("en", False, 95, 7)
    assert cuts(spark, rows)["en"]["cut_symbol_ratio"] == 0.9
    assert cuts(spark, []) == {}


def test_verdicts(spark):
    rows = stats("en", True, 50, 1) + stats("en", True, 30, 1) + stats("fr", True, 99, 1) + stats(None, True, 99, 1)
    df = spark.createDataFrame(rows, STATS)
    table = spark.createDataFrame([("en", 0.4), (None, 0.9)], "stratum string, cut_symbol_ratio double").withColumn("n_good", F.lit(1))
    for r in ("dup_line_ratio", "upper_ratio", "repeat_ratio"):
        table = table.withColumn(f"cut_{r}", F.lit(None).cast("double"))
    assert [r["kept"] for r in Q.judged(df, table, "lang").orderBy("lang", "n_symbols").collect()] == [False, True, False, True]


def test_only_dataframe_functions(spark, docs):
    found = Q.text_stats(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_all_rules_together_keep_the_risk(spark):
    """Each of two rules alone would reject three of a hundred good documents; together that is too much for a risk of four in a hundred."""
    row = lambda good, symbols, upper, n: [("en", good, 100, 500, symbols, upper, 10, 0, 0)] * n
    rows = row(True, 5, 5, 9400) + row(True, 60, 5, 300) + row(True, 5, 400, 300) + row(False, 60, 400, 3000)
    got = cuts(spark, rows, risk=0.04)["en"]
    assert got["cut_symbol_ratio"] is None and got["cut_upper_ratio"] is None
    wide = cuts(spark, rows, risk=0.16)["en"]
    assert wide["cut_symbol_ratio"] == 0.6 and wide["cut_upper_ratio"] == 0.8


def test_columns_of_the_statistics_names_are_replaced(spark):
    df = spark.createDataFrame([("a b", "x", 1), (None, "y", 2)], "text string, N_Words string, row int")
    assert sorted((r["row"], r["n_words"]) for r in Q.text_stats(df).collect()) == [(1, 2), (2, 0)]
