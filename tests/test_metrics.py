import math

import pytest
from pyspark.sql import functions as F

from riskweave.functions import metrics as M
from riskweave.functions import text as X


def one(spark, column, **values):
    from pyspark.sql import types as T

    kinds = {float: T.DoubleType(), int: T.LongType(), str: T.StringType(), type(None): T.DoubleType()}
    schema = T.StructType([T.StructField(k, kinds[type(v)]) for k, v in values.items()])
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("cc, t, want", [(4.0, 0.3, 9.488), (2.0, 0.5, 2.5), (9.0, 0.2, 50.472), (1.0, math.nan, 2.0), (1.0, -0.5, 2.0), (2.0, 1.5, 2.0), (4.0, 0.0, 20.0), (-3.0, 0.0, 0.0)])
def test_crap(spark, cc, t, want):
    assert one(spark, M.crap(F.col("cc"), F.col("t")), cc=cc, t=t) == pytest.approx(want)


@pytest.mark.parametrize("f, want", [(50.0, "LOW"), (50.01, "MEDIUM"), (200.0, "MEDIUM"), (200.01, "HIGH"), (500.0, "HIGH"), (500.01, "CRITICAL")])
def test_risk_level(spark, f, want):
    assert one(spark, M.risk_level(F.col("f")), f=f) == want


@pytest.mark.parametrize("f, want", [(200.0, "error"), (150.0, "error"), (100.0, "warn"), (50.0, "warn"), (10.0, "none")])
def test_decoration_tier(spark, f, want):
    assert one(spark, M.decoration_tier(F.col("f")), f=f) == want


def test_churn_multiplier(spark):
    assert one(spark, M.churn_multiplier(F.col("n")), n=0) == 1
    assert one(spark, M.churn_multiplier(F.col("n")), n=10) == pytest.approx(1 + math.log(11))


@pytest.mark.parametrize("x, digits, want", [(0.5, 0, "1"), (0.4, 0, "0"), (1.45, 1, "1.4"), (0.25, 1, "0.3"), (1.005, 2, "1.00"), (99.5, 0, "100"), (-0.5, 0, "-1"), (math.nan, 1, "NaN"), (math.inf, 1, "Infinity")])
def test_fixed(x, digits, want):
    assert M.fixed(x, digits) == want


def test_round_half_up_takes_the_binary_value(spark):
    assert one(spark, M.round_half_up(F.col("x"), 2), x=1.005) == 1.0
    assert one(spark, M.round_half_up(F.col("x"), 0), x=-0.5) == 0


@pytest.mark.parametrize(
    "cc, t, r, crap, f, g, want",
    [
        (9.0, 0.0, 1.0, 0.0, 0.0, 1.0, []),
        (10.0, 0.49, 1.0, 0.0, 0.0, 1.0, ["untested"]),
        (10.0, 0.5, 1.0, 0.0, 0.0, 1.0, []),
        (10.0, 0.8, 3.0, 30.0, 100.0, 2.0, ["tested", "cascade"]),
        (1.0, 0.0, 5.0, 29.0, 100.0, 2.1, ["popular", "urgent"]),
        (1.0, 0.0, 5.0, 30.0, 99.0, 2.1, ["cascade"]),
    ],
)
def test_insights(spark, cc, t, r, crap, f, g, want):
    column = M.insights(*[F.col(c) for c in ("cc", "t", "r", "crap", "f", "g")])
    assert one(spark, column, cc=cc, t=t, r=r, crap=crap, f=f, g=g) == want


def test_texts(spark):
    values = dict(cc=12.0, t=0.995, r=3.0, crap=85.728, f=257.184, g=1.0)
    assert one(spark, M.lens_title("X"), **values) == "X F=257  R=3.00  CRAP=85.7"
    hover = one(spark, M.hover_text("X risk"), **values)
    assert hover.startswith("**X risk**  F=257.2  (R×CRAP)\n\n- R (rank): 3.000\n- CRAP: 85.73\n- CC: 12\n- T (coverage): 100%\n\nComplex but")
    assert hover.count("  \n") == 1


@pytest.mark.parametrize(
    "source, want",
    [("if (a&&b) {}", 3), ("if (a) {} else if (b) {}", 3), ("const x = a ? b : c;", 2), ("if (a) { while (b) { for (;;) {} } }", 4), ("", 1), ("éif (a) forx foreach case catch elif", 5), ("a?.b", 1)],
)
def test_estimated_cc(spark, source, want):
    assert one(spark, X.estimated_cc(F.col("s")), s=source) == want


TESTS = ["foo.test.ts", "foo.SPEC.js", "/__TESTS__/x", "/test/x", "/Tests/x", "/test_utils/x", "FooTest.java", "ServiceIT.java", "a\\test\\b.ts", "test_x.py"]
OTHERS = ["", "test.ts", "spec.ts", "contest.ts", "testing.ts", "/contested/x", "/my_test_utils/x"]


@pytest.mark.parametrize("uri, want", [(u, True) for u in TESTS] + [(u, False) for u in OTHERS])
def test_is_test_file(spark, uri, want):
    assert one(spark, X.is_test_file(F.col("u")), u=uri) is want


@pytest.mark.parametrize("path, want", [("a.ts", "typescript"), ("a.tsx", "typescriptreact"), ("a.mjs", "javascript"), ("b/App.TS", "typescript"), ("a.md", "unknown"), ("x", "unknown"), ("a.java", "java"), ("a.py", "python")])
def test_language(spark, path, want):
    assert one(spark, X.language_of(F.col("p")), p=path) == want


def test_paths(spark):
    match = X.path_matches(F.col("u"), F.col("p"))
    for u, p, want in [("a/b.ts", "a/b.ts", True), ("file:///w/src/utils.ts", "src\\utils.ts", True), ("file:///w/myutils.ts", "utils.ts", False)]:
        assert one(spark, match, u=u, p=p) is want
    rel = X.relative_path(F.col("u"), "/work space")
    assert one(spark, rel, u="file:///work%20space/a%2Bb/c+d.ts") == "a+b/c+d.ts"
    assert one(spark, rel, u="file:///other/c.ts") == "file:///other/c.ts"
    assert one(spark, X.relative_path(F.col("u"), "C:\\code"), u="file:///C%3A/code/x.ts") == "x.ts"
    assert X.path_uri("/a b/c#.ts") == "file:///a%20b/c%23.ts"


def test_symbol_ids(spark):
    parsed = X.parsed_symbol_id(F.col("s"))
    assert one(spark, parsed, s="file:///a.ts#3:14").asDict() == {"uri": "file:///a.ts", "line": 3, "character": 14}
    assert one(spark, parsed, s="#3:1") is None and one(spark, parsed, s="nothing") is None
    assert one(spark, X.label_of(F.col("s")), s="a#b#c") == "c"
    assert one(spark, X.message_complexity(F.col("s")), s="has a Complexity of 12.") == 12
