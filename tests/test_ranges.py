"""Coverage by counting and cursors by a sweep, against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import symbols

STATEMENTS = "uri string, executed boolean, start_line int, end_line int"
BODIES = "id string, uri string, body_start int, body_end int"


@pytest.mark.parametrize("seed, part", [(0, 50_000), (1, 3), (2, 1), (3, 17)])
def test_coverage_against_all_pairs(spark, seed, part):
    rng = random.Random(seed)
    span = lambda n: (lambda a: (a, a + rng.choice([0, 0, 1, n])))(rng.randrange(40))
    statements = [(rng.choice(["x", "x", "y", "z", None]), rng.choice([True, False, None]), *span(30)) for _ in range(200)] + [("x", True, None, 3), ("x", True, 9, 4)]
    bodies = [(f"b{k % 37}", rng.choice(["x", "x", "y", "w", None]), *span(12)) for k in range(40)] + [("odd", "x", 9, 3), ("null", "x", None, 3)]
    fine = [s for s in statements if s[2] is not None and s[2] <= s[3]]
    want = {b[0]: [0, 0] for b in bodies}
    for i, u, a, b in bodies:
        if u is not None and a is not None and a <= b:
            over = [s for s in fine if s[0] == u and s[2] <= b and a <= s[3]]
            want[i] = [want[i][0] + sum(bool(s[1]) for s in over), want[i][1] + len(over)]
    got = symbols.coverage(spark.createDataFrame(bodies, BODIES), spark.createDataFrame(statements, STATEMENTS).repartition(3), 0.25, part).collect()
    assert {r["id"]: [r["covered"], r["total"]] for r in got} == want and len(got) == len(want)
    assert all(r["t"] == (r["covered"] / r["total"] if r["total"] else 0.25) for r in got)


def test_long_statement_and_large_file(spark):
    """A statement over a million lines is two rows, and a file with a million statements is dealt over windows."""
    long = spark.createDataFrame([("l", True, 0, 1_000_000), ("l", False, 500_000, 500_000)], STATEMENTS)
    many = spark.range(1_000_000).select(F.lit("m").alias("uri"), (F.col("id") % 4 == 0).alias("executed"), F.col("id").cast("int").alias("start_line"), F.col("id").cast("int").alias("end_line"))
    bodies = spark.createDataFrame([("a", "l", 499_990, 500_010), ("b", "l", 7, 7), ("c", "m", 100_000, 899_999), ("d", "m", 999_999, 2_000_000), ("e", "m", 0, 3)], BODIES)
    found = symbols.coverage(bodies, long.unionByName(many))
    got = {r["id"]: (r["covered"], r["total"]) for r in found.collect()}
    assert got == {"a": (1, 2), "b": (1, 1), "c": (200_000, 800_000), "d": (0, 1), "e": (1, 4)}
    points = many.select("uri", F.col("start_line").cast("long").alias("at"), F.lit(1).cast("long").alias("n"))
    sums = symbols.running(points, "uri", "at", ["n"], 1000)
    assert sums.where(F.col("n") != F.col("at") + 1).count() == 0
    assert points.withColumn("_part", F.floor(F.col("at") / 1000)).groupBy("_part").count().agg(F.max("count")).first()[0] == 1000


def test_coverage_deals_a_statement_once(spark, tmp_path):
    """One row and one exchange for a statement on a line; two rows where it ends on another."""
    rows = [("x", k % 2 == 0, k, k) for k in range(1000)] + [("x", True, 5, 900)]
    spark.createDataFrame(rows, STATEMENTS).write.parquet(str(tmp_path / "s"))
    found = symbols.coverage(spark.createDataFrame([("a", "x", 10, 19), ("b", "x", 950, 1100)], BODIES), spark.read.parquet(str(tmp_path / "s")))
    assert {r["id"]: (r["covered"], r["total"]) for r in found.collect()} == {"a": (6, 11), "b": (25, 50)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [uri") == 2  # the windows and what comes before them, which is one exchange that is used twice
    assert not any("start_line" in x for x in plan.splitlines() if "Aggregate [" in x)


def all_pairs(functions, known, cursors):
    out = {}
    for uri, line in cursors:
        held = sorted((f[1], f"{f[0]}#{f[3]}:{f[4]}") for f in functions if uri is not None and f[0] == uri and line is not None and f[3] <= line <= f[6] and f"{f[0]}#{f[3]}:{f[4]}" in known)
        if held:
            out[uri, line] = held[0][1]
    return out


FUNCTIONS = "uri string, ord int, name string, sel_line int, sel_char int, body_start int, body_end int"


@pytest.mark.parametrize("seed, part", [(0, 20_000), (1, 5), (2, 2), (3, 40)])
def test_cursors_against_all_pairs(spark, seed, part):
    rng = random.Random(seed)
    functions = []
    for k in range(150):
        a = rng.randrange(200)
        functions.append((rng.choice(["hot", "hot", "hot", "y", "z"]), rng.randrange(500), rng.choice(["f", None]), a, k, a, a + rng.choice([0, 1, 5, 30, 150, -2])))
    ids = [f"{f[0]}#{f[3]}:{f[4]}" for f in functions]
    known = set(rng.sample(ids, 120))
    cursors = [(rng.choice(["hot", "hot", "y", "w", None]), rng.choice([*range(-3, 380), None])) for _ in range(300)]
    metrics = spark.createDataFrame([(i,) for i in known], "id string")
    got = symbols.at_cursor(spark.createDataFrame(functions, FUNCTIONS), metrics, spark.createDataFrame(cursors, "uri string, line int"), part).collect()
    assert {(r["uri"], r["line"]): r["id"] for r in got} == all_pairs(functions, known, set(cursors)) and len(got) == len({(r["uri"], r["line"]) for r in got})
    assert {r["name"] for r in got} <= {"f", None}


def test_cursors_in_one_hot_file(spark):
    """A hundred thousand functions in one file, nested and long, and as many cursors: rows stay in proportion."""
    n = 100_000
    functions = spark.range(n).select(F.lit("hot").alias("uri"), (n - F.col("id")).alias("ord"), F.lit("f").alias("name"), F.col("id").cast("int").alias("sel_line"), F.lit(0).alias("sel_char"), F.col("id").cast("int").alias("body_start"), (2 * n - F.col("id")).cast("int").alias("body_end"))
    metrics = functions.select(F.concat(F.lit("hot#"), F.col("sel_line").cast("string"), F.lit(":0")).alias("id"))
    cursors = spark.range(n).select(F.lit("hot").alias("uri"), (2 * F.col("id")).cast("int").alias("line"))
    got = symbols.at_cursor(functions, metrics, cursors, 2_000)
    # the innermost function has the least ord: before the middle that of the line itself, behind it the one that ends there or later
    line = F.regexp_extract("id", "#([0-9]+):", 1).cast("int")
    assert got.count() == n
    assert got.where(line != F.least(F.col("line"), F.lit(2 * n) - F.col("line"), F.lit(n - 1))).count() == 0
    assert symbols.at_cursor(functions.limit(0), metrics, cursors).count() == 0


def test_coverage_deals_statements_once(spark):
    """Statements are read once, and what bodies ask for and what earlier windows sum to come from one exchange of them."""
    statements = spark.range(200).select(F.lit("x").alias("uri"), (F.col("id") % 2 == 0).alias("executed"), F.col("id").cast("int").alias("start_line"), F.col("id").cast("int").alias("end_line"))
    found = symbols.coverage(spark.createDataFrame([("a", "x", 10, 19), ("b", "x", 190, 400)], BODIES), statements, 0.0, 50)
    assert {r["id"]: (r["covered"], r["total"]) for r in found.collect()} == {"a": (5, 10), "b": (5, 10)}
    final = found._jdf.queryExecution().executedPlan()
    found._jdf.collectToPython()
    plan = final.toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("Range (0, 200") == 1
