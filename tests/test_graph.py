import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import callers, graph

EDGES = "ord long, caller string, callee string"


def edges(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], EDGES)


def ranks(spark, pairs, **options):
    """With one step a plan and with several, which must agree."""
    one, many = ({r["id"]: r["r"] for r in graph.rank(edges(spark, pairs), block=n, **options).collect()} for n in (1, 5))
    assert one == pytest.approx(many)
    return one


def test_rank_examples(spark):
    assert ranks(spark, [(f"c{i}", "M") for i in range(6)])["M"] == 7
    two = ranks(spark, [("x0", "a"), ("x1", "a"), ("x2", "a"), ("y0", "b"), ("y1", "b"), ("y2", "b"), ("a", "M"), ("b", "M")])
    assert (two["a"], two["b"], two["M"]) == (4, 4, 9)
    chain = ranks(spark, [("A", "B"), ("B", "C")])
    assert (chain["B"], chain["C"]) == (2, 3)
    assert ranks(spark, [("A", "B"), ("A", "B"), ("A", "B"), ("C", "B")])["B"] == 3
    assert ranks(spark, [("A", "B")], max_iterations=0) == {"A": 1, "B": 1}
    assert ranks(spark, [("A", "B"), ("B", "C")], max_iterations=1)["C"] == 2
    assert ranks(spark, []) == {}


def test_rank_drops_edges_without_an_end(spark):
    rows = [(0, "a", "b"), (1, None, "b"), (2, "a", None), (3, "c", "b")]
    assert {r["id"]: r["r"] for r in graph.rank(spark.createDataFrame(rows, EDGES)).collect()} == {"a": 1, "b": 3, "c": 1}


def test_rank_grows_in_cycles(spark):
    assert ranks(spark, [("A", "B"), ("B", "A")], max_iterations=12) == {"A": 13, "B": 13}
    assert ranks(spark, [("A", "A")], max_iterations=7) == {"A": 8}


def plain_rank(pairs, steps, epsilon):
    pairs = set(pairs)
    degree = {a: sum(x == a for x, _ in pairs) for a, _ in pairs}
    now = {n: 1.0 for p in pairs for n in p}
    for _ in range(steps):
        new = {n: 1 + sum(now[a] / degree[a] for a, b in pairs if b == n) for n in now}
        moved = max((abs(new[n] - now[n]) for n in now), default=0)
        now = new
        if moved < epsilon:
            break
    return now


@pytest.mark.parametrize("seed", range(3))
def test_rank_against_plain_python(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(25)]
    if seed == 0:
        pairs = [(a, b) for a, b in pairs if a < b]
    want = plain_rank(pairs, 13, 0.01)
    assert ranks(spark, pairs, max_iterations=13, epsilon=0.01) == pytest.approx(want)


def test_rank_peels_chains_off_cycles(spark):
    """A chain longer than the iterations, one that leads into a cycle, and one that leads out of it."""
    pairs = [(f"c{k}", f"c{k + 1}") for k in range(30)] + [(f"i{k}", f"i{k + 1}") for k in range(7)] + [("i7", "x"), ("x", "y"), ("y", "x"), ("y", "o0"), *((f"o{k}", f"o{k + 1}") for k in range(9))]
    for steps in (3, 25):
        got = {r["id"]: r["r"] for r in graph.rank(edges(spark, pairs), steps).collect()}
        assert got == pytest.approx(plain_rank(pairs, steps, 1e-6))


def test_rank_stops_inside_a_plan(spark):
    """Moves get small slowly: the settling step is found among those of one plan."""
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("d", "e"), ("b", "z")]
    for epsilon in (0.3, 0.1, 0.01):
        got = {r["id"]: r["r"] for r in graph.rank(edges(spark, pairs), 60, epsilon).collect()}
        assert got == pytest.approx(plain_rank(pairs, 60, epsilon))


def test_rank_steps_have_one_exchange_each(spark):
    from riskweave.lineage import Scratch

    own = spark.newSession()
    for setting, value in (("adaptive.enabled", "false"), ("shuffle.partitions", "3"), ("autoBroadcastJoinThreshold", "-1")):
        own.conf.set(f"spark.sql.{setting}", value)
    made = Scratch(spark)
    given = made.bucketed(own.createDataFrame([(0, 1, 1.0, 0.0), (1, 0, 1.0, 0.0)], "k long, v long, share double, add double"), "k", 3, "edges")
    state = own.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 1.0)], "k long, r double, d double")
    for _ in range(5):
        state = graph.stepped(given, state)
    assert state._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 5 + 1  # the last is that of the first state
    made.drop_all()


def plain_tree(pairs, root, depth):
    def below(at, level, way):
        out = []
        for a, b in pairs:
            if b == at:
                again = a in way
                out.append((a, level, again, [] if again or level >= depth else below(a, level + 1, way | {a})))
        return out

    return below(root, 1, {root})


def flat(nodes):
    for a, level, again, more in nodes:
        yield a, level, again
        yield from flat(more)


def affected(nodes, met):
    n = 0
    for a, _, _, more in nodes:
        if a not in met:
            met.add(a)
            n += 1 + affected(more, met)
    return n


def tree(spark, pairs, root, depth):
    return callers.caller_tree(spark.createDataFrame([(root,)], "root string"), edges(spark, pairs), depth)


def rows(df):
    return [(r["id"], r["depth"], r["recursive"]) for r in df.orderBy("path").collect()]


def test_caller_tree_examples(spark):
    assert rows(tree(spark, [("B", "A"), ("A", "B")], "A", 5)) == [("B", 1, False), ("A", 2, True)]
    assert rows(tree(spark, [("B", "A"), ("C", "B"), ("D", "C")], "A", 2)) == [("B", 1, False), ("C", 2, False)]
    assert rows(tree(spark, [("B", "A"), ("B", "A")], "A", 0)) == [("B", 1, False)] * 2
    assert rows(tree(spark, [], "A", 3)) == []


@pytest.mark.parametrize("pairs, want", [([("A", "R"), ("B", "R"), ("B", "A"), ("C", "B")], 2), ([("B", "R"), ("A", "R"), ("B", "A"), ("C", "B")], 3)])
def test_affected_depends_on_order(spark, pairs, want):
    got = callers.impact_summary(tree(spark, pairs, "R", 2)).first()
    assert (got["direct_callers"], got["total_affected"]) == (2, want)


@pytest.mark.parametrize("seed", range(4))
def test_trees_against_plain_python(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(6)}", f"n{rng.randrange(6)}") for _ in range(9)]
    want = plain_tree(pairs, "n0", 4)
    got = tree(spark, pairs, "n0", 4)
    assert rows(got) == list(flat(want))
    if want:
        metrics = spark.createDataFrame([(f"n{i}", float(i)) for i in range(4)], "id string, f double")
        summary = callers.impact_summary(got, metrics).first()
        met = set()
        assert (summary["direct_callers"], summary["total_affected"]) == (len(want), affected(want, met))
        assert summary["combined_f"] == sum(float(n[1]) for n in met if n < "n4")


def test_rooted_tree(spark):
    roots = spark.createDataFrame([("A",)], "root string")
    e = edges(spark, [("B", "A"), ("A", "B")])
    assert rows(callers.rooted_tree(roots, e, 0)) == [("A", 0, False)]
    assert rows(callers.rooted_tree(roots, e, 3)) == [("A", 0, False), ("B", 1, False), ("A", 2, True)]


def test_edges(spark):
    calls = spark.createDataFrame([(0, "a", ["a", "b", "b"])], "ord int, caller string, callees array<string>")
    assert [r["callee"] for r in graph.edges_from_callees(calls).collect()] == ["b", "b"]
    e = edges(spark, [("A", "X"), ("A", "X"), ("B", "X")])
    assert graph.callers_of(e).first()["callers"] == ["A", "A", "B"]
    assert graph.distinct_edges(e).count() == 2
    r = graph.rank(e)
    assert graph.has_converged(r, r) and not graph.has_converged(r, r.withColumn("r", r.r + 1), 1.0)


def test_layout_of_a_small_tree(spark):
    metrics = spark.createDataFrame([("A", "fa", 5.0, "file:///s/x.ts"), ("B", "fb", 2.0, "file:///t/x.ts")], "id string, name string, f double, uri string")
    nodes = callers.layout_nodes(tree(spark, [("B", "A"), ("C", "A")], "A", 2), metrics)
    got = {r["id"]: (r["label"], r["f"], r["file"], r["x"], r["y"]) for r in nodes.collect()}
    assert got == {"A": ("fa", 5.0, "x.ts", 210.0, 100.0), "B": ("fb", 2.0, "x.ts", 100.0, 240.0), "C": ("C", 0.0, "", 320.0, 240.0)}
    box = callers.file_groups(nodes).first()
    assert (box["node_ids"], box["x"], box["y"], box["width"], box["height"]) == (["A", "B"], 70.0, 70.0, 170.0, 200.0)
    assert callers.layout_size(nodes).first()[1:] == (420.0, 340.0)


@pytest.mark.parametrize("seed", range(4))
def test_ordered_walk_against_recursion(spark, seed):
    """Several roots at once, ids that repeat at all depths, equal edges, cycles."""
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(16)]
    pairs = [(a, b) for a, b in pairs if a != b]
    roots = ["n0", "n1", "n2"]
    tree = callers.caller_tree(spark.createDataFrame([(r,) for r in roots], "root string"), edges(spark, pairs), 4)
    got = {r["root"]: r["count"] for r in callers.counted_nodes(tree).groupBy("root").count().collect()}
    want = {r: affected(plain_tree(pairs, r, 4), set()) for r in roots}
    assert got == {r: n for r, n in want.items() if n}


def test_ordered_walk_of_a_large_tree(spark):
    """One root with 120,000 nodes: 300 callers, each with the same 400, of which each counts once, below the first."""
    first = [(k, f"a{k}", "R") for k in range(300)]
    second = [(300 + k * 400 + j, f"b{j}", f"a{k}") for k in range(300) for j in range(400)]
    found = callers.caller_tree(spark.createDataFrame([("R",)], "root string"), spark.createDataFrame(first + second, EDGES), 2)
    kept = callers.counted_nodes(found)
    assert kept.count() == 700
    assert {tuple(r["path"])[0] for r in kept.where("depth = 2").collect()} == {0}
    assert "Pandas" not in kept._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed", range(3))
def test_compact_trees_count_paths(spark, seed):
    """Graphs with cycles, self-calls and equal edges: as many nodes as the tree with all paths has."""
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(8)}", f"n{rng.randrange(8)}") for _ in range(14)] + [("n0", "n0")] * seed
    roots = spark.createDataFrame([("n0",), ("n1",), ("none",)], "root string")
    for depth in (0, 4):
        want = {}
        for r in callers.caller_tree(roots, edges(spark, pairs), depth).collect():
            key = r["root"], r["id"], r["depth"], r["recursive"]
            want[key] = want.get(key, 0) + 1
        got = {(r["root"], r["id"], r["depth"], r["recursive"]): int(r["n"]) for r in callers.compact_tree(roots, edges(spark, pairs), depth).collect()}
        assert got == want


def test_compact_tree_of_many_paths(spark):
    """Twelve layers of ten nodes, each called by all of the next: 10^12 paths in 120 rows."""
    pairs = [(f"l{k + 1}_{a}", f"l{k}_{b}") for k in range(11) for a in range(10) for b in range(10)] + [(f"l0_{b}", "root") for b in range(10)]
    found = callers.compact_tree(spark.createDataFrame([("root",)], "root string"), edges(spark, pairs), 12)
    rows = found.collect()
    assert len(rows) == 120 and sum(int(r["n"]) for r in rows if r["depth"] == 12) == 10**12 and sum(int(r["n"]) for r in rows if r["depth"] == 1) == 10
    size = callers.layout_size(callers.level_sizes(found)).first()
    assert (size["width"], size["height"]) == (200 + (10.0**12 - 1) * 220, 200 + 12 * 140)


def test_rank_tells_nodes_apart_whose_hashes_are_equal(spark, monkeypatch):
    """Another hash is taken where two ids share one; repeated edges count once whichever it is."""
    real = graph.node_hash
    monkeypatch.setattr(graph, "node_hash", lambda id_, seed: F.length(id_).cast("long") if seed < 2 else real(id_, seed))
    pairs = [("a", "b"), ("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("c", "c")]
    assert ranks(spark, pairs, max_iterations=5) == pytest.approx(plain_rank(pairs, 5, 1e-6))


def test_rank_deals_edges_once(spark, monkeypatch):
    """Edges are bucketed from one exchange, by their callers: no joins with names, no exchange for leaving out repetitions."""
    plans, bucketed = [], graph.Scratch.bucketed

    def watched(self, df, *args, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return bucketed(self, df, *args, **options)

    monkeypatch.setattr(graph.Scratch, "bucketed", watched)
    assert {r["id"]: r["r"] for r in graph.rank(edges(spark, [("a", "b"), ("a", "b"), ("b", "c")])).collect()} == {"a": 1, "b": 2, "c": 3}
    assert plans[0].count("Exchange") == 1 and "Join" not in plans[0]


def test_rank_settled_nodes_send_nothing(spark):
    """A node that doesn't move keeps its rank by its own row, and its edges don't reach the exchange."""
    given = spark.createDataFrame([(0, 0, 0.0), (1, 1, 0.0), (2, 2, 0.0), (0, 1, 0.5), (0, 2, 0.5), (1, 2, 1.0)], "k long, v long, share double")
    state = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.5, 0.5), (2, 2.5, 1.5)], "k long, r double, d double")
    assert {tuple(r) for r in graph.stepped(given, state).collect()} == {(0, 1.0, 0.0), (1, 1.5, 0.0), (2, 3.0, 0.5)}


def test_rank_partitions_grow_slower_than_their_square(spark):
    """Cores are busy with few edges; a hundred times the edges aren't ten thousand times the blocks of an exchange."""
    assert [graph.partitions(n, 12) for n in (1, 7_200_000, 72_000_000, 432_000_000)] == [1, 36, 72, 432]


def test_rank_moves_no_edges_when_peeling(spark, monkeypatch):
    """What is left after a peel stays in its buckets, and what the peeled nodes give isn't summed again."""
    plans, bucketed = [], graph.Scratch.bucketed

    def watched(self, df, key, buckets, name, dealt=False):
        plans.append((dealt, df._jdf.queryExecution().executedPlan().toString()))
        return bucketed(self, df, key, buckets, name, dealt)

    monkeypatch.setattr(graph.Scratch, "bucketed", watched)
    pairs = [(f"c{k}", f"c{k + 1}") for k in range(9)]
    assert {r["id"]: r["r"] for r in graph.rank(edges(spark, pairs)).collect()} == {f"c{k}": k + 1 for k in range(10)}
    assert len(plans) > 1 and all(dealt and "Exchange hashpartitioning" not in plan and "Aggregate" not in plan for dealt, plan in plans[1:])
