import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import components, near_copies

from .conftest import texts


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    return {r["doc"]: (r["n_shingles"], r["component_id"]) for r in near_copies.near_copies(df, **options).collect()}


@pytest.mark.parametrize("seed, frequent", [(0, 50), (1, 1), (2, 3)])
def test_against_brute_force(spark, seed, frequent):
    rows = list(enumerate(texts(seed, 70)))
    random.Random(seed).shuffle(rows)
    assert run(spark, rows, frequent=frequent) == brute(rows)


def test_chain_and_boundary(spark):
    words = [f"w{i}" for i in range(64)]
    # 60 shingles each; a shift by k leaves 60 - k in common: linked while 100 (60 - k) >= 80 (60 + k)
    rows = [(k, " ".join(words[k:] + [f"x{j}" for j in range(k)])) for k in (0, 6, 12, 18)]
    rows += [(100, " ".join(words[:-7] + [f"y{j}" for j in range(7)]))]
    assert run(spark, rows) == brute(rows)


def test_empty_and_repeated_rows(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (2, None)]) == {1: (1, 1), None: (1, 1), 2: (0, 2)}


def test_set_algebra():
    s = near_copies.Shingler()
    assert len(s.set_of("a b c d")) == 1 and len(s.set_of("a b c d e f")) == 2 and not len(s.set_of(" "))
    assert near_copies.linked(s.set_of("A b c"), s.set_of("a B  C")) and not near_copies.linked(s.set_of("a b c"), s.set_of("a b d"))
    a, b = s.set_of(" ".join(map(str, range(300)))), s.set_of(" ".join(map(str, range(20, 320))))
    differ = sum(int(x).bit_count() for x in near_copies.parities(a).view(np.uint64) ^ near_copies.parities(b).view(np.uint64))
    assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_sets_are_sorted_and_distinct_and_no_words_are_kept():
    s = near_copies.Shingler()
    found = s.set_of("a b c d e " * 50 + "f")
    assert found.tolist() == sorted(set(found.tolist())) and len(found) == 6
    assert vars(s) == {"words": near_copies.SHINGLE}  # workers' memory doesn't grow with the words they meet


def test_whole_sets_are_not_exchanged_for_the_first_side_of_pairs(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    whole = spark.createDataFrame([(k, k, [k]) for k in (1, 2, 3)], "cls long, n int, tokens array<long>")
    verify = near_copies.Verifier(pairs, pairs, None, 80, None)
    verify.whole = whole
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = verify._with(pairs, "a", ["n"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.select("a", "b", "a_n").collect())) == [(1, 2, 1), (1, 3, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = collections.defaultdict(lambda: None)
    neighbours = collections.defaultdict(set)
    for a, b in pairs:
        if a != b:
            neighbours[a].add(b)
            neighbours[b].add(a)
    for start in sorted(neighbours):
        todo = [start]
        while todo:
            x = todo.pop()
            if parent[x] is None:
                parent[x] = start
                todo += neighbours[x]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in parent.items() if v is not None}


def test_only_long_lists_meet_again_and_components_are_broadcast(spark):
    """A list of two, one of three in two components, and one of two that is dealt over two parts: centres stand beside, only long lists meet again."""
    rows = [(1, 0, 1, 10, 90, 0, 2, 10, 90, 0), (1, 0, 1, 11, 90, 1, 2, 10, 90, 0)]
    rows += [(2, 0, 1, c, 90, k, 3, 10, 90, 0) for k, c in enumerate((10, 11, 12))] + [(3, 0, 2, 20, 90, 0, 1, 20, 90, 0), (3, 1, 2, 21, 90, 1, 1, 21, 90, 1)]
    postings = spark.createDataFrame(rows, "token long, salt int, parts int, cls long, n int, at int, met long, c_cls long, c_n int, c_at int")
    comps = spark.createDataFrame([(10, 10), (11, 10)], "node long, label long")

    class Made:
        def write(self, df, name):
            return df

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert sorted(map(tuple, near_copies._central_offers(postings, 80).select("a", "b").collect())) == [(11, 10), (11, 10), (12, 10), (21, 20)]
        members, main = near_copies._open_lists(postings, comps, Made())
        assert sorted((r["token"], r["main"]) for r in main.collect()) == [(2, 10)] and sorted(r["cls"] for r in members.collect()) == [10, 11, 12]
        assert "hashpartitioning(cls" not in members._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)



def test_no_edges(spark):
    assert components.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_hot_group_makes_few_pairs(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc long, text string").repartition(4)
    assert near_copies.near_copies(df).agg(F.countDistinct("component_id")).first()[0] == 1


def test_candidates_grow_with_the_group_and_not_with_its_square(spark, monkeypatch):
    """One group of near copies at the edge of the similarity, one passage in many other texts, one very long text in two versions."""
    passage = " ".join(f"p{i}" for i in range(30))
    long = " ".join(f"long{i % 997}x{i}" for i in range(30_000))
    for n in (60, 120):
        rng, words = random.Random(n), [f"w{i}" for i in range(150)]
        rows = [(3 * i, " ".join(f"e{i}" if rng.random() < 0.015 else w for w in words)) for i in range(n)]
        rows += [(3 * i + 1, " ".join([f"a{i}x{k}" for k in range(50)] + [passage] + [f"b{i}x{k}" for k in range(20)])) for i in range(n)]
        rows += [(100_000, long), (100_001, f"{long} end"), (None, rows[0][1]), (8, rows[0][1]), (8, "another text under the same id")]
        pairs, once = [], near_copies.Verifier.test

        def test(self, offers):
            before = 0 if self.tested is None else self.tested.count()
            found = once(self, offers)
            pairs.append((0 if self.tested is None else self.tested.count()) - before)
            return found

        monkeypatch.setattr(near_copies.Verifier, "test", test)
        df = spark.createDataFrame(rows, "doc long, text string").repartition(3)
        got = near_copies.near_copies(df, frequent=20).collect()
        monkeypatch.setattr(near_copies.Verifier, "test", once)
        want = brute([(i, t) for i, t in rows if i not in (None, 8)])
        assert {r["doc"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc"] not in (None, 8)} == want
        assert [(r["component_id"]) for r in got if r["doc"] is None] == [want[0][1]] and sorted(r["component_id"] for r in got if r["doc"] == 8) == [want[0][1], 8]
        assert 0 < sum(pairs) <= 5 * n  # all pairs of the group are 30 and 60 a member


def test_links_through_rows_without_an_id(spark):
    words = [f"w{i}" for i in range(64)]
    rows = [(5, " ".join(words)), (None, " ".join(words[6:] + [f"x{j}" for j in range(6)])), (9, " ".join(words[12:] + [f"x{j}" for j in range(12)])), (None, "alone here"), (None, "alone here")]
    got = sorted(((r["doc"], r["component_id"]) for r in near_copies.near_copies(spark.createDataFrame(rows, "doc long, text string")).collect()), key=str)
    assert got == sorted([(5, 5), (None, 5), (9, 5), (None, None), (None, None)], key=str)
