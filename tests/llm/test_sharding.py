import collections
import random

import pytest

from riskweave.llm import sharding


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, _src int").repartition(3)


@pytest.mark.parametrize("n, shards, slice_rows", [(1000, 40, 2000), (1000, 40, 7), (997, 8, 100), (5, 40, 2)])
def test_every_shard_has_the_mixture(spark, n, shards, slice_rows):
    rng = random.Random(n)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), 1) for i in range(n)]
    got = sharding.interleave(rows_of(spark, rows), shards, "s", slice_rows).collect()
    assert sorted(r["id"] for r in got) == list(range(n)) and got[0]["_src"] == 1
    held = collections.defaultdict(list)
    for r in got:
        held[r["shard"]].append(r)
    sizes = [len(held[s]) for s in range(shards)]
    assert set(held) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in held.values())
    whole = collections.Counter(r[1] for r in rows)
    for x in held.values():
        mix = collections.Counter(r["source"] for r in x)
        assert all(abs(mix[s] - whole[s] / shards) <= 1.0001 * len(whole) for s in whole)


def test_slices_do_not_change_the_order(spark):
    rows = [(i, "ab"[i % 3 == 0], 0) for i in range(300)]
    a, b = ({r["id"]: (r["shard"], r["slot"]) for r in sharding.interleave(rows_of(spark, rows), 7, "x", k).collect()} for k in (11, 5000))
    assert a == b
    assert a != {r["id"]: (r["shard"], r["slot"]) for r in sharding.interleave(rows_of(spark, rows), 7, "y").collect()}


def test_odd_rows(spark, tmp_path):
    assert sharding.interleave(rows_of(spark, []), 4).count() == 0
    got = sharding.interleave(rows_of(spark, [(None, None, 1), (None, None, 1), (3, "", 1), (3, "", 1)]), 2)
    assert sorted((r["shard"], r["slot"]) for r in got.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    with pytest.raises(ValueError):
        sharding.interleave(got, 0)
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "doc_id long, text string")
    placed = sharding.interleave(rows_of(spark, [(i, "s", 0) for i in range(20)]), 4).withColumnRenamed("id", "doc_id")
    sharding.write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 20 and back.select("shard").distinct().count() == 4
