import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import codes, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    """Everything in Python's integers: ({id: (code, error)}, codebooks)."""
    fine = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[int(np.floor(float(np.float32(x)) * 1024)) for x in r[1]] for r in fine]
    width = len(vectors[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in vectors]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(best(c[p], books[p]), []).append(c[p])
            books[p] = [[sum(y) // len(held[k]) for y in zip(*held[k], strict=True)] if k in held else b for k, b in enumerate(books[p])]
    found = []
    for r, c in zip(fine, cut, strict=True):
        ks = [best(c[p], books[p]) for p in range(parts)]
        found.append((r[0], bytes(ks).hex(), sum(far(c[p], books[p][k]) for p, k in enumerate(ks))))
    return sorted(found, key=str), books


@pytest.mark.parametrize("seed, spread, entries", [(0, 1.0, 16), (1, 0.004, 16), (2, 3000.0, 9), (3, 1.0, 256)])
def test_against_python_integers(spark, seed, spread, entries):
    rng = random.Random(seed)
    rows = [(rng.randrange(200), [rng.gauss(0, spread) for _ in range(12)], rng.choice([0, 1, None])) for _ in range(150)]
    rows += [rows[0], rows[0], (None, [0.5] * 12, 3), (7, None, 1), (8, [0.1] * 11 + [None], 1), (-5, [float("nan")] * 12, 1), (-6, [0.0] * 11 + [float("-inf")], None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    books = codes.trained(df, entries=entries, rounds=3)
    want, wanted = brute(rows, 4, entries, 3)
    assert books.books.tolist() == wanted
    got = codes.coded(df, books, keep=["vec_id"]).collect()
    assert sorted([tuple(r) for r in got], key=str) == want


def test_screening_finds_ties_and_near_ties():
    """Large components, where float32 can't tell entries apart: integers decide, and of equal distances the first."""
    rng = np.random.default_rng(0)
    for scale in (3, 1000, 1 << 22, 1 << 26):
        base = rng.integers(-scale, scale + 1, (1, 16))
        book = np.concatenate([base + rng.integers(-2, 3, (60, 16)), rng.integers(-scale, scale + 1, (40, 16))])
        book[30] = book[5]
        x = np.concatenate([book, base + rng.integers(-2, 3, (300, 16))])
        exact = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (codes.nearest(x, book) == exact.argmin(1)).all()


def test_bound_covers_float32_products():
    """Scores in float32 never leave the interval that `nearest` uses; it is checked on products summed in several orders."""
    rng = np.random.default_rng(1)
    for scale in (10, 10**5, 1 << 26):
        x, c = rng.integers(-scale, scale + 1, (200, 16)), rng.integers(-scale, scale + 1, (50, 16))
        true = (c * c).sum(1)[None] - 2 * (x.astype(object) @ c.T.astype(object))
        n = 18
        gamma = n * 2.0**-24 / (1 - n * 2.0**-24)
        own, far = np.sqrt((x * x).sum(1).astype(float)), np.sqrt((c * c).sum(1).max())
        bound = (2 * gamma + 4 * 2.0**-24) * own * far + 4 * 2.0**-24 * far * far
        for order in (np.arange(16), np.arange(16)[::-1], rng.permutation(16)):
            a, b = x[:, order].astype(np.float32), c[:, order].astype(np.float32)
            dot = np.zeros((200, 50), np.float32)
            for j in range(16):
                dot += a[:, j : j + 1] * b[:, j][None]
            score = (c * c).sum(1).astype(np.float32)[None] - 2 * dot
            assert (np.abs(score.astype(object) - true).astype(float) <= bound[:, None]).all()


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    books = codes.trained(empty)
    assert codes.coded(empty, books).columns == ["vec_id", "embedding", "label", "code", "error"] and codes.coded(empty, books).count() == 0
    rows = [(1, [1.0] * 8, 0), (1, [1.0] * 8, 0), (2, [2.0] * 7, 0), (3, [1e30] * 8, 0), (4, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"code": F.lit(9), "row": F.lit(8), "vector": F.lit(7)})
    got = codes.coded(df, codes.trained(df)).collect()
    assert [(r["vec_id"], r["code"], r["error"], r["row"], r["vector"]) for r in got] == [(1, "00000000", 0, 8, 7)] * 2
    with pytest.raises(ValueError):
        codes.trained(spark.createDataFrame([(1, [1.0] * 6, 0)], SCHEMA))
    assert codes.limit(64) == 1 << 27


def test_query_sums_by_label(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, [rng.random() for _ in range(8)], (0, 1, None)[k % 3]) for k in range(400)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op13_exact_vector_codes(spark, str(tmp_path)).collect()
    label = {r[0]: r[2] for r in rows}
    sums = {}
    for r in got:
        sums[label[r["vec_id"]]] = sums.get(label[r["vec_id"]], 0) + r["error"]
    assert len(got) == 400 and all(r["label_error"] == sums[label[r["vec_id"]]] for r in got)
    assert len({r["codebooks_sha256"] for r in got}) == 1
