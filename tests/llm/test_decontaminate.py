import random
import re

import pytest

from riskweave.llm import decontaminate

ITEMS = "item_id long, text string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = [(tuple(w[k : k + 13]), i) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - 12))]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for x, i in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found.add(i)
        out.append((d, len(w), len(hit), sorted(found, key=str)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = "the of and Ä ñu rat lo mi ka x1 22".split()
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(10 * i, text(rng.choice([1, 3, 12, 13, 14, 30]))) for i in range(8)] + [(3, None), (4, " !"), (5, "rare Word")]
    docs = [(None, "rare-WORD"), (0, None), (1, ""), (2, "..."), (2, "...")]
    for d in range(10, 40):
        t = text(rng.randrange(60))
        if d % 3 == 0:
            t = f"{t} {rng.choice(items)[1]} {text(5)}".upper().replace(" ", rng.choice([" ", ", ", "\n"]))
        docs.append((d, t))
    return docs, items


@pytest.mark.parametrize("seed, item_words, block_words", [(0, 10**6, 200_000), (1, 10**6, 60), (2, 10**6, 1)])
def test_against_brute_force(spark, seed, item_words, block_words):
    docs, items = corpus(seed)
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, ITEMS), 13, item_words, block_words)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()), key=str) == brute(docs, items)


def test_many_item_blocks_unite_their_hits(spark):
    docs, items = corpus(3)
    docs = [(d, t) for d, t in docs if d is not None and d != 2]
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), item_words=20)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], ITEMS)
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    assert [tuple(r)[:4] for r in decontaminate.decontaminate(docs, items.limit(0)).collect()] == [(1, 2, 0, [])]


def test_matches_and_rule(spark):
    plan = decontaminate.Plan([(7, "p q r s"), (8, "q r")])
    docs = spark.createDataFrame([(1, "p q r s. x Q R; r . q")], "doc_id long, text string")
    found = decontaminate.matches(decontaminate.build_index(docs, plan), plan, near_terms=2, near_span=3)
    phrases = {(r["item_id"], r["start"], r["length"]) for r in found.where("kind = 'phrase'").collect()}
    assert phrases == {(7, 0, 4), (8, 1, 2), (8, 5, 2)}
    assert {r["item_id"] for r in found.where("kind = 'near'").collect()} == {7, 8}
    rule = spark.createDataFrame([(0, 0), (1, 20), (1, 21), (2, 40)], "n_hit long, n_words long").select(decontaminate.contaminated().alias("c"))
    assert [r["c"] for r in rule.collect()] == [False, True, False, True]


def test_near_copies_of_items_with_a_replaced_word(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta"), (2, "kappa lambda"), (3, "absent sigma nowhere else"), (4, "never seen")]
    rows = [(1, "x alpha beta gamma other epsilon zeta y"), (2, "lambda of kappa"), (3, "sigma"), (4, "alpha beta " + "y " * 60 + "epsilon zeta gamma")]
    plan, docs = decontaminate.Plan(items), spark.createDataFrame(rows, "doc_id long, text string")
    index = decontaminate.build_index(docs, plan)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(index, plan).where("kind = 'near'").collect()} == {(1, 1), (2, 2)}
    assert {r["doc_id"]: r["n_near"] for r in decontaminate.verdicts(index, plan).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_null_and_repeated_ids_are_judged_each(spark, tmp_path):
    import corpus_pipeline

    items = [(1, "alpha beta gamma"), (2, "delta epsilon zeta")]
    rows = [(None, "alpha beta gamma"), (None, "clean"), (5, "delta epsilon zeta"), (5, "also clean"), (5, "x alpha beta gamma"), (5, None), (5, "also clean")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, ITEMS)
    found = decontaminate.decontaminate(docs, bench, item_words=3)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()), key=str) == brute(rows, items)
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(None, "clean"), (5, "also clean"), (5, None), (5, "also clean")], key=str)


def test_one_stored_index_answers_for_any_items(spark):
    """The index is built without items; several item blocks, with rows of null and repeated ids and a very long text, equal brute force."""
    docs, items = corpus(4)
    docs.append((77, "the of and " * 20_000 + " rare word"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    index = decontaminate.build_index(df, None, 100)
    for some in (items[:4], items[4:]):
        got = decontaminate.verdicts(index, decontaminate.Plan(some)).collect()
        short = [(d, t) for d, t in docs if d != 77]
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got if r["doc_id"] != 77), key=str) == brute(short, some)
    whole = decontaminate.decontaminate(df, spark.createDataFrame(items, ITEMS), item_words=25).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in whole if r["doc_id"] != 77), key=str) == brute(short, items)
    assert [(r["n_words"], 5 in r["item_ids"]) for r in whole if r["doc_id"] == 77] == [(60_002, True)]


def test_batches_for_python_are_small(spark):
    """Tables are written with batches of bounded bytes, as index blocks are large; the session's setting stays as it was."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from riskweave.llm import common

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes], pa.int64())], ["n"])

    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).cast("binary").alias("b"))
    before = spark.conf.get(common.BATCH)
    found = common.written(rows.mapInArrow(sizes, "n long"), "sizes")
    assert found.agg(F.max("n")).first()[0] <= common.BATCH_BYTES + (2 << 20)
    assert spark.conf.get(common.BATCH) == before
