import random

import pytest

import corpus_pipeline as C
from riskweave.llm import near_copies, pseudonyms, queries
from riskweave.llm.common import shared_dir

from .test_decontaminate import brute as hits
from .test_models import quality_corpus
from .test_near_copies import brute as components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = quality_corpus(900)
    rng = random.Random(2)
    item = " ".join(f"item{k}" for k in range(20))
    rows[0] = (0, f"{rows[0][1]} {item} +1 (743) 555-3824")
    rows[5] = (5, f"{rows[5][1]} mail a.b@c.example.com")
    more = [(1000 + k, rows[10 * k][1] + ("" if k % 2 else " end")) for k in range(1, 30)] + [(2000, None), (2001, ""), (None, "no id at all"), (2002, "word " * 3000)]
    rows += more
    rng.shuffle(rows)
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(g), 0) for i, g in labels[:700]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = []
    for (name, stage), columns in zip(C.STAGES, [docs.columns] * 4 + [None]):
        out = stage(spark, docs, folder)
        if columns:
            assert out.columns == columns, name
        out.write.parquet(path := f"{shared_dir(spark)}/test-{name}")
        held.append((docs, docs := spark.read.parquet(path)))
    (raw, good), (_, unique), (_, clean), (_, private), (_, packed) = held
    bad = {i for i, g in quality_corpus(900)[1] if not g}
    left = {i for i, _ in texts_of(good)}
    assert len(left & bad) <= 3 and len(left - bad) >= 0.98 * (raw.count() - len(bad)) and {2000, 2001} <= left
    want = components([(i, t) for i, t in texts_of(good) if i is not None])
    assert {i for i, _ in texts_of(unique)} == {i for i, (_, c) in want.items() if i == c} | {i for i in left if i is None}
    gone = {d for d, n, h, _ in hits([x for x in texts_of(unique)], [(1, " ".join(f"item{k}" for k in range(20)))]) if h and 20 * h >= n}
    assert gone == {0} & {i for i, _ in texts_of(unique)} and {i for i, _ in texts_of(clean)} == {i for i, _ in texts_of(unique)} - gone
    p = pseudonyms.Pseudonyms(queries.DEMO_KEY)
    assert dict(texts_of(private)) == {i: p.replaced(t)[0] for i, t in texts_of(clean)}
    assert not private.where("text like '%a.b@c.example.com%'").count() and private.where("length(text) <> n_chars").count() == 0
    assert packed.where("doc_id = 2002 and length > 2048").count() == 0 and packed.select("doc_id").distinct().count() == private.select("doc_id").distinct().count()
    again = C.run(spark, folder)
    assert again.count() == packed.count() and again.select("doc_id", "piece", "ids_crc32").exceptAll(packed.select("doc_id", "piece", "ids_crc32")).count() == 0


def test_copies_go_by_row(spark, tmp_path):
    """Null and repeated ids: of each group one row stays, that with the smallest id, and unique texts stay whatever their ids."""
    same, other, third = "a b c d e f g", "h i j k l m n", "o p q"
    rows = [(5, same), (5, other), (3, same), (None, same), (None, other), (None, third), (None, third), (7, None), (7, None), (8, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = sorted(map(tuple, C.deduplicated(spark, docs, str(tmp_path)).collect()), key=str)
    assert left == sorted([(3, same), (5, other), (None, third), (7, None), (7, None), (8, "alone here")], key=str)


def test_copies_go_without_a_copy_of_the_documents(spark, tmp_path, monkeypatch):
    """No scratch table of the stage holds the texts; rows that are equal in all columns are one, those that differ in a null are not."""
    same = "a b c d e f g"
    rows = [(None, same, None, "s"), (None, same, None, "s"), (None, same, "s", None), (1, "h i j k l", "x", "y"), (1, "h i j k l", "x", "y"), (2, " ", "x", "y"), (2, " ", "x", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(path := f"{tmp_path}/docs")
    tables, once = [], C.Tables.write

    def write(self, df, name):
        tables.append((name, df.columns))
        return once(self, df, name)

    monkeypatch.setattr(C.Tables, "write", write)
    left = [tuple(r) for r in C.deduplicated(spark, spark.read.parquet(path), str(tmp_path)).collect()]
    assert tables and not [name for name, columns in tables if "text" in columns]
    assert sorted(r[0] or 0 for r in left) == [0, 1, 2, 2] and {r[1] for r in left} == {same, "h i j k l", " "} and all(r in rows for r in left)


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in C.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names) and near_copies.SHINGLE == 5
