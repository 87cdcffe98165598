import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from riskweave.sources import files, listing


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("tree")
    names = ["a.ts", "a/x.ts", "a-b/y.ts", "a.b/z.ts", "_app.tsx", "__init__.py", "_lib/c.ts", "__tests__/b.ts", ".dot/d.ts", ".e.ts", "node_modules/n.js", "deep/node_modules/m.js", "deep/er/and/er/f.py", "notes.md", "ts", "é/ü.ts", "a b/c d.ts"]
    names += [f"many/f{k:03d}/g.ts" for k in range(90)]
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"// {name}\n")
    os.symlink(tmp_path, tmp_path / "loop")
    (tmp_path / "empty").mkdir()
    return str(tmp_path), names


def test_all_names_are_listed_in_order(spark, tree):
    root, names = tree
    wanted = sorted(n for n in names if n.endswith((".ts", ".tsx", ".js", ".py")) and "node_modules/" not in n)
    for dots, want in ((True, wanted), (False, [n for n in wanted if not n.startswith(".")])):
        found = listing.listed(spark, root, r"\.(ts|tsx|js|py)$", ("node_modules",), dots)
        assert sorted(r["path"][len(root) + 1 :] for r in found.collect()) == want
    for limit in (1, 7, 95, 1000):
        found = listing.listed(spark, root, r"\.(ts|tsx|js|py)$", ("node_modules",), True, limit)
        assert [r["path"][len(root) + 1 :] for r in found.orderBy("path").collect()] == wanted[:limit]


def test_folders_are_dealt_over_tasks(spark, tree):
    root, _ = tree
    reader = listing.FolderReader({"path": root, "pattern": r"\.ts$", "limit": "3"})
    parts = reader.partitions()
    assert 8 < len(parts) <= listing.TASKS
    given = [[x for batch in reader.read(p) for x in batch.column(0).to_pylist()] for p in parts]
    assert len(listing.FolderReader({"path": f"{root}/_lib", "pattern": ""}).partitions()) == 1
    assert max(map(len, given)) <= 3 and all(x == sorted(x) for x in given)  # a task stops when it has given enough


def test_no_folder_and_urls(spark, tree):
    root, _ = tree
    assert listing.listed(spark, f"{root}/none", "").count() == 0
    assert listing.listed(spark, f"{root}/empty", "").count() == 0
    assert listing.listed(spark, f"file://{root}/", r"_app\.tsx$").first()["path"].endswith("/_app.tsx")


def test_only_what_is_left_is_opened(spark, tree):
    root, _ = tree
    found = files.found_paths(spark, root, 400)
    opened = Observation()
    read = listing.contents(found.observe(opened, F.count("*").alias("n")), root)
    rows = read.collect()
    assert opened.get["n"] == len(rows) == found.count()
    assert not any("__tests__" in r["path"] for r in rows) and any(r["path"].endswith("/__init__.py") for r in rows)
    assert {bytes(r["content"]).decode() for r in rows} == {f"// {r['path'][len(root) + 1:]}\n" for r in rows}


def test_files_that_are_gone_are_left_out(spark, tmp_path):
    (tmp_path / "a.ts").write_bytes(b"\xff\x00\n")
    (tmp_path / "b.ts").write_text("")
    paths = spark.createDataFrame([(f"{tmp_path}/{n}", k) for k, n in enumerate(("a.ts", "b.ts", "c.ts"))], "path string, content_ int")
    got = listing.contents(paths, str(tmp_path)).orderBy("path").collect()
    assert [(bytes(r["content"]), r["content_"]) for r in got] == [(b"\xff\x00\n", 0), (b"", 1)]


def test_files_are_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{k % 3}/_{k}.txt", f"é{k}") for k in range(20)], "path string, text string").repartition(4)
    assert listing.written_files(rows, str(tmp_path)) == 20
    assert (tmp_path / "d2/_5.txt").read_text() == "é5"


def test_scope_and_editor(spark, tree):
    root, _ = tree
    uris = lambda **o: {r["uri"][len(f"file://{root}/") :] for r in files.discover(spark, root, **o).collect()}
    assert uris(scope=f"{root}/_lib") == {"_lib/c.ts"}
    assert ".dot/d.ts" in uris(editor=True) and ".dot/d.ts" not in uris() and "deep/node_modules/m.js" not in uris(editor=True)
    assert "__tests__/b.ts" in uris(exclude_tests=False)
