import hashlib

import pytest
from pyspark.sql import functions as F

from riskweave.llm import warc


def rows_of(spark, pages):
    return spark.createDataFrame(pages, "id long, url string, payload string")


def inner_record(i):
    return f"{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


PAGES = [
    (1, "http://a/\r\nX: y", "x" * 1000),
    (2, None, "x" * 1000),
    (3, "u", None),
    (4, "u", ""),
    (5, "u", "short"),
    (6, "u", "short"),
    (7, "u", inner_record(99) * 40),  # whole records inside a payload
    (8, "u", f"text {warc.MAGIC} {warc.END}{warc.MAGIC}more"),
    (9, "u", warc.MAGIC),
    (10, "u", "é" * 5000 + "\r\n\r\n\r\n\r\n"),
    (11, "u", "x" * 1000),
    (12, "u", "\n".join(str(k) for k in range(20000))),
]


@pytest.mark.parametrize("split", ["128m", "4k", "997b"])
def test_round_trip_keeps_every_page(spark, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r["record"]: r for r in warc.round_trip(rows_of(spark, PAGES).coalesce(1)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(PAGES)
    for i, _, payload in PAGES:
        body = (payload or "").encode()
        r = got[f"<urn:page:{i}>"]
        assert (r["bytes"], r["digest"], r["digest_ok"]) == (len(body), hashlib.sha1(body).hexdigest(), True), i
        assert (r["kind"], r["refers"]) == (("revisit", "<urn:page:11>") if i in (1, 2) else ("response", None))


def test_no_pages(spark):
    assert warc.round_trip(rows_of(spark, [])).count() == 0


def test_cut_and_broken_files(spark, tmp_path):
    whole = inner_record(1).replace("abc", "xyz")
    cut = f"{whole}{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:2>\r\nContent-Length: 50\r\n\r\nends early"
    lost = f"no archive\n{whole}"
    for name, text in (("a.warc", cut), ("b.warc", lost)):
        (tmp_path / name).write_bytes(text.encode())
    got = warc.read_archives(spark, str(tmp_path)).orderBy("record").collect()
    assert [(r["record"], r["digest_ok"]) for r in got] == [("<urn:page:1>", True), ("<urn:page:2>", False)]


def test_hot_payload_is_joined_once(spark):
    kinds = warc.record_kinds(rows_of(spark, [(i, "u", "y" * 2000) for i in range(500)]))
    assert kinds.groupBy("kind").count().orderBy("kind").collect() == [("response", 1), ("revisit", 499)]
    assert kinds.where(F.col("kind") == "revisit").select("refers").distinct().collect() == [(499,)]
