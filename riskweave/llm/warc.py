"""WARC archives written and read by Spark's own text source, with boundary-chain verification.

Writing: a record is a row of text, and the text writer's line separator is the CR LF CR LF that ends a record, so that the
files are plain WARC/1.0, written through Spark's committer to any file system.  Records with equal payloads of at least min_bytes
become revisits of the one with the largest id.

Reading: the files are split at every occurrence of the magic "WARC/1.0 CR LF", whether it starts a record or stands in a payload,
so files of any size are read in parallel.  For each occurrence a task parses what follows as a header and emits the candidate and
its successor, the place where the next record must start.  A task follows the chain inside its own block; what is left is a
pointer from block to block.  Pointer jumping from the start of each file over those pointers tells where each
block is entered, and only candidates on the chain from there are records: a whole record inside a payload is never reached.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, utf8, written

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
MIN_BYTES = 1000
JOINT = 1 << 20
GROUPS = 500_000


def record_kinds(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages(id long, url, payload string): adds digest (SHA-1, hex), bytes, kind and refers (the response's id for a revisit).

    A null payload is empty; a null id is written as null.  Equal payloads of at least min_bytes are revisits of the row with the largest id.  Groups are counted
    before anything is joined, so that a payload shared by a third of all rows is one row of the joined side.
    """
    body = F.coalesce("payload", F.lit(""))
    rows = pages.select("id", "url", body.alias("payload"), F.sha1(utf8(body)).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    large = F.col("bytes") >= min_bytes
    groups = rows.where(large).groupBy("digest", "bytes").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "bytes", "first")
    groups = written(groups, "warc-groups")
    # few groups go to every task, so that no payload is shuffled; more are joined by digest
    few = groups.limit(GROUPS + 1).count() <= GROUPS
    joined = rows.join(F.broadcast(groups) if few else groups, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & (F.col("id") < F.col("first"))
    return joined.select("*", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"), F.when(revisit, F.col("first")).alias("refers")).drop("first")


def _line(name: str, value) -> list:
    return [F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")]


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """records as from record_kinds, to WARC files below path.  Line ends in a URL become spaces; a null URL is left empty."""
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", " ")
    revisit = F.col("kind") == "revisit"
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    stored = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = [
        F.lit(MAGIC),
        *_line("WARC-Type", F.col("kind")),
        *_line("WARC-Record-ID", name(F.col("id"))),
        *_line("WARC-Date", F.lit(date)),
        *_line("WARC-Target-URI", url),
        *_line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        *_line("X-Payload-Length", F.col("bytes")),
        F.when(revisit, F.concat(*_line("WARC-Refers-To", name(F.col("refers"))), *_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        *_line("Content-Type", F.lit("text/html")),
        *_line("Content-Length", F.octet_length(stored)),
        F.lit("\r\n"),
        stored,
    ]
    records.select(F.concat(*head).alias("value")).write.option("lineSep", END).text(path)


CANDIDATES = (
    "file string, block long, place long, total long, next long, way_out long, head int, size long, whole boolean, "
    "kind string, record string, refers string, stated string, stated_bytes long, sha1 string"
)


def _header(value: bytes, prefix: int = 0) -> tuple[int, dict[str, str]] | None:
    """The length of the header block in value and its fields, names in lower case; None if value doesn't begin with one."""
    end = value.find(b"\r\n\r\n", prefix)
    if end < 0:
        return None
    fields = {}
    for line in value[prefix:end].split(b"\r\n"):
        name, colon, rest = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = rest.strip().decode("utf-8", "replace")
    return end + 4, fields


def candidates(spark: SparkSession, path: str, magic: str = MAGIC) -> DataFrame:
    """A row for each occurrence of the magic that a header follows, and one for the start of each file.

    place is the offset of what follows the magic, next that of the successor; both count from the start of the block (what one
    task reads of a file), which holds total bytes.  way_out is where the chain from here leaves the block, -1 if it breaks.
    """
    wide = len(magic)
    lines = spark.read.option("lineSep", magic).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )

    def finish(block: tuple, found: list[dict], total: int) -> pd.DataFrame:
        places = np.array([c["place"] for c in found], np.int64)
        nexts = np.array([c["next"] for c in found], np.int64)
        out = np.where(nexts >= total, nexts, -1)
        at = np.searchsorted(places, nexts)
        inside = (nexts < total) & (at < len(places))
        inside[inside] = places[at[inside]] == nexts[inside]
        for i in range(len(found) - 1, -1, -1):  # successors stand behind
            if inside[i]:
                out[i] = out[at[i]]
        frame = pd.DataFrame(found, columns=["place", "next", "head", "size", "whole", "kind", "record", "refers", "stated", "stated_bytes", "sha1"])
        frame["stated_bytes"] = frame["stated_bytes"].astype("Int64")
        return frame.assign(file=block[0], block=block[1], total=total, way_out=out)[[c.split()[0] for c in CANDIDATES.split(", ")]]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, found, place = None, [], 0
        for batch in batches:
            for file, start, value in zip(batch["file"], batch["block"], batch["value"]):
                if (file, start) != block:
                    if block:
                        yield finish(block, found, place)
                    block, found, place = (file, start), [], 0
                blank = dict.fromkeys(("kind", "record", "refers", "stated", "stated_bytes", "sha1"))
                if place == 0 and start == 0:
                    # what stands before the first magic; nothing, in a sound file
                    found.append(blank | {"place": 0, "next": wide if not value else -1, "head": 0, "size": 0, "whole": True})
                elif (head := _header(value)) and (size := head[1].get("content-length", "")).isdigit():
                    size, f = int(size), head[1]
                    whole = len(value) == head[0] + size + 4 and value[-4:] == b"\r\n\r\n"
                    digits = f.get("x-payload-length", "")
                    found.append(
                        {
                            "place": place,
                            "next": place + head[0] + size + 4 + wide,
                            "head": head[0],
                            "size": size,
                            "whole": whole,
                            "kind": f.get("warc-type"),
                            "record": f.get("warc-record-id"),
                            "refers": f.get("warc-refers-to"),
                            "stated": f.get("warc-payload-digest"),
                            "stated_bytes": int(digits) if digits.isdigit() else None,
                            "sha1": hashlib.sha1(value[head[0] : -4]).hexdigest() if whole else None,
                        }
                    )
                place += len(value) + wide
        if block:
            yield finish(block, found, place)

    return lines.mapInPandas(parse, CANDIDATES)


def reachable(found: DataFrame) -> DataFrame:
    """The candidates on the chain from the start of their file, with offsets (place, next) from the start of the file."""
    blocks = found.groupBy("file", "block").agg(F.max("total").alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    based = written(found.join(blocks, ["file", "block"]), "warc-candidates")
    at = lambda c: F.when(F.col(c) >= 0, F.col(c) + F.col("base"))
    ways = based.select("file", at("place").alias("at"), at("way_out").alias("to")).where("to is not null")
    starts = based.where("place = 0 and block = 0").select("file", F.lit(0).cast("long").alias("at"))
    # only places where a chain leaves another block, or starts a file, can be entered
    entered = ways.select("file", F.col("to").alias("at")).union(starts).distinct()
    jumps = written(ways.join(entered, ["file", "at"]), "warc-jumps")
    reached, known = starts, -1
    while True:
        reached = written(
            reached.union(reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "warc-reached"
        )
        now = reached.count()
        if now == known:
            break
        known = now
        onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = written(jumps.join(onward, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")), "warc-jumps")
    entries = reached.withColumn("entry", F.lit(True))
    marked = based.withColumn("at", F.col("place") + F.col("base")).join(entries, ["file", "at"], "left")
    columns = [*based.columns, "entry"]
    schema = f"{CANDIDATES}, base long"

    def walk(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place", kind="stable")
        places, nexts = block["place"].to_numpy(), block["next"].to_numpy()
        on = block["entry"].notna().to_numpy(dtype=bool).copy()
        index = {p: i for i, p in enumerate(places.tolist())}
        for i in range(len(places)):
            if on[i] and (j := index.get(int(nexts[i]))) is not None:
                on[j] = True
        return block[on].drop(columns="entry")

    chained = marked.select(*columns).groupBy("file", "block").applyInPandas(walk, schema)
    return chained.withColumns({"place": F.col("place") + F.col("base"), "next": F.col("next") + F.col("base")}).where("head > 0").drop("base", "total", "way_out")


def _payloads_across(spark: SparkSession, path: str, records: DataFrame, found: DataFrame, magic: str) -> DataFrame:
    """SHA-1 of the records whose payload holds the magic: their pieces are gathered and joined by it again."""
    wide = len(magic)
    parts = spark.read.option("lineSep", magic).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, at = None, 0
        for batch in batches:
            out = []
            for file, start, value in zip(batch["file"], batch["block"], batch["value"]):
                if (file, start) != block:
                    block, at = (file, start), 0
                out.append(at)
                at += len(value) + wide
            yield batch.assign(place=out)

    bases = found.groupBy("file", "block").agg(F.max("total").alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = parts.mapInPandas(place, "file string, block long, value binary, place long").join(bases, ["file", "block"])
    placed = placed.select("file", (F.col("place") + F.col("base")).alias("at"), "value").withColumn("joint", F.floor(F.col("at") / JOINT))
    wanted = records.select("file", F.col("place").alias("from"), F.col("next").alias("to"), "head", "size").withColumn(
        "joint", F.explode(F.sequence(F.floor(F.col("from") / JOINT), F.floor((F.col("to") - 1) / JOINT)))
    )
    pieces = wanted.join(placed, ["file", "joint"]).where("at >= from and at < to")
    whole = pieces.groupBy("file", "from", "head", "size").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
    joined = F.aggregate(
        F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), F.get("p", F.lit(0))["value"], lambda acc, x: F.concat(acc, utf8(F.lit(magic)), x["value"])
    )
    return whole.withColumn("b", joined).select(
        "file", F.col("from").alias("place"), F.sha1(F.expr("substring(b, head + 1, cast(size as int))")).alias("across"), (F.length("b") >= F.col("head") + F.col("size")).alias("ended")
    )


def read_archives(spark: SparkSession, path: str, magic: str = MAGIC) -> DataFrame:
    """The verified records of the WARC files below path: file, place, size, kind, record, refers, bytes, digest, digest_ok.

    digest is computed from the payload for records that hold one and is the stated one for revisits.  digest_ok is false where the two
    differ, or where a file ends inside the record.  Bytes that no chain from a file's start reaches are no records.
    """
    found = written(candidates(spark, path, magic), "warc-found")
    records = written(reachable(found), "warc-records")
    split = records.where("not whole")
    if split.limit(1).count():
        records = records.join(_payloads_across(spark, path, split, found, magic), ["file", "place"], "left")
        # the last record of a file has no magic behind it, and is whole
        records = records.withColumns({"sha1": F.coalesce("sha1", "across"), "whole": F.coalesce("ended", "whole")})
    stated = F.lower(F.regexp_replace("stated", "^sha1:", ""))
    revisit = F.col("kind") == "revisit"
    return records.select(
        "file",
        "place",
        "size",
        "kind",
        "record",
        "refers",
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("size")).alias("bytes"),
        F.when(revisit, stated).otherwise(F.col("sha1")).alias("digest"),
        (F.col("whole") & (revisit | (F.col("sha1") == stated) | stated.isNull())).alias("digest_ok"),
    )


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages(id, url, payload) written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc-archive")
    write_archives(record_kinds(pages, min_bytes), path)
    return read_archives(spark, path)
