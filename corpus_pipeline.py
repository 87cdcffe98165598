"""A corpus pipeline: quality sample, one document of each near-copy group, decontamination, pseudonyms, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs.  All stages but the last return the columns of documents.  Null texts weigh 0 in the first stage, have an
empty shingle set in the second (linked with nothing, so kept), no words in the third, stay null in the fourth and are packed as
empty documents by the last.  Stages remove rows, not ids: ids may be null or repeated.  As a stage's result is written before the next
stage begins, a stage drops the scratch tables that the one before it has made.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import decontaminate, importance, near_copies, packing, pseudonyms, queries
from riskweave.llm.common import Tables, collecting, dropped, free_name, table, written

#: No SQL can express the pipeline; tests hold it against a brute-force version.
ORACLE_SQL = None
#: Up to so many ids (8 bytes each) are broadcast; more are joined by sorting.
BROADCAST_IDS = 2_000_000


def _without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs less the rows whose key is in ids(key), a written table."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, key, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: what the importance sample leaves out goes."""
    return importance.kept_documents(docs, queries.good_labels(spark, sf_dir))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each component of linked documents the one with the smallest id stays.

    Ids may be null or repeated, so rows go by a hash (64 bits) of all their columns, for which no copy of the documents is written: of rows with one id
    that with the smallest hash stays, one without an id only where none of its component has one.  Rows with one hash are equal; of those with words
    one stays."""
    made, row = Tables(spark), free_name(docs, "_row")
    columns = [docs[f"`{c}`"] for c in docs.columns]
    keyed = docs.withColumn(row, F.xxhash64(*columns, *[c.isNull() for c in columns]))  # a null alone leaves a hash as it is
    found = near_copies.near_copies(keyed.select(F.col(row).alias("doc"), "text")).groupBy(F.col("doc").alias("_k"))
    found = made.write(found.agg(F.min("component_id").alias("component_id"), (F.max("n_shingles") > 0).alias("worded"), F.count("*").alias("m")), "pipeline-components")
    named = found.join(keyed.select(F.col(row).alias("_k"), F.col("doc_id").alias("_d")).distinct(), "_k")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("_d").isNull().alias("unnamed"), "_d", "_k")).alias("x")).select(F.col("x._k").alias("_k"))
    gone = made.write(found.join(kept, "_k", "left_anti").select(F.col("_k").alias(row)), "pipeline-copies")  # by rows: a component may be large
    equal = made.write(found.where("worded and m > 1").join(kept, "_k", "left_semi").select(F.col("_k").alias(row)), "pipeline-equal")
    made.drop("pipeline-components")
    left = _without(keyed, gone, row)
    if not equal.isEmpty():  # their rows only are exchanged
        left = _without(left, equal, row).unionByName(left.join(equal, row, "left_semi").dropDuplicates([row]))
    return left.drop(row)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents go of whose words 5 percent or more stand in benchmark windows.

    A verdict hangs on the text alone, so rows go by a hash (64 bits) of it: ids may be null or repeated."""
    key = F.xxhash64("text")
    found = decontaminate.decontaminate(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = written(found.where(decontaminate.contaminated()).select(F.col("doc_id").alias("_text_key")).distinct(), "pipeline-contaminated")
    return _without(docs.withColumn("_text_key", key), gone, "_text_key").drop("_text_key")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data is replaced; n_chars follows the text."""
    columns = docs.columns
    out = pseudonyms.pseudonymized(docs, queries.DEMO_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else out


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the pieces of all documents and their places in sequences of 2048 tokens."""
    out = packing.packed(docs.select(F.col("doc_id").alias("doc"), "text"), queries.tokenizer_path())
    return out.withColumnRenamed("doc", "doc_id")


_scratch: dict[int, list[str]] = defaultdict(list)


def _staged(place: int, stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, which first drops what the stage one place before has left, and notes what it makes itself."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        dropped(spark, _scratch[place - 1])
        with collecting(_scratch[place]):
            return stage(spark, docs, sf_dir)

    return run_stage


_ORDER = [("quality", quality), ("near_copies", deduplicated), ("decontamination", decontaminated), ("pii", private), ("packing", sequences)]
STAGES = [(name, _staged(k, stage)) for k, (name, stage) in enumerate(_ORDER)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's input is dropped once it is used."""
    made = Tables(spark)
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = made.write(stage(spark, docs, sf_dir), name)
        if last:
            made.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
