"""Cutting the lineage of iterative plans: tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Of tables that are as large as the input.
CODEC = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and everything runs on this machine."""
    path = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="riskweave-")
        spark.conf.set(SETTING, path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written just now, which is removed when the driver's Python ends."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    atexit.register(_remove, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in the shared folder, dropped by it as soon as they are used up; what is left goes when the driver's Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, {}, {}

    def _new(self, name: str) -> str:
        path = self.paths[name] = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_remove, self.spark, path)
        return path

    def write(self, df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
        """df as a table, with so many rows a file at most if a number is given."""
        path = self._new(name)
        df.write.option("maxRecordsPerFile", file_rows).parquet(path, compression=CODEC)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str, buckets: int, name: str, dealt: bool = False) -> DataFrame:
        """df with a file for each bucket of key: joins and groups by key with as many shuffle partitions need no exchange of it.  dealt: its
        partitions are the buckets already."""
        self.tables[name] = table = f"riskweave_{uuid.uuid4().hex}"
        (df if dealt else df.repartition(buckets, key)).write.bucketBy(buckets, key).option("compression", CODEC).option("path", self._new(name)).format("parquet").saveAsTable(table)
        return df.sparkSession.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            if table := self.tables.pop(name, None):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            _remove(self.spark, self.paths.pop(name))

    def drop_all(self, but: str = "") -> None:
        self.drop(*[name for name in self.paths if name != but])


def _remove(spark: SparkSession, path: str) -> None:
    try:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner cleans up
        return


def placed(df: DataFrame, *by, name: str = "place", first: int = 0) -> DataFrame:
    """Adds each row's place in the order `by`, without gaps.

    Rows are written before they are range-partitioned, which reads them twice, and sorted once; a place is the rows of earlier partitions plus the place in the own one, so that no task
    sees all rows.
    """
    dealt = cut(cut(df).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", (before + first).alias("_before"))  # a row a partition
    own = F.col("_row").bitwiseAND((1 << 33) - 1)
    return dealt.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + own).drop("_part", "_row", "_before")
